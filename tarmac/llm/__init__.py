"""Operators for large text corpora (training-data preparation).

Nothing outside this package imports it; it may use the general helpers of
``tarmac`` (session and checkpoint folder).
"""
