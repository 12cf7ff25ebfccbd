"""tarmac: flight-delay analytics as Spark DataFrame plans.

Every public function maps DataFrames to DataFrames (or to a dict of named
DataFrames for multi-table reports). Nothing iterates over collected rows:
the only values brought to the driver are fixed-size statistics (a one-row
aggregate, a handful of quantile cut points, fitted model parameters).

Sub-packages:
  sources    readers for the flight file, the event schedule and the fixture view
  functions  column expressions (cleaning rules, names, rates)
  operators  cleaning, event joins, grouped aggregates, features, models, evaluation
  plans      multi-table reports and the query catalog used by __spark_entry__
  streaming  incremental versions of the delay totals
"""

__version__ = "0.1.0"
