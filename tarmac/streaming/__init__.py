"""Structured Streaming versions of the delay totals and event tagging."""

from tarmac.streaming.incremental import (  # noqa: F401
    enriched_stream,
    read_flight_stream,
    read_totals,
    start_totals,
    streaming_totals,
)
