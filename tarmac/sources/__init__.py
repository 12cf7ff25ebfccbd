"""Readers: flight files, schedule file, fixture views, result sink."""

from tarmac.sources.flights import column_profile, conform, read_flights_csv, read_flights_parquet  # noqa: F401
from tarmac.sources.schedule import read_schedule_csv  # noqa: F401
from tarmac.sources.sinks import write_tables  # noqa: F401
from tarmac.sources.testview import flights_view, read_table, schedule_view  # noqa: F401
