"""Event dimension and event enrichment of flights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions import event_label, fixed_airport, schedule_date
from tarmac.operators.joins import BROADCAST_MAX_BYTES, broadcast_if_small
from tarmac.schema import NO_EVENT


def event_dimension(schedule: DataFrame, seq_col: str = "seq") -> DataFrame:
    """``(event_date, airport) -> event_name``, one row per key.

    Dates are parsed from ``'Sat,2024-01-06'`` text (rows that do not parse
    are dropped), airport codes are trimmed, upper-cased and fixed, and a key
    that occurs more than once keeps the row latest in ``seq`` (file order).
    ``max_by`` is an ordinary grouped aggregate with map-side partial
    aggregation, so even a key holding most rows is reduced before the shuffle.
    """
    def cell(name: str):
        return F.col(f"`{name}`") if name in schedule.columns else F.lit(None).cast("string")

    parsed = schedule.select(
        F.col(seq_col).alias("seq"),
        schedule_date(cell("Date")).alias("event_date"),
        fixed_airport(cell("Primary Airport")).alias("airport"),
        cell("League").alias("league"),
        cell("Team Name").alias("home"),
        cell("Away Team").alias("away"),
        cell("Stadium Name").alias("stadium"),
    ).where(F.col("event_date").isNotNull())
    labelled = parsed.select(
        "seq",
        "event_date",
        "airport",
        event_label(F.col("event_date"), F.col("league"), F.col("home"), F.col("away"), F.col("stadium"),
                    F.col("airport")).alias("event_name"),
    )
    return labelled.groupBy("event_date", "airport").agg(F.max_by("event_name", "seq").alias("event_name"))


def enrich_events(
    flights: DataFrame,
    dimension: DataFrame,
    date_col: str = "fl_date",
    max_broadcast_bytes: int = BROADCAST_MAX_BYTES,
) -> DataFrame:
    """Add ``event_name``: the origin's event on the flight date, else the
    destination's, else ``'none'``.

    Two left equi-joins against the (unique-keyed) dimension, so no flight is
    duplicated. The dimension is computed once, into the shared folder, and is
    broadcast only when it takes at most ``max_broadcast_bytes`` there; then both lookups are hash probes in the same
    stage and the flight table is never shuffled. Larger dimensions fall back
    to shuffle joins, where AQE splits a skewed (date, airport) partition and
    flights with a NULL key, which match nothing, are dealt by a hash of the row.
    """
    dim, small = broadcast_if_small(dimension.select("event_date", "airport", "event_name"), max_broadcast_bytes)
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in flights.columns]).cast("string")

    def on(airport: str, side: str):
        date_key, airport_key = F.col(date_col), F.col(airport)
        if not small:
            lost = date_key.isNull() | airport_key.isNull()
            # A NULL date never matches; the hash only spreads such rows.
            date_key, airport_key = F.when(~lost, date_key), F.when(lost, row_hash).otherwise(airport_key)
        return (date_key == F.col(f"_{side}_date")) & (airport_key == F.col(f"_{side}_airport"))

    at_origin = dim.select(
        F.col("event_date").alias("_eo_date"), F.col("airport").alias("_eo_airport"),
        F.col("event_name").alias("_eo_name"),
    )
    at_dest = dim.select(
        F.col("event_date").alias("_ed_date"), F.col("airport").alias("_ed_airport"),
        F.col("event_name").alias("_ed_name"),
    )
    out = flights.join(at_origin, on("origin", "eo"), "left").join(at_dest, on("dest", "ed"), "left")
    return out.withColumn(
        "event_name", F.coalesce(F.col("_eo_name"), F.col("_ed_name"), F.lit(NO_EVENT))
    ).drop(*at_origin.columns, *at_dest.columns)


def with_event_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("event_flag", (F.col("event_name") != F.lit(NO_EVENT)).cast("int"))
