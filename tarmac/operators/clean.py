"""Cleaning: the shared filter and derived columns of every plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions import delay_reason, dep_hour, is_delayed
from tarmac.schema import DELAY_THRESHOLD


def clean_condition():
    """Flights that operated (not cancelled, not diverted) and have an
    arrival delay. Pushed down to the scan as plain column predicates."""
    return (F.col("cancelled") == 0) & (F.col("diverted") == 0) & F.col("arr_delay").isNotNull()


def clean_flights(
    df: DataFrame,
    threshold: float = DELAY_THRESHOLD,
    null_hour: int | None = None,
    with_reason: bool = True,
) -> DataFrame:
    """Keep completed flights with an arrival delay; add ``dep_hour``,
    ``is_delayed`` and (optionally) the primary delay ``reason``.

    ``null_hour=None`` keeps a missing departure hour as NULL (report tables
    then drop it from hour groups); ``-1`` gives it its own bucket.
    """
    return tag_flights(df.where(clean_condition()), threshold, null_hour, with_reason)


def tag_flights(df: DataFrame, threshold: float = DELAY_THRESHOLD, null_hour: int | None = None,
                with_reason: bool = True) -> DataFrame:
    """The columns that :func:`clean_flights` adds, on all rows."""
    out = df.withColumns(
        {"dep_hour": dep_hour(null_hour), "is_delayed": is_delayed(threshold)}
    )
    if with_reason:
        out = out.withColumn("reason", delay_reason())
    return out
