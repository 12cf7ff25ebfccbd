"""Column expressions shared by every plan.

All of these are built-in Spark expressions, so they stay inside whole-stage
code generation; none calls back into Python.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmac.schema import (
    AIRPORT_FIXES,
    DELAY_REASON_COLUMNS,
    DELAY_THRESHOLD,
    UNKNOWN_REASON,
    WEEKDAY_NAMES,
)

# Number of decimals kept on derived doubles (rates, means); keeps results
# independent of summation order across partitions.
ROUND_DIGITS = 6


def dep_hour(null_hour: int | None = None) -> Column:
    """Scheduled departure hour ``crs_dep_time div 100``; ``null_hour`` fills
    rows without a scheduled time (the charts and models use -1)."""
    hour = F.expr("CAST(crs_dep_time DIV 100 AS INT)")
    if null_hour is not None:
        hour = F.coalesce(hour, F.lit(null_hour))
    return hour.alias("dep_hour")


def is_delayed(threshold: float = DELAY_THRESHOLD) -> Column:
    return (F.col("arr_delay") >= F.lit(threshold)).alias("is_delayed")


def delay_reason() -> Column:
    """First cause column with positive minutes, in fixed priority order."""
    expr = None
    for name in DELAY_REASON_COLUMNS:
        cond = F.col(name) > 0
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(UNKNOWN_REASON)).alias("reason")


def route_key() -> Column:
    """``origin-dest``; NULL when either end is unknown (``concat`` keeps NULL)."""
    return F.concat(F.col("origin"), F.lit("-"), F.col("dest")).alias("route")


def weather_flag() -> Column:
    """Weather-attributed flight: positive weather minutes, delayed or not."""
    return F.coalesce(F.col("weather_delay"), F.lit(0.0)) > 0


def pct(numerator: Column | str, denominator: Column | str, digits: int = ROUND_DIGITS) -> Column:
    """``numerator * 100 / denominator`` as a double; NULL when the
    denominator is 0 or NULL (``try_divide``: plain division raises under ANSI)."""
    num = F.col(numerator) if isinstance(numerator, str) else numerator
    den = F.col(denominator) if isinstance(denominator, str) else denominator
    return F.round(F.try_divide(num.cast("double") * F.lit(100.0), den.cast("double")), digits)


def ratio(numerator: Column | str, denominator: Column | str, digits: int = ROUND_DIGITS) -> Column:
    num = F.col(numerator) if isinstance(numerator, str) else numerator
    den = F.col(denominator) if isinstance(denominator, str) else denominator
    return F.round(F.try_divide(num.cast("double"), den.cast("double")), digits)


_MAPS: dict[tuple, Column] = {}


def literal_map(mapping: dict) -> Column:
    """A constant map column; the lookup stays a JVM expression (no join).
    Columns are immutable, so each distinct map is built once and reused."""
    key = tuple(mapping.items())
    if key not in _MAPS:
        _MAPS[key] = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return _MAPS[key]


def display_name(code: Column | str, mapping: dict) -> Column:
    """Name for a code, falling back to the code itself when unknown."""
    col = F.col(code) if isinstance(code, str) else code
    return F.coalesce(F.try_element_at(literal_map(mapping), col), col)


def weekday_name(day_of_week: Column | str = "day_of_week") -> Column:
    col = F.col(day_of_week) if isinstance(day_of_week, str) else day_of_week
    return F.try_element_at(literal_map(WEEKDAY_NAMES), col)


def fixed_airport(raw: Column) -> Column:
    """Trim, upper-case and apply the fixed airport code replacements."""
    code = F.upper(F.trim(raw))
    return F.coalesce(F.try_element_at(literal_map(AIRPORT_FIXES), code), code)


def schedule_date(raw: Column) -> Column:
    """``'Sat,2024-01-06'`` or ``'2024-01-06'`` to a date: split once on the
    first comma and parse the remainder; unparseable text gives NULL."""
    tail = F.element_at(F.split(raw, ",", 2), -1)
    return F.to_date(F.try_to_timestamp(F.trim(tail)))


def event_label(date_col: Column, league: Column, home: Column, away: Column,
                stadium: Column, airport: Column) -> Column:
    """``date | league: away @ home (stadium / airport)``; missing cells print
    as empty text."""
    def txt(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    return F.concat(
        F.coalesce(date_col.cast("string"), F.lit("unknown-date")),
        F.lit(" | "), txt(league), F.lit(": "), txt(away), F.lit(" @ "), txt(home),
        F.lit(" ("), txt(stadium), F.lit(" / "), txt(airport), F.lit(")"),
    )
