"""Report tables: grouped delay counts, rates, top-k lists, grid and pivot.

Each function takes either a cleaned flight DataFrame (it then runs its own
group-by) or a :class:`~tarmac.operators.aggregates.DelayCube` (it then reads
its slice of the shared one-pass aggregate). Both give identical tables.

NULL rules follow the reference's pandas behaviour table by table:
rates over groups without a delayed flight are NULL in the month, weekday,
hour and airport-rate tables and 0 elsewhere; means over zero delayed flights
are NULL. Ties in every ordering are broken by the group key so that top-k
results are deterministic.

Global windows (no PARTITION BY) appear only over already-reduced tables
whose size is bounded by a fixed domain: carriers, airports, months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions import ROUND_DIGITS, display_name, pct, ratio, route_key, weather_flag, weekday_name
from tarmac.operators.aggregates import CellTotals, DelayCube, RolledCube, delay_totals
from tarmac.operators.clean import clean_condition
from tarmac.schema import (
    AIRPORT_NAMES,
    CARRIER_NAMES,
    CARRIER_SHORT_NAMES,
    DELAY_REASON_NAMES,
    DELAY_THRESHOLD,
    NO_EVENT,
)


def _totals(source, keys: list[str], keep_null_keys: bool = False) -> DataFrame:
    if isinstance(source, (DelayCube, RolledCube, CellTotals)):
        return source.slice(keys, keep_null_keys)
    src = source
    if "route" in keys and "route" not in source.columns:
        src = src.withColumn("route", route_key())
    return delay_totals(src, *keys, keep_null_keys=keep_null_keys)


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).alias(c)


def _zero_d(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0)).alias(c)


def _round(c: Column | str, digits: int = ROUND_DIGITS) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _whole() -> Window:
    """Window over a whole reduced table (bounded: a fixed key domain)."""
    return Window.partitionBy()


# ---------------------------------------------------------------------------
# Overview (one row over the raw scan)
# ---------------------------------------------------------------------------

def overview(flights: DataFrame, threshold: float = DELAY_THRESHOLD) -> DataFrame:
    """Row counts, delay rate, mean/max delay and weather totals in one pass
    over the raw flights (the clean filter is applied inside the aggregates)."""
    clean = clean_condition()
    delayed = clean & (F.col("arr_delay") >= threshold)
    weather = clean & weather_flag()
    agg = flights.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(clean).alias("processed_rows"),
        F.count_if(delayed).alias("delayed_rows"),
        F.avg(F.when(clean, F.col("arr_delay"))).alias("_mean_all"),
        F.avg(F.when(delayed, F.col("arr_delay"))).alias("_mean_delayed"),
        F.max(F.when(clean, F.col("arr_delay"))).alias("max_arr_delay"),
        F.count_if(weather).alias("weather_delayed"),
        F.sum(F.when(weather, F.col("weather_delay"))).alias("_weather_minutes"),
    )
    return agg.select(
        "total_rows",
        "processed_rows",
        "delayed_rows",
        F.coalesce(pct("delayed_rows", "processed_rows"), F.lit(0.0)).alias("delay_rate_pct"),
        F.coalesce(_round("_mean_all"), F.lit(0.0)).alias("arr_delay_mean_all"),
        F.coalesce(_round("_mean_delayed"), F.lit(0.0)).alias("arr_delay_mean_delayed"),
        "max_arr_delay",
        "weather_delayed",
        F.coalesce(F.col("_weather_minutes"), F.lit(0.0)).alias("weather_delay_minutes_total"),
        F.coalesce(pct("weather_delayed", "delayed_rows"), F.lit(0.0)).alias("weather_share_pct"),
    )


def overview_from_cube(cube: RolledCube, total_rows: int) -> DataFrame:
    """The overview from the cube's grand-total row and the raw row count.

    A zero row is added before summing so the result has one row even when no
    flight survives cleaning (the grand-total set is then empty)."""
    spark = cube.table.sparkSession
    g = cube.slice([], keep_null_keys=True)
    zero = spark.range(1).select(
        F.lit(0).cast("long").alias("flights"), F.lit(0).cast("long").alias("delayed"),
        F.lit(None).cast("double").alias("delay_minutes"), F.lit(0).cast("long").alias("weather_flights"),
        F.lit(None).cast("double").alias("weather_minutes"), F.lit(None).cast("double").alias("arr_delay_sum"),
        F.lit(None).cast("double").alias("arr_delay_max"),
    )
    t = g.unionByName(zero).agg(*[
        (F.max(c) if c == "arr_delay_max" else F.sum(c)).alias(c)
        for c in ("flights", "delayed", "delay_minutes", "weather_flights", "weather_minutes", "arr_delay_sum",
                  "arr_delay_max")
    ])
    return t.select(
        F.lit(total_rows).cast("long").alias("total_rows"),
        F.col("flights").alias("processed_rows"),
        F.col("delayed").alias("delayed_rows"),
        F.coalesce(pct("delayed", "flights"), F.lit(0.0)).alias("delay_rate_pct"),
        F.coalesce(_round(F.try_divide(F.col("arr_delay_sum"), F.col("flights").cast("double"))), F.lit(0.0))
        .alias("arr_delay_mean_all"),
        F.coalesce(_round(F.try_divide(F.col("delay_minutes"), F.col("delayed").cast("double"))), F.lit(0.0))
        .alias("arr_delay_mean_delayed"),
        F.col("arr_delay_max").alias("max_arr_delay"),
        F.col("weather_flights").alias("weather_delayed"),
        F.coalesce(F.col("weather_minutes"), F.lit(0.0)).alias("weather_delay_minutes_total"),
        F.coalesce(pct("weather_flights", "delayed"), F.lit(0.0)).alias("weather_share_pct"),
    )


# ---------------------------------------------------------------------------
# Reason and carrier counts
# ---------------------------------------------------------------------------

def delay_reason_counts(source) -> DataFrame:
    """Clean flights and delayed flights per primary reason."""
    t = _totals(source, ["reason"])
    return t.select("reason", "flights", "delayed")


def reason_summary(source) -> DataFrame:
    """Delayed flights and their total arrival minutes per primary reason.
    Minutes are the flight's whole arrival delay, not the cause column."""
    t = _totals(source, ["reason"]).where(F.col("delayed") > 0)
    return t.select(
        "reason",
        display_name("reason", DELAY_REASON_NAMES).alias("reason_name"),
        "delayed",
        _zero_d("delay_minutes"),
    )


def carrier_delayed(source) -> DataFrame:
    """Delayed flights per carrier (carriers with at least one)."""
    t = _totals(source, ["op_unique_carrier"]).where(F.col("delayed") > 0)
    return t.select("op_unique_carrier", "delayed")


def carrier_delayed_named(source, top_n: int = 10) -> DataFrame:
    """Top carriers by delayed flights with display names (code if unknown)."""
    return (
        carrier_delayed(source)
        .select("op_unique_carrier", display_name("op_unique_carrier", CARRIER_NAMES).alias("carrier_name"),
                "delayed")
        .orderBy(F.desc("delayed"), F.asc("op_unique_carrier"))
        .limit(top_n)
    )


# ---------------------------------------------------------------------------
# Airports
# ---------------------------------------------------------------------------

def airport_delay(source, side: str = "origin") -> DataFrame:
    """Flights, delayed flights and delayed minutes per origin or dest."""
    t = _totals(source, [side])
    return t.select(side, "flights", "delayed", _zero_d("delay_minutes"))


def airport_rate(source, side: str = "origin", min_flights: int = 1000, top_n: int = 10) -> DataFrame:
    """Airports with at least ``min_flights`` flights, worst delay rate first.
    An airport without a delayed flight has NULL delayed/minutes/rate and sorts last."""
    t = _totals(source, [side]).where(F.col("flights") >= min_flights)
    out = t.select(
        side,
        display_name(side, AIRPORT_NAMES).alias("airport_name"),
        "flights",
        F.when(F.col("delayed") > 0, F.col("delayed")).alias("delayed"),
        F.when(F.col("delayed") > 0, F.col("delay_minutes")).alias("delay_minutes"),
        pct(F.when(F.col("delayed") > 0, F.col("delayed")), F.col("flights")).alias("delay_rate_pct"),
    )
    return out.orderBy(F.desc_nulls_last("delay_rate_pct"), F.asc(side)).limit(top_n)


def _airport_avg_all(source, side: str) -> DataFrame:
    t = _totals(source, [side])
    return t.select(
        side,
        display_name(side, AIRPORT_NAMES).alias("airport_name"),
        "flights",
        "delayed",
        pct("delayed", "flights").alias("delay_rate_pct"),
        ratio(F.coalesce(F.col("delay_minutes"), F.lit(0.0)), F.when(F.col("delayed") > 0, F.col("delayed"))).alias(
            "avg_delay_minutes_delayed"
        ),
    )


def airport_avg(source, side: str = "origin", top_n: int = 10) -> DataFrame:
    """Top airports by delayed flights with mean minutes per delayed flight."""
    return _airport_avg_all(source, side).orderBy(F.desc("delayed"), F.asc(side)).limit(top_n)


def weather_by_airport(source, side: str = "origin") -> DataFrame:
    """Every airport: flights, weather-attributed flights, their weather
    minutes and the weather rate (0 where none)."""
    t = _totals(source, [side])
    return t.select(
        side,
        display_name(side, AIRPORT_NAMES).alias("airport_name"),
        F.col("flights").alias("flights_total"),
        F.col("weather_flights").alias("weather_delayed"),
        pct("weather_flights", "flights").alias("weather_rate_pct"),
        F.coalesce(F.col("weather_minutes"), F.lit(0.0)).alias("weather_minutes"),
    )


def weather_report(source, side: str = "origin", top_n: int = 10) -> DataFrame:
    """Report table: every airport (zero-filled), most weather-attributed
    flights first, with total flights, weather rate and weather minutes."""
    return weather_by_airport(source, side).orderBy(F.desc("weather_delayed"), F.asc(side)).limit(top_n)


def weather_top(source, side: str = "origin", top_n: int = 10) -> DataFrame:
    """Chart table: airports with a weather-attributed flight, most first."""
    return (
        weather_by_airport(source, side)
        .where(F.col("weather_delayed") > 0)
        .select(side, "airport_name", "weather_delayed", "weather_minutes")
        .orderBy(F.desc("weather_delayed"), F.asc(side))
        .limit(top_n)
    )


def largest_airports(source, n: int = 5) -> DataFrame:
    """The ``n`` busiest origins, their delay rate and its difference from the
    overall clean-flight rate (which also counts flights without an origin)."""
    if isinstance(source, (DelayCube, RolledCube)):
        per = source.slice(["origin"])
        overall = source.slice([], keep_null_keys=True)
        both = per.select("origin", "flights", "delayed", F.lit(False).alias("_total")).unionByName(
            overall.select(F.lit(None).cast("string").alias("origin"), "flights", "delayed",
                           F.lit(True).alias("_total"))
        )
    else:
        both = (
            source.groupingSets([[F.col("origin")], []], F.col("origin"))
            .agg(F.count(F.lit(1)).alias("flights"), F.count_if("is_delayed").alias("delayed"),
                 F.grouping_id().alias("_gid"))
            .select("origin", "flights", "delayed", (F.col("_gid") == 1).alias("_total"))
            .where(F.col("_total") | F.col("origin").isNotNull())
        )
    raw_rate = F.col("delayed").cast("double") * 100.0 / F.col("flights")
    with_overall = both.withColumn(
        "_overall", F.max(F.when(F.col("_total"), F.try_divide(raw_rate, F.lit(1.0)))).over(_whole())
    )
    return (
        with_overall.where(~F.col("_total"))
        .select(
            "origin",
            display_name("origin", AIRPORT_NAMES).alias("airport_name"),
            "flights",
            "delayed",
            _round(raw_rate).alias("delay_rate_pct"),
            _round(raw_rate - F.col("_overall")).alias("delta_vs_overall"),
        )
        .orderBy(F.desc("flights"), F.asc("origin"))
        .limit(n)
    )


# ---------------------------------------------------------------------------
# Routes
# ---------------------------------------------------------------------------

def route_delay(source) -> DataFrame:
    """Every route: flights, delayed, minutes, rate and mean minutes per
    delayed flight. High-cardinality key: a plain hash aggregate."""
    t = _totals(source, ["route"])
    return t.select(
        "route",
        "flights",
        "delayed",
        _zero_d("delay_minutes"),
        pct("delayed", "flights").alias("delay_rate_pct"),
        ratio(F.coalesce(F.col("delay_minutes"), F.lit(0.0)), F.when(F.col("delayed") > 0, F.col("delayed"))).alias(
            "avg_delay_minutes_delayed"
        ),
    )


def route_top(source, top_n: int = 10) -> DataFrame:
    return route_delay(source).orderBy(F.desc("delayed"), F.asc("route")).limit(top_n)


# ---------------------------------------------------------------------------
# Calendar and hour rates
# ---------------------------------------------------------------------------

def _rate_table(source, key: str, keep_null_keys: bool = False) -> DataFrame:
    t = _totals(source, [key], keep_null_keys)
    return t.select(
        key,
        "flights",
        "delayed",
        pct(F.when(F.col("delayed") > 0, F.col("delayed")), F.col("flights")).alias("delay_rate_pct"),
    )


def month_rate(source) -> DataFrame:
    """Delay rate per month; NULL for a month without a delayed flight."""
    return _rate_table(source, "month").orderBy("month")


def weekday_rate(source) -> DataFrame:
    t = _rate_table(source, "day_of_week")
    return t.select("day_of_week", weekday_name().alias("weekday"), "flights", "delayed", "delay_rate_pct").orderBy(
        "day_of_week"
    )


def hour_rate(source, with_unknown: bool = False) -> DataFrame:
    """Delay rate per scheduled departure hour. ``with_unknown`` keeps flights
    without a scheduled time as hour -1 (the chart variant)."""
    if not with_unknown:
        return _rate_table(source, "dep_hour").orderBy("dep_hour")
    t = _rate_table(source, "dep_hour", keep_null_keys=True)
    t = t.withColumn("dep_hour", F.coalesce(F.col("dep_hour"), F.lit(-1)))
    # A -1 bucket may exist already when the input was cleaned with null_hour=-1.
    return (
        t.groupBy("dep_hour")
        .agg(F.sum("flights").alias("flights"), F.sum("delayed").alias("delayed"))
        .select("dep_hour", "flights", "delayed",
                pct(F.when(F.col("delayed") > 0, F.col("delayed")), F.col("flights")).alias("delay_rate_pct"))
        .orderBy("dep_hour")
    )


def month_extremes(source) -> DataFrame:
    """Month rates with the highest- and lowest-rate months marked (first
    month on ties; months without a rate are never marked)."""
    t = month_rate(source)
    by_max = Window.orderBy(F.desc_nulls_last("delay_rate_pct"), F.asc("month"))
    by_min = Window.orderBy(F.asc_nulls_last("delay_rate_pct"), F.asc("month"))
    return t.select(
        "month",
        "flights",
        "delayed",
        "delay_rate_pct",
        ((F.row_number().over(by_max) == 1) & F.col("delay_rate_pct").isNotNull()).alias("is_max_rate"),
        ((F.row_number().over(by_min) == 1) & F.col("delay_rate_pct").isNotNull()).alias("is_min_rate"),
    )


def origin_hour(source) -> DataFrame:
    t = _totals(source, ["origin", "dep_hour"])
    return t.select("origin", "dep_hour", "flights", "delayed")


def origin_hour_grid(source, n_origins: int = 5) -> DataFrame:
    """The ``n_origins`` origins with most delayed flights x hours 0..23, with
    flights and delayed (0 when none) and the rate (NULL without flights).

    Flights are aggregated once, by origin and hour (unknown hours count for
    the ranking). Each origin then keeps its at most 24 hours as a map, and the
    grid is ``explode(sequence(0, 23))`` on the top-n rows.
    """
    hours = _totals(source, ["origin", "dep_hour"], keep_null_keys=True).where(F.col("origin").isNotNull())
    entry = F.when(F.col("dep_hour").between(0, 23), F.struct("dep_hour", F.struct("flights", "delayed")))
    top = (
        hours.groupBy("origin")
        .agg(F.sum("delayed").alias("_all"), F.map_from_entries(F.collect_list(entry)).alias("_hours"))
        .orderBy(F.desc("_all"), F.asc("origin"))
        .limit(n_origins)
        .select("origin", "_hours", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("dep_hour"))
    )
    cell = F.element_at("_hours", F.col("dep_hour"))
    return top.select("origin", "dep_hour", cell["flights"].alias("flights"), cell["delayed"].alias("delayed")).select(
        "origin",
        display_name("origin", AIRPORT_NAMES).alias("origin_name"),
        "dep_hour",
        _zero("flights"),
        _zero("delayed"),
        pct(F.coalesce(F.col("delayed"), F.lit(0)), F.col("flights")).alias("delay_rate_pct"),
    )


def origin_hour_heatmap(source, n_origins: int = 5) -> DataFrame:
    """Pivot of the grid: one row per origin name, columns h0..h23 holding the
    delay rate. The hour values are listed, so no extra job discovers them."""
    grid = origin_hour_grid(source, n_origins)
    wide = grid.groupBy("origin_name").pivot("dep_hour", list(range(24))).agg(F.first("delay_rate_pct"))
    return wide.select("origin_name", *[F.col(str(h)).alias(f"h{h}") for h in range(24)])


# ---------------------------------------------------------------------------
# Events
# ---------------------------------------------------------------------------

def event_cells(clean: DataFrame, dimension: DataFrame) -> CellTotals:
    """Measures per (date, origin, dest), tagged with the event (origin
    first, then destination): the event tables roll these up, so the lookup
    joins one row per date and route instead of one per flight."""
    from tarmac.operators.events import enrich_events

    cells = delay_totals(clean, "fl_date", "origin", "dest", keep_null_keys=True)
    return CellTotals(enrich_events(cells, dimension))


def event_delay(source, top_n: int = 20) -> DataFrame:
    """Per event (``'none'`` pinned first, then most delayed): flights,
    delayed, rate and delayed minutes, zero-filled."""
    t = _totals(source, ["event_name"])
    out = t.select(
        "event_name",
        "flights",
        "delayed",
        pct("delayed", "flights").alias("delay_rate_pct"),
        _zero_d("delay_minutes"),
    )
    return out.orderBy((F.col("event_name") == F.lit(NO_EVENT)).desc(), F.desc("delayed"), F.asc("event_name")).limit(
        top_n
    )


def event_origin_delay(source) -> DataFrame:
    t = _totals(source, ["event_name", "origin"])
    return t.select("event_name", "origin", "flights", "delayed", _zero_d("delay_minutes"))


def event_top(source, top_n: int = 10) -> DataFrame:
    """Chart table: real events (not ``'none'``) with most delayed flights,
    showing their delay rate."""
    t = _totals(source, ["event_name"]).where((F.col("event_name") != F.lit(NO_EVENT)) & (F.col("flights") > 0))
    return (
        t.select("event_name", "flights", "delayed", pct("delayed", "flights").alias("delay_rate_pct"))
        .orderBy(F.desc("delayed"), F.asc("event_name"))
        .limit(top_n)
    )


# ---------------------------------------------------------------------------
# Carriers (chart) and sample rows
# ---------------------------------------------------------------------------

def carrier_rate(source, top_n: int = 10) -> DataFrame:
    """Worst carriers by delay rate, with short display names and the grand
    totals of flights and delayed flights over all carriers."""
    t = _totals(source, ["op_unique_carrier"]).where(F.col("flights") > 0)
    with_totals = t.select(
        "op_unique_carrier",
        display_name("op_unique_carrier", CARRIER_SHORT_NAMES).alias("carrier_name"),
        "flights",
        "delayed",
        pct("delayed", "flights").alias("delay_rate_pct"),
        F.sum("flights").over(_whole()).alias("total_flights"),
        F.sum("delayed").over(_whole()).alias("total_delayed"),
    )
    return with_totals.orderBy(F.desc("delay_rate_pct"), F.asc("op_unique_carrier")).limit(top_n)


SAMPLE_COLUMNS = ["fl_date", "op_unique_carrier", "op_carrier_fl_num", "origin", "dest", "arr_delay", "reason"]


def sample_delays(clean: DataFrame, n: int = 10, order: list[str] | None = None) -> DataFrame:
    """``n`` delayed flights, first in the order of the columns ``order`` (the
    readers' row position, for file order) or in a total order over the shown
    columns (a per-partition top-n merged once: no sort of the whole table)."""
    return (
        clean.where(F.col("is_delayed"))
        .orderBy(*[F.asc_nulls_first(c) for c in order or SAMPLE_COLUMNS])
        .limit(n)
        .select(*SAMPLE_COLUMNS)
    )


def class_balance(clean: DataFrame) -> DataFrame:
    """Positive rate and the accuracy of always predicting on-time."""
    agg = clean.agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_delayed").alias("positives"))
    rate = F.try_divide(F.col("positives").cast("double"), F.col("rows"))
    return agg.select(
        "rows",
        "positives",
        F.round(F.coalesce(rate, F.lit(0.0)), ROUND_DIGITS).alias("positive_rate"),
        F.round(F.coalesce(1.0 - rate, F.lit(0.0)), ROUND_DIGITS).alias("always_on_time_accuracy"),
    )
