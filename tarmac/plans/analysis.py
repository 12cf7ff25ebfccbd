"""The descriptive report and the chart tables as one Spark plan.

``delay_report`` reads the flights once. A ``GROUPING SETS`` aggregate gives two
fine tables from that scan, one by date and airports and one by airport, hour,
carrier and reason, so a flight is expanded twice and not once for each of the
report's groupings; these are rolled up from the fine tables. Flights that do
not pass the cleaning are one group of their own, which makes the raw row count
part of the same aggregate. Event tables come from the table by date and
airports, tagged with the event and rolled up, so the event lookup joins reduced
rows, not flights. The fine and the rolled-up tables are checkpointed to the
shared checkpoint folder: the ~30 tables read from them never re-scan the
flights and a lost executor does not send the job back to the source files. The
sample of delayed flights is one more narrow pass (a per-partition top-10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions import route_key
from tarmac.operators import reports as R
from tarmac.operators.aggregates import MEASURES, CellTotals, DelayCube, RolledCube
from tarmac.operators.clean import clean_condition, clean_flights, tag_flights
from tarmac.operators.events import enrich_events, event_dimension
from tarmac.schema import DELAY_THRESHOLD
from tarmac.session import ensure_checkpoint_dir

# The fine tables and the groupings rolled up from each.
BY_DAY = ["fl_date", "month", "day_of_week", "origin", "dest"]
BY_OPERATION = ["origin", "dep_hour", "op_unique_carrier", "reason"]
DAY_SETS = [["month"], ["day_of_week"], ["origin"], ["dest"], ["route"], []]
OPERATION_SETS = [["dep_hour"], ["op_unique_carrier"], ["origin", "dep_hour"], ["reason"]]


def fine_cube(flights: DataFrame, threshold: float = DELAY_THRESHOLD) -> DelayCube:
    """Measures of all flights by ``kept`` (passes the cleaning) and the two fine
    groupings; the keys and measures of flights that are not kept are empty."""
    kept = F.coalesce(clean_condition(), F.lit(False))
    keys = list(dict.fromkeys(BY_DAY + BY_OPERATION))
    tagged = tag_flights(flights, threshold).withColumn("kept", kept)
    masked = tagged.select(
        "kept", *[F.when(F.col("kept"), F.col(c)).alias(c) for c in (*keys, "arr_delay", "weather_delay")],
        (F.col("kept") & F.col("is_delayed")).alias("is_delayed"))
    return DelayCube(masked, [["kept", *BY_DAY], ["kept", *BY_OPERATION]])


def build_cube(flights: DataFrame, threshold: float, checkpoint: bool = True) -> tuple[RolledCube, DataFrame, int]:
    """The report's groupings, the fine table by date and airports, and the raw
    number of flights."""
    fine = fine_cube(flights, threshold)
    if checkpoint:
        ensure_checkpoint_dir(flights.sparkSession)
        fine.table = fine.table.checkpoint(eager=True)
    day = fine.slice(["kept", *BY_DAY], keep_null_keys=True)
    operation = fine.slice(["kept", *BY_OPERATION], keep_null_keys=True)
    total = operation.agg(F.sum("flights")).first()[0] or 0
    day = day.where("kept").withColumn("route", route_key())
    cube = RolledCube([(day, DAY_SETS), (operation.where("kept"), OPERATION_SETS)])
    return (cube.checkpoint() if checkpoint else cube), day, total


def delay_report(
    flights: DataFrame,
    schedule: DataFrame | None = None,
    *,
    threshold: float = DELAY_THRESHOLD,
    top_n: int = 10,
    min_airport_flights: int = 1000,
    event_top: int = 20,
    chart_top_n: int = 10,
    checkpoint: bool = True,
) -> dict[str, DataFrame]:
    """All report and chart tables, keyed like the query catalog."""
    cube, by_day, total = build_cube(flights, threshold, checkpoint)

    t: dict[str, DataFrame] = {
        "overview": R.overview_from_cube(cube, total),
        "delay_reason": R.delay_reason_counts(cube),
        "reason_summary": R.reason_summary(cube),
        "carrier_delayed": R.carrier_delayed(cube),
        "carrier_delayed_named": R.carrier_delayed_named(cube, top_n),
        "route_delay": R.route_delay(cube),
        "route_top": R.route_top(cube, top_n),
        "month_rate": R.month_rate(cube),
        "weekday_rate": R.weekday_rate(cube),
        "hour_rate": R.hour_rate(cube),
        "hour_rate_with_unknown": R.hour_rate(cube, with_unknown=True),
        "origin_hour": R.origin_hour(cube),
        "month_extremes": R.month_extremes(cube),
        "largest_airports": R.largest_airports(cube),
        "origin_hour_grid": R.origin_hour_grid(cube),
        "origin_hour_heatmap": R.origin_hour_heatmap(cube),
        "sample_delays": R.sample_delays(clean_flights(flights, threshold)),
        "carrier_rate": R.carrier_rate(cube, chart_top_n),
        "weather_top_origins": R.weather_top(cube, "origin", chart_top_n),
    }
    for side in ("origin", "dest"):
        t[f"{side}_delay"] = R.airport_delay(cube, side)
        t[f"airport_rate_{side}"] = R.airport_rate(cube, side, min_airport_flights, top_n)
        t[f"airport_avg_{side}"] = R.airport_avg(cube, side, top_n)
        t[f"weather_{side}"] = R.weather_by_airport(cube, side)
        t[f"weather_report_{side}"] = R.weather_report(cube, side, top_n)
    if schedule is not None:
        # One row per (date, origin, dest) with its measures, tagged with the
        # event (origin first, then destination) and rolled up per event.
        cells = enrich_events(by_day.select("fl_date", "origin", "dest", *MEASURES), event_dimension(schedule))
        events = CellTotals(cells)
        t["event_delay"] = R.event_delay(events, event_top)
        t["event_origin_delay"] = R.event_origin_delay(events)
        t["event_top"] = R.event_top(events, chart_top_n)
    return t
