"""Query catalog: one callable ``(spark, sf_dir) -> DataFrame`` per table.

Each query starts from the raw test tables through the fixture views, so its
work grows with the data; parameters are the reference's defaults.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators import reports as R
from tarmac.operators.clean import clean_flights
from tarmac.operators.events import enrich_events, event_dimension
from tarmac.session import run_folder
from tarmac.sources.flights import column_profile, read_flights_csv
from tarmac.sources.schedule import read_schedule_csv
from tarmac.sources.testview import flights_view, schedule_view

Query = Callable[[SparkSession, str], DataFrame]

MIN_AIRPORT_FLIGHTS = 1000
TOP_N = 10
EVENT_TOP = 20


def load_clean(spark: SparkSession, sf_dir: str, null_hour: int | None = None) -> DataFrame:
    return clean_flights(flights_view(spark, sf_dir), null_hour=null_hour)


def load_event_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_dimension(schedule_view(spark, sf_dir))


def load_enriched(spark: SparkSession, sf_dir: str, null_hour: int | None = None) -> DataFrame:
    return enrich_events(load_clean(spark, sf_dir, null_hour), load_event_dim(spark, sf_dir))


def load_event_cells(spark: SparkSession, sf_dir: str):
    return R.event_cells(load_clean(spark, sf_dir), load_event_dim(spark, sf_dir))


def report_queries() -> dict[str, Query]:
    c = load_clean
    e = load_enriched
    q: dict[str, Query] = {
        "clean_flights": lambda s, d: c(s, d),
        "delay_reason": lambda s, d: R.delay_reason_counts(c(s, d)),
        "overview": lambda s, d: R.overview(flights_view(s, d)),
        "reason_summary": lambda s, d: R.reason_summary(c(s, d)),
        "carrier_delayed": lambda s, d: R.carrier_delayed(c(s, d)),
        "carrier_delayed_named": lambda s, d: R.carrier_delayed_named(c(s, d), TOP_N),
    }
    for side in ("origin", "dest"):
        q[f"{side}_delay"] = lambda s, d, side=side: R.airport_delay(c(s, d), side)
        q[f"airport_rate_{side}"] = lambda s, d, side=side: R.airport_rate(c(s, d), side, MIN_AIRPORT_FLIGHTS, TOP_N)
        q[f"airport_avg_{side}"] = lambda s, d, side=side: R.airport_avg(c(s, d), side, TOP_N)
        q[f"weather_{side}"] = lambda s, d, side=side: R.weather_by_airport(c(s, d), side)
        q[f"weather_report_{side}"] = lambda s, d, side=side: R.weather_report(c(s, d), side, TOP_N)
    q.update({
        "weather_top_origins": lambda s, d: R.weather_top(c(s, d), "origin", TOP_N),
        "route_delay": lambda s, d: R.route_delay(c(s, d)),
        "route_top": lambda s, d: R.route_top(c(s, d), TOP_N),
        "month_rate": lambda s, d: R.month_rate(c(s, d)),
        "weekday_rate": lambda s, d: R.weekday_rate(c(s, d)),
        "hour_rate": lambda s, d: R.hour_rate(c(s, d)),
        "hour_rate_with_unknown": lambda s, d: R.hour_rate(c(s, d, null_hour=-1), with_unknown=True),
        "origin_hour": lambda s, d: R.origin_hour(c(s, d)),
        "month_extremes": lambda s, d: R.month_extremes(c(s, d)),
        "largest_airports": lambda s, d: R.largest_airports(c(s, d)),
        "origin_hour_grid": lambda s, d: R.origin_hour_grid(c(s, d)),
        "origin_hour_heatmap": lambda s, d: R.origin_hour_heatmap(c(s, d)),
        "event_dim": lambda s, d: load_event_dim(s, d),
        "event_enriched": lambda s, d: e(s, d),
        "event_delay": lambda s, d: R.event_delay(load_event_cells(s, d), EVENT_TOP),
        "event_origin_delay": lambda s, d: R.event_origin_delay(load_event_cells(s, d)),
        "event_top": lambda s, d: R.event_top(load_event_cells(s, d), TOP_N),
        "sample_delays": lambda s, d: R.sample_delays(c(s, d)),
        "carrier_rate": lambda s, d: R.carrier_rate(c(s, d), TOP_N),
        "class_balance": lambda s, d: R.class_balance(c(s, d)),
        "column_profile": lambda s, d: column_profile(flights_view(s, d)),
    })
    return q


def scan_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flights written as CSV text with bad cells planted (a number that
    overflows, ``NaN``, ``NA``, a text in place of a date, whole numbers with a
    decimal point) and read back by the flight reader."""
    flights = flights_view(spark, sf_dir)
    number = F.col("op_carrier_fl_num").cast("long")
    planted = {
        "crs_dep_time": F.when(number % 83 == 0, "99999999999").otherwise(F.concat(F.col("crs_dep_time"), F.lit(".0"))),
        "arr_delay": F.when(number % 79 == 0, "NaN").otherwise(F.col("arr_delay").cast("string")),
        "distance": F.when(number % 73 == 0, "NA").otherwise(F.col("distance").cast("string")),
        "fl_date": F.when(number % 71 == 0, "not a date").otherwise(F.col("fl_date").cast("string")),
    }
    path = run_folder(spark, "flight-files")
    flights.select(*[planted[c].alias(c) if c in planted else c for c in flights.columns]).write.option(
        "header", True).csv(path)
    return read_flights_csv(spark, path, columns=flights.columns)


def flight_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """The flights as two folders of CSV files: the months to June and the
    others, each in a total order, the second with its columns turned round."""
    flights = flights_view(spark, sf_dir)
    path = run_folder(spark, "flight-files")
    order = [F.asc_nulls_first(c) for c in flights.columns]
    early = F.col("month") <= 6
    flights.where(early).orderBy(*order).write.option("header", True).csv(f"{path}/1")
    flights.where(~early).orderBy(*order).select(*flights.columns[::-1]).write.option("header", True).csv(f"{path}/2")
    return [f"{path}/1", f"{path}/2"]


def scan_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 000 rows of the flight files, in file order."""
    return read_flights_csv(spark, flight_files(spark, sf_dir), flights_view(spark, sf_dir).columns, limit=40_000)


def first_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first delayed flights of the files."""
    columns = flights_view(spark, sf_dir).columns
    rows = read_flights_csv(spark, flight_files(spark, sf_dir), columns, with_position=True)
    return R.sample_delays(clean_flights(rows), order=["_position"])


def event_dim_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event dimension from schedule files with two headings: the last row
    of a date and airport wins, in the order of folders, files and rows."""
    schedule = schedule_view(spark, sf_dir)
    path = run_folder(spark, "schedule-files")
    columns = [c for c in schedule.columns if c != "seq"]
    for odd, names in ((0, columns), (1, columns[::-1])):
        part = schedule.where(F.col("seq") % 2 == odd).orderBy("seq")
        part.select(*[F.col(f"`{c}`") for c in names]).write.option("header", True).csv(f"{path}/{odd}")
    return event_dimension(read_schedule_csv(spark, [f"{path}/0", f"{path}/1"]))


def all_queries() -> dict[str, Query]:
    from tarmac.plans.catalog_eval import eval_queries, feature_queries
    from tarmac.plans.catalog_models import model_queries
    from tarmac.plans.catalog_stream import stream_queries

    q = report_queries()
    q.update({"scan_flights": scan_flights, "scan_first_rows": scan_first_rows, "first_delays": first_delays,
              "event_dim_files": event_dim_files})
    q.update(eval_queries())
    q.update(feature_queries())
    q.update(model_queries())
    q.update(stream_queries())
    return q
