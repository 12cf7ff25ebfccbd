"""Catalog entries for the streaming plans.

Each entry streams the files of the given ``lineitem`` table through the flight
view with ``trigger(availableNow=True)``: the other tables are joined
stream-static and no copy of the flights is written. Sink and state lie in a
fresh folder under the shared checkpoint folder. The sink is returned as a
batch table, so the streamed result is compared with the batch SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.plans.catalog import Query, load_event_dim
from tarmac.session import run_folder
from tarmac.sources.testview import flights_view
from tarmac.streaming import enriched_stream, read_totals, start_totals, streaming_totals


def _flight_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/lineitem.parquet"
    # The pattern lets the table be one file as well as a folder of files.
    lines = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    return flights_view(spark, sf_dir, lineitem=lines)


def _stream_totals(spark: SparkSession, sf_dir: str, keys: list[str], with_events: bool) -> DataFrame:
    base = run_folder(spark, "stream-runs")
    dim = load_event_dim(spark, sf_dir) if with_events else None
    totals = streaming_totals(_flight_stream(spark, sf_dir), keys, dimension=dim)
    start_totals(totals, f"{base}/sink", f"{base}/state").awaitTermination()
    return read_totals(spark, f"{base}/sink").select(
        *keys, "flights", "delayed", F.coalesce(F.col("delay_minutes"), F.lit(0.0)).alias("delay_minutes"))


def _stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = run_folder(spark, "stream-runs")
    rows = enriched_stream(_flight_stream(spark, sf_dir), load_event_dim(spark, sf_dir))
    writer = rows.writeStream.format("parquet").option("path", f"{base}/rows")
    writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/rows")


def stream_queries() -> dict[str, Query]:
    return {
        "stream_origin_totals": lambda sp, d: _stream_totals(sp, d, ["origin"], False),
        "stream_event_totals": lambda sp, d: _stream_totals(sp, d, ["event_name"], True),
        "stream_event_enriched": _stream_rows,
    }
