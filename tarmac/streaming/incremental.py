"""Incremental delay totals with Structured Streaming.

New flight files dropped into a folder update the grouped totals; the state
store keeps one row per group key (bounded by the key domain, not by the
number of flights). With ``trigger(availableNow=True)`` the query processes
everything present and stops, which makes it a restartable batch job: the
streaming checkpoint records which files are done, so a rerun after a failure
only reads new files.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from tarmac.operators.aggregates import delay_measures
from tarmac.operators.clean import clean_flights
from tarmac.operators.events import enrich_events
from tarmac.schema import DELAY_THRESHOLD, FLIGHT_SCHEMA
from tarmac.session import ensure_checkpoint_dir
from tarmac.sources.flights import conform, from_text


def read_flight_stream(spark: SparkSession, folder: str, schema: StructType | None = None, fmt: str = "parquet",
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of flight rows from files arriving in ``folder`` (declared
    schema: streaming file sources do not infer one)."""
    fields = schema or FLIGHT_SCHEMA
    if fmt == "csv":  # as text, so that the batch reader's rules for cells hold
        fields = StructType([StructField(f.name, StringType()) for f in fields])
    reader = spark.readStream.schema(fields).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(folder)
    return from_text(stream) if fmt == "csv" else conform(stream)


def streaming_totals(stream: DataFrame, keys: list[str], threshold: float = DELAY_THRESHOLD,
                     dimension: DataFrame | None = None) -> DataFrame:
    """Clean the stream, optionally tag events (stream-static join against
    the event dimension), and keep running totals per key."""
    clean = clean_flights(stream, threshold)
    if dimension is not None:
        clean = enrich_events(clean, dimension)
    for k in keys:
        clean = clean.where(F.col(k).isNotNull())
    return clean.groupBy(*keys).agg(*delay_measures())


def start_totals(
    totals: DataFrame,
    sink_dir: str,
    checkpoint_location: str | None = None,
    available_now: bool = True,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Write the complete totals table after every micro-batch, through
    ``foreachBatch``, as a new version under ``sink_dir``; :func:`read_totals`
    reads the latest.

    A version counts once its marker is written, after its data. The version
    before it stays until the next one is complete, so a crash at any point
    leaves a whole table, and a repeated batch overwrites only its own version.
    """
    spark = totals.sparkSession
    if checkpoint_location is None:
        tag = hashlib.sha1(sink_dir.encode()).hexdigest()[:16]
        checkpoint_location = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{tag}"

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{sink_dir}/version-{batch_id}")
        marker = session.range(batch_id, batch_id + 1, 1, 1).toDF("version")
        marker.write.mode("overwrite").parquet(f"{sink_dir}/done/{batch_id}")
        for old in (f"done/{batch_id - 2}", f"version-{batch_id - 2}"):
            path = session._jvm.org.apache.hadoop.fs.Path(f"{sink_dir}/{old}")
            path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)

    writer = totals.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint_location)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def read_totals(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The latest complete table that :func:`start_totals` has written."""
    last = spark.read.schema("version long").parquet(f"{sink_dir}/done/*").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{sink_dir}/version-{last}")


def enriched_stream(stream: DataFrame, dimension: DataFrame, threshold: float = DELAY_THRESHOLD) -> DataFrame:
    """Row-level stream of clean flights with ``event_name`` (append mode)."""
    return enrich_events(clean_flights(stream, threshold), dimension)
