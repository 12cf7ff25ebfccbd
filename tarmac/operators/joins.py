"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.session import run_folder

# A table of at most this many bytes (as written, compressed) is shipped to
# every executor; unpacked it is a few times as large. Beyond it the join is a
# shuffle join, where AQE splits skewed partitions.
BROADCAST_MAX_BYTES = 32 << 20


def stored(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``df`` written once to the shared folder, and the bytes it takes there."""
    spark, path = df.sparkSession, run_folder(df.sparkSession, label)
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    return spark.read.schema(df.schema).parquet(path), int(size)


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> tuple[DataFrame, bool]:
    """Return ``(df with a broadcast hint, True)`` when the written table has at
    most ``max_bytes`` bytes; otherwise ``(df, False)`` so the optimizer plans a
    shuffle join. The table is computed once, and the join reads what was written."""
    table, size = stored(df, "dimension")
    if size <= max_bytes:
        return F.broadcast(table), True
    return table, False
