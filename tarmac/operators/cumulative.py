"""Running totals over a sorted key without a single-partition window.

A window with ``ORDER BY`` and no ``PARTITION BY`` moves the whole table into
one task. For a table whose size grows with the data (for example one row
per distinct model score), this helper instead:

1. range-partitions the rows by the key into ``n`` buckets of about
   ``rows_per_bucket`` rows each and writes them to the checkpoint folder;
2. sums each bucket (``n`` rows) and turns those sums into bucket offsets with
   a window over the ``n``-row table;
3. runs the running sum inside each bucket (``PARTITION BY bucket``), adds the
   bucket's offset (a broadcast join against the ``n``-row offsets table).

The bucket count follows the data, so memory per task stays near
``rows_per_bucket`` however large the input grows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.session import ensure_checkpoint_dir

ROWS_PER_BUCKET = 1_000_000


def running_totals(
    df: DataFrame,
    key: str,
    value_cols: list[str],
    rows_per_bucket: int = ROWS_PER_BUCKET,
    prefix: str = "cum_",
    checkpoint: bool = True,
) -> DataFrame:
    """Add ``cum_<col>``: the sum of ``col`` over all rows with key <= this
    row's key (ascending, inclusive). ``key`` must be unique per row (reduce
    with a group-by first) and non-NULL."""
    if checkpoint:
        # The input is usually a reduction of an expensive plan (scoring);
        # it is read several times below, so materialise it once in the shared
        # checkpoint folder, which also cuts its lineage.
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
    n_rows = df.count()
    n_buckets = max(1, math.ceil(n_rows / max(1, rows_per_bucket)))
    if n_buckets > 1:
        ensure_checkpoint_dir(df.sparkSession)
        # Range bounds come from a sample, so the dealt rows are written once:
        # a recomputed task must not meet other bounds.
        bucketed = df.repartitionByRange(n_buckets, key).withColumn("_bucket", F.spark_partition_id()).checkpoint()
    else:
        bucketed = df.withColumn("_bucket", F.lit(0))

    sums = bucketed.groupBy("_bucket").agg(*[F.sum(c).alias(f"_s_{c}") for c in value_cols])
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_bucket", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in value_cols]
    )
    inside = Window.partitionBy("_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    local = bucketed.select(
        "*", *[F.sum(c).over(inside).alias(f"_l_{c}") for c in value_cols]
    )
    # offsets has one row per bucket, a millionth of the rows.
    joined = local.join(F.broadcast(offsets), "_bucket")
    return joined.select(
        *[c for c in df.columns],
        *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"{prefix}{c}") for c in value_cols],
    )
