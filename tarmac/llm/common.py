"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.session import ensure_checkpoint_dir

# A row of a text table is known inside the operators by its id and by a hash
# of its text. Rows that agree in both are the same document listed twice and
# get the same answer; rows that share an id but not the text stay apart.
KEY = ["__id", "__tk"]
#: Bytes of an Arrow batch sent to Python at a time, about (``small_batches``).
ARROW_BYTES_CONF, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def with_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Add the document key ``__id`` (null stays null) and ``__tk``."""
    return df.withColumns({"__id": F.col(quoted(id_col)), "__tk": text_hash(F.col(quoted(text_col)))})


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_hash(text: Column) -> Column:
    """64-bit hash of a text; a null text hashes apart from the empty one."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text))


def join_on_key(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on the document key; null ids match each other."""
    r = right.withColumnsRenamed({c: f"__r{c}" for c in KEY})
    cond = (left["__tk"] == r["__r__tk"]) & left["__id"].eqNullSafe(r["__r__id"])
    out = left.join(r, cond, how)
    return out.drop(*[f"__r{c}" for c in KEY])


def shielded(docs: DataFrame, *others: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns of a leading double underscore, the operators'
    own kind of name, and ``others`` under generated names, and the map of old
    names to new."""
    names = {c: f"kept_{i}_{uuid.uuid4().hex}" for i, c in enumerate(docs.columns) if c.startswith("__") or c in others}
    return (docs.withColumnsRenamed(names) if names else docs), names


def unshielded(out: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of ``shielded`` under their own names again."""
    return out.withColumnsRenamed({new: old for old, new in names.items()}) if names else out


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch to ``ARROW_BYTES``
    (a lower one stays). A batch of whole texts stands outside the heap several
    times over, on both sides of the pipe, so it should not grow with the texts.
    Only the cut of rows into batches changes."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(ARROW_BYTES_CONF)) > ARROW_BYTES:
        spark.conf.set(ARROW_BYTES_CONF, str(ARROW_BYTES))


def byte_slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``limit`` bytes of one text or binary column
    (a longer value is a slice of its own), so that what is made of it stays small."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(at, end - at)
        at, before = end, int(total[end - 1])


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the cluster's shared checkpoint folder and
    read it back, which cuts the lineage: later stages restart from the files
    when executors are lost. The files go when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
