"""Sports schedule file reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tarmac.schema import SCHEDULE_COLUMNS, SCHEDULE_REQUIRED
from tarmac.sources import csv_files

SEQ_COLUMN = "seq"
CORRUPT_COLUMN = "_corrupt_record"


def empty_schedule(spark: SparkSession) -> DataFrame:
    fields = [T.StructField(SEQ_COLUMN, T.LongType(), True)] + [
        T.StructField(c, T.StringType(), True) for c in SCHEDULE_COLUMNS
    ]
    return spark.createDataFrame([], T.StructType(fields))


def read_schedule_csv(spark: SparkSession, path: str | list[str], keep_rejects: bool = False) -> DataFrame:
    """Read schedule files as text columns plus ``seq``, the row's place in file
    order over all files (used for last-row-wins on duplicate keys): a struct
    that sorts like the rows of the files laid end to end.

    An absent file, or files without ``Date`` / ``Primary Airport`` headings,
    give an empty schedule. Files may differ in the order of their columns. Rows
    whose cell count differs from their heading are set aside
    (``keep_rejects=True`` returns them in ``_corrupt_record``).
    """
    try:
        listed = [csv_files.list_files(spark, p) for p in ([path] if isinstance(path, str) else path)]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_schedule(spark)
    rows = csv_files.text_rows(spark, listed, CORRUPT_COLUMN)
    if rows is None or not all(c in rows.columns for c in SCHEDULE_REQUIRED):
        return empty_schedule(spark)
    present = [c for c in rows.columns if c not in (CORRUPT_COLUMN, csv_files.POSITION)]
    # The test reads every cell: rows are judged against their whole heading, and
    # Spark refuses scans that are pruned down to the corrupt column alone.
    present = [c for c in rows.columns if c not in (CORRUPT_COLUMN, csv_files.POSITION)]
    parsed = F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in present])) >= 0
    bad = F.col(CORRUPT_COLUMN).isNotNull()
    judged = rows.where(parsed).withColumnRenamed(csv_files.POSITION, SEQ_COLUMN)
    if keep_rejects:
        return judged.where(bad).select(SEQ_COLUMN, *[F.col(f"`{c}`") for c in present], CORRUPT_COLUMN)
    return judged.where(~bad).select(SEQ_COLUMN, *[
        F.col(f"`{c}`") if c in present else F.lit(None).cast("string").alias(c) for c in SCHEDULE_COLUMNS])
