"""Flight file readers and the column profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.schema import FLIGHT_COLUMNS, FLIGHT_SCHEMA
from tarmac.sources import csv_files

# Text cells read as missing.
NULL_TOKENS = ("", "NA", "NaN")


def _coerce(name: str, dtype: T.DataType) -> Column:
    """Text cell to the declared type: null tokens and unparseable text give
    NULL (``try_cast``); a parsed NaN is also mapped to NULL."""
    raw = F.trim(F.col(name))
    cell = F.when(~raw.isin(*NULL_TOKENS), raw)
    if isinstance(dtype, T.StringType):
        return cell.alias(name)
    if isinstance(dtype, T.DateType):
        return F.to_date(F.try_to_timestamp(cell)).alias(name)
    if isinstance(dtype, T.IntegerType):
        # Integer columns are sometimes written as "1252.0".
        as_double = F.expr(f"try_cast(`{name}` AS DOUBLE)")
        parsed = F.when(F.trim(F.col(name)).isin(*NULL_TOKENS), None).otherwise(as_double)
        return F.when(~F.isnan(parsed), parsed.try_cast("int")).alias(name)
    parsed = F.when(F.trim(F.col(name)).isin(*NULL_TOKENS), None).otherwise(
        F.expr(f"try_cast(`{name}` AS {dtype.simpleString()})")
    )
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        parsed = F.when(~F.isnan(parsed), parsed)
    return parsed.alias(name)


def read_flights_csv(
    spark: SparkSession,
    path: str | list[str],
    columns: list[str] | None = None,
    limit: int | None = None,
    with_position: bool = False,
) -> DataFrame:
    """Read flight CSV files with a header.

    Every cell is read as text and converted with ``try_cast`` so that bad
    numbers become NULL instead of failing the job. Files may differ in their
    columns and in the order of them: cells go by their file's own heading, and
    a column that a file lacks is NULL there. ``columns`` prunes the projection
    (only those columns are parsed); ``limit`` keeps the first n rows in file
    order (the reference's quick-run row cap); ``with_position`` adds the
    sortable place of each row. A missing path raises Spark's
    ``PATH_NOT_FOUND`` analysis error.
    """
    wanted = columns or [n for n, _ in FLIGHT_COLUMNS]
    types = dict(FLIGHT_COLUMNS)
    listed = [csv_files.list_files(spark, p) for p in ([path] if isinstance(path, str) else path)]
    raw = csv_files.text_rows(spark, listed) if limit is None else csv_files.first_rows(spark, listed, limit)
    if raw is None:
        fields = [T.StructField(c, types[c]) for c in wanted]
        return spark.createDataFrame([], T.StructType(fields))
    place = [csv_files.POSITION] if with_position else []
    return raw.select(*[
        _coerce(n, types[n]) if n in raw.columns else F.lit(None).cast(types[n]).alias(n) for n in wanted
    ], *place)


def read_flights_parquet(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Read flight parquet and conform it to the declared column types."""
    df = spark.read.parquet(*(path if isinstance(path, list) else [path]))
    types = dict(FLIGHT_COLUMNS)
    wanted = columns or [c for c in df.columns if c in types]
    return conform(df).select(*[c if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in wanted])


def conform(df: DataFrame) -> DataFrame:
    """Known flight columns with their declared types, NaN and values that do
    not fit as NULL; other columns as they are."""
    types = dict(FLIGHT_COLUMNS)

    def cell(c: str) -> Column:
        value = F.col(c)
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
        return (value.try_cast(types[c]) if c in types else value).alias(c)

    return df.select(*[cell(c) for c in df.columns])


def from_text(df: DataFrame) -> DataFrame:
    """Text columns of flight files with their declared types (``_coerce``)."""
    types = dict(FLIGHT_COLUMNS)
    return df.select(*[_coerce(c, types[c]) if c in types else F.col(c) for c in df.columns])


def column_profile(df: DataFrame, digits: int = 4) -> DataFrame:
    """Per column: declared type, percent of NULL cells, min and max as text.

    One aggregation pass builds a single wide row (three partial aggregates
    per column), which ``stack`` turns into one row per column.
    """
    cols = df.columns
    aggs = []
    for c in cols:
        aggs += [
            F.count_if(F.col(c).isNull()).alias(f"n__{c}"),
            F.min(c).cast("string").alias(f"lo__{c}"),
            F.max(c).cast("string").alias(f"hi__{c}"),
        ]
    aggs.append(F.count(F.lit(1)).alias("__rows"))
    wide = df.agg(*aggs)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    stack_args = ", ".join(
        f"'{c}', '{types[c]}', CAST(`n__{c}` AS BIGINT), `lo__{c}`, `hi__{c}`" for c in cols
    )
    long = wide.selectExpr(
        "__rows", f"stack({len(cols)}, {stack_args}) AS (column_name, dtype, null_cells, min_value, max_value)"
    )
    return long.select(
        "column_name",
        "dtype",
        "null_cells",
        F.round(F.try_divide(F.col("null_cells") * 100.0, F.col("__rows")).cast("double"), digits).alias(
            "null_pct"
        ),
        "min_value",
        "max_value",
    )


__all__ = ["FLIGHT_SCHEMA", "read_flights_csv", "read_flights_parquet", "conform", "column_profile"]
