"""CSV files with headings: several headings side by side, and file order.

Spark reads the files of one call with one schema and no order. Here files are
grouped by their heading line and every group is read with its own schema; the
groups are put together by column name. A row's place is ``POSITION``: the
number of the path it was listed under, the file, the byte at which its split
starts and its number in the task that read it. Splits of a file never share
their first byte and a split is read by one task from front to back, so the
places sort like the rows of the files laid end to end (files by name).
"""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSITION = "_position"
#: Heading lines fetched at a time (the driver's file metadata, like a listing).
FETCH = 32


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Files under a path or pattern, by name. A missing path is Spark's error."""
    return sorted(unquote(f) for f in spark.read.text(path).inputFiles())


def first_line(spark: SparkSession, file: str) -> str | None:
    """First line of a (possibly compressed) file; none if it is empty."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(file)
    stream = at.getFileSystem(conf).open(at)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
        plain = codec.createInputStream(stream) if codec is not None else stream
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine()
    finally:
        stream.close()


def heading(line: str | None) -> tuple[str, ...]:
    cells = next(csv.reader([line.lstrip("﻿")]), []) if line else []
    return tuple(c.strip() for c in cells)


def heading_groups(spark: SparkSession, files: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by their heading; empty files are left out. A heading that names a
    column twice is an error."""
    with ThreadPoolExecutor(FETCH) as pool:
        lines = list(pool.map(lambda f: first_line(spark, f), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, line in zip(files, lines):
        if names := heading(line):
            if len(set(names)) < len(names):
                raise ValueError(f"heading with a repeated column: {file}")
            groups.setdefault(names, []).append(file)
    return groups


def text_rows(spark: SparkSession, listed: list[list[str]], corrupt: str | None = None) -> DataFrame | None:
    """All cells as text, columns by name, and ``POSITION``. ``listed`` holds the
    files of each path; ``corrupt`` names a column for rows whose cells do not
    fit the heading. None if no file has a heading."""
    out = None
    for number, files in enumerate(listed):
        for names, group in heading_groups(spark, files).items():
            extra = [corrupt] if corrupt else []
            schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, *extra]])
            reader = spark.read.option("header", True).option("mode", "PERMISSIVE").schema(schema)
            if corrupt:
                reader = reader.option("columnNameOfCorruptRecord", corrupt)
            place = F.struct(F.lit(number).alias("path"), F.col("_metadata.file_path").alias("file"),
                             F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
            rows = reader.csv(group).select(*[F.col(f"`{c}`") for c in schema.names], place.alias(POSITION))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def split_sizes(rows: DataFrame) -> DataFrame:
    """Rows of every split, its first row number, and the rows before it in file
    order. There is one row for each split, as in a file listing."""
    some = next(c for c in rows.columns if c != POSITION)
    key = [F.col(f"{POSITION}.{c}").alias(c) for c in ("path", "file", "split")]
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(f"{POSITION}.row").alias("first"),
                                   F.max(f"`{some}`").alias("_read"))  # a column, so that cells are parsed as in the real read
    before = Window.orderBy("path", "file", "split").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.drop("_read").withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def first_rows(spark: SparkSession, listed: list[list[str]], n: int, corrupt: str | None = None) -> DataFrame | None:
    """``text_rows`` of the first ``n`` rows in file order. Files are taken from
    the front, twice as many each time, until they hold ``n`` rows; of those the
    splits' counts tell which splits are taken whole and where the last is cut."""
    flat = [(p, f) for p, files in enumerate(listed) for f in files]
    take = 1
    while True:
        some = [[f for q, f in flat[:take] if q == p] for p in range(len(listed))]
        rows = text_rows(spark, some, corrupt)
        if rows is not None:
            sizes = split_sizes(rows).where(F.col("before") < n).collect()
            if take >= len(flat) or sum(r["n"] for r in sizes) >= n:
                break
        elif take >= len(flat):
            return None
        take *= 2
    wanted = spark.createDataFrame([(r["path"], r["file"], r["split"], r["first"] + min(r["n"], n - r["before"])) for r in sizes],
                                   "_p int, _f string, _s long, _end long")
    at = F.col(POSITION)
    same = (at["path"] == F.col("_p")) & (at["file"] == F.col("_f")) & (at["split"] == F.col("_s")) & (at["row"] < F.col("_end"))
    return rows.join(F.broadcast(wanted), same, "left_semi")

