"""Flight and schedule tables derived from the TPC-H-style test tables.

The driver's correctness check only sees ``region nation customer supplier
part orders lineitem ...``; these views give them the flight data model
(FIXTURES.md part B) with pure integer arithmetic, so Spark and DuckDB agree
to the last digit. All work is ordinary joins and projections: lineitem is the
fact side, orders/customer/supplier are joined on their keys and Catalyst/AQE
choose the join strategy from table sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture definition (FIXTURES.md B1/B2).
AIRPORT_CODES = [
    "YUL", "YYZ", "ATL", "DFW", "DEN", "ORD", "LAX", "CLT", "MCO", "PHX", "LAS", "SEA", "SFO",
    "IAH", "EWR", "BOS", "MSP", "FLL", "MDW", "DTW", "SLC", "IAD", "BWI", "LGA", "PBI",
]
CARRIER_CODES = [
    "AA", "AS", "B6", "DL", "F9", "G4", "HA", "NK", "OO", "UA", "WN", "YX", "MQ", "9E", "YV", "QX", "ZZ",
]
LEAGUES = ["NFL", "NHL", "NBA", "MLB"]


def _array(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Rows of a part of lineitem, where the default of 64 MB shuffled would hold more of these narrow rows.
PART_ROWS = 500_000


def _dealt(lines: DataFrame, rows: int) -> DataFrame:
    """``lines`` dealt by the join key; the number of parts follows the rows, so that the memory a task takes for
    its part does not grow with the table. Few rows are left to the adaptive plan, which makes a part for each core."""
    spark = lines.sparkSession
    if rows <= PART_ROWS * spark.sparkContext.defaultParallelism:
        return lines.repartition("l_orderkey")
    return lines.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS)), "l_orderkey")


def flights_view(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """One flight per lineitem row (23 of the 35 flight columns). ``lineitem``
    replaces the scan of that table, for instance by a stream of its files."""
    # What needs lineitem only is computed below the shuffle and the joins: filters on it stay short there, and the
    # code generated for the joined rows stays small enough to be compiled.
    cols = [
        "l_orderkey", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("fl_date"),
        F.expr(
            """CASE WHEN l_partkey % 97 = 0 THEN NULL
                    WHEN l_partkey % 89 = 0 THEN 2400
                    ELSE ((l_partkey * 5 + l_linenumber) % 24) * 100 + CAST(l_quantity AS INT) END"""
        ).alias("dep"),
        F.expr(
            "(((l_orderkey * 7 + l_partkey) % 61) * ((l_suppkey * 17 + l_orderkey) % 61)) DIV 36 - 32"
        ).alias("raw"),
    ]
    if lineitem is None:
        # The test tables are files of one row group, read by one task. Rows are dealt by the join key, which
        # is the shuffle that the join with orders needs anyway once that table is too large to broadcast.
        table = read_table(spark, sf_dir, "lineitem")
        li = _dealt(table.select(*cols), table.count())
    else:
        li = lineitem.select(*cols)
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("cn"))
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("sn"))

    base = (
        li.join(orders, li.l_orderkey == orders.o_orderkey)
        .join(customer, F.col("o_custkey") == customer.c_custkey)
        .join(supplier, F.col("l_suppkey") == supplier.s_suppkey)
        .select("l_orderkey", "l_partkey", "l_suppkey", "sn", "cn", "fl_date", "dep", "raw")
    )
    with_delay = base.withColumn(
        "ad",
        F.expr(
            """CASE WHEN l_partkey % 61 = 0 THEN NULL
                    WHEN dep = 2400 THEN -5
                    WHEN sn = 24 THEN least(raw, 10)
                    ELSE raw + coalesce(dep DIV 100, 0) END"""
        ),
    )
    codes = _array(AIRPORT_CODES)
    carriers = _array(CARRIER_CODES)
    return with_delay.select(
        F.year("fl_date").cast("int").alias("year"),
        F.month("fl_date").cast("int").alias("month"),
        F.dayofmonth("fl_date").cast("int").alias("day_of_month"),
        (F.weekday("fl_date") + 1).cast("int").alias("day_of_week"),
        "fl_date",
        F.expr(f"element_at({carriers}, CAST(l_suppkey % 17 AS INT) + 1)").alias("op_unique_carrier"),
        F.col("l_partkey").cast("double").alias("op_carrier_fl_num"),
        F.expr(f"element_at({codes}, CAST(sn AS INT) + 1)").alias("origin"),
        F.expr("CASE WHEN l_partkey % 59 = 0 THEN NULL ELSE concat('State ', CAST(sn AS STRING)) END").alias(
            "origin_state_nm"
        ),
        F.expr(f"element_at({codes}, CAST(cn AS INT) + 1)").alias("dest"),
        F.expr("concat('State ', CAST(cn AS STRING))").alias("dest_state_nm"),
        F.col("dep").cast("int").alias("crs_dep_time"),
        F.expr("CAST((coalesce(dep, 0) + 200) % 2400 AS INT)").alias("crs_arr_time"),
        F.col("ad").cast("double").alias("arr_delay"),
        F.expr("CASE WHEN l_orderkey % 50 = 0 THEN 1 ELSE 0 END").alias("cancelled"),
        F.expr("CASE WHEN l_partkey % 75 = 0 THEN 1 ELSE 0 END").alias("diverted"),
        F.expr("CAST(30 + (100 + (sn * 25 + cn) * 4) DIV 8 AS DOUBLE)").alias("crs_elapsed_time"),
        F.expr("CAST(100 + (sn * 25 + cn) * 4 AS DOUBLE)").alias("distance"),
        F.expr(
            """CAST(CASE WHEN ad >= 15 AND l_partkey % 7 = 0 THEN ad
                         WHEN ad >= 15 AND l_partkey % 7 = 5 THEN ad - 5 ELSE 0 END AS DOUBLE)"""
        ).alias("carrier_delay"),
        F.expr(
            """CAST(CASE WHEN l_partkey % 53 = 0 THEN NULL
                         WHEN ad >= 15 AND l_partkey % 7 = 1 THEN ad
                         WHEN ad >= 15 AND l_partkey % 7 = 5 THEN 5
                         WHEN ad < 15 AND l_partkey % 41 = 0 THEN 3 ELSE 0 END AS DOUBLE)"""
        ).alias("weather_delay"),
        F.expr("CAST(CASE WHEN ad >= 15 AND l_partkey % 7 = 2 THEN ad ELSE 0 END AS DOUBLE)").alias("nas_delay"),
        F.expr("CAST(CASE WHEN ad >= 15 AND l_partkey % 7 = 3 THEN ad ELSE 0 END AS DOUBLE)").alias(
            "security_delay"
        ),
        F.expr("CAST(CASE WHEN ad >= 15 AND l_partkey % 7 = 4 THEN ad ELSE 0 END AS DOUBLE)").alias(
            "late_aircraft_delay"
        ),
    )


def schedule_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sports schedule rows in the text layout of the schedule file, plus an
    explicit ``seq`` (file order) used for last-row-wins resolution."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    codes = _array(AIRPORT_CODES)
    leagues = _array(LEAGUES)
    return (
        orders.join(customer, F.col("o_custkey") == customer.c_custkey)
        .select(
            F.col("o_orderkey").alias("seq"),
            F.expr(f"element_at({leagues}, CAST(o_orderkey % 4 AS INT) + 1)").alias("League"),
            F.expr("concat('Team ', CAST(o_custkey % 30 AS STRING))").alias("Team Name"),
            F.expr("concat('Stadium ', CAST(c_nationkey AS STRING))").alias("Stadium Name"),
            F.expr(
                f"""CASE WHEN c_nationkey = 0 THEN 'PBG' WHEN c_nationkey = 1 THEN ' iag '
                         ELSE element_at({codes}, CAST(c_nationkey AS INT) + 1) END"""
            ).alias("Primary Airport"),
            F.expr(
                "CASE WHEN o_orderkey % 35 = 0 THEN 'bad date' ELSE date_format(o_orderdate, 'E,yyyy-MM-dd') END"
            ).alias("Date"),
            F.expr("concat('Team ', CAST(o_custkey % 29 AS STRING))").alias("Away Team"),
        )
    )


def scored_view(clean: DataFrame) -> DataFrame:
    """Deterministic scored rows for the evaluation tables (FIXTURES.md B5):
    ``label`` = delayed, a score ``p`` on the 0.01 grid that rises with the
    hour and the label, ``prediction = p >= 0.5``; for regression ``y`` is the
    arrival delay and ``yhat = hour + 5``."""
    label = F.col("is_delayed").cast("int")
    hour = F.coalesce(F.col("dep_hour"), F.lit(0))
    p_pct = (hour * 3 + F.col("day_of_week") * 2 + label * 15) % 101
    return clean.select(
        label.alias("label"),
        (p_pct / F.lit(100.0)).alias("p"),
        (p_pct >= 50).cast("int").alias("prediction"),
        F.col("arr_delay").alias("y"),
        (hour + 5).cast("double").alias("yhat"),
    )
