"""Work that passes over the rows: done once, in parts that follow the rows, in code that is compiled."""

import re

from pyspark.sql import functions as F

from tarmac.operators.features import stratified_folds, with_row_key
from tarmac.plans.modeling import baseline_rows, materialize
from tarmac.sources import testview as V

#: A generated method of more bytecode is interpreted by the JVM, many times slower.
COMPILED = 8000


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def fixture(spark, path):
    spark.range(40).selectExpr(
        "id % 10 l_orderkey", "id l_partkey", "id % 3 l_suppkey", "cast(id % 7 as int) l_linenumber",
        "cast(id as double) l_quantity", "date '1996-01-01' + cast(id as int) l_shipdate").write.parquet(f"{path}/lineitem.parquet")
    spark.range(10).selectExpr("id o_orderkey", "id % 4 o_custkey", "date '1996-01-01' o_orderdate").write.parquet(f"{path}/orders.parquet")
    spark.range(4).selectExpr("id c_custkey", "cast(id as int) c_nationkey").write.parquet(f"{path}/customer.parquet")
    spark.range(3).selectExpr("id s_suppkey", "cast(id as int) s_nationkey").write.parquet(f"{path}/supplier.parquet")
    return path


def test_row_keys_are_made_once(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "a int, b string")
    keyed = with_row_key(rows)
    assert "Aggregate" not in plan(keyed) and "md5" not in plan(keyed)
    assert plan(stratified_folds(keyed.withColumn("y", F.lit(1)), "y", 3, 1, ["_row_key"])).count("md5") < 4
    assert keyed.select("_row_key").distinct().count() == 3
    assert sorted((r["a"], r["b"]) for r in keyed.drop("_row_key").collect() if r["b"]) == [(1, "a"), (1, "a")]


def test_materialized_rows_are_columns(spark):
    rows = materialize(spark.range(5).withColumn("x", F.col("id") * 2))
    assert "parquet" in plan(rows).lower() and "ReadSchema: struct<x:bigint>" in rows.select("x")._jdf.queryExecution().toString()
    assert sorted(r["x"] for r in rows.collect()) == [0, 2, 4, 6, 8]


def test_parts_follow_the_rows(spark):
    lines, cores = spark.range(100).withColumnRenamed("id", "l_orderkey"), spark.sparkContext.defaultParallelism
    many = V.PART_ROWS * (cores + 40)
    assert V._dealt(lines, many).rdd.getNumPartitions() == max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores + 40)
    assert "RepartitionByExpression [l_orderkey" in plan(V._dealt(lines, 100))
    assert sorted(r[0] for r in V._dealt(lines, many).collect()) == list(range(100))


def test_code_of_the_flight_rows_is_compiled(spark, tmp_dir):
    df = baseline_rows(V.flights_view(spark, fixture(spark, tmp_dir)))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = df.select("*")._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < COMPILED
