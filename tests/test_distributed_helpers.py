"""Partition invariance of the seeded split/subsample and the bucketed
running totals against a brute-force prefix sum."""

import random

from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from tarmac.operators.cumulative import running_totals
from tarmac.operators.evaluate import roc_auc
from tarmac.operators.features import hash_unit, stratified_split, subsample
from tarmac.plans.catalog import load_clean


def _key_cols(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_split_is_partition_independent(spark):
    clean = load_clean(spark, SF_MID).select("fl_date", "origin", "dest", "crs_dep_time", "arr_delay",
                                                "op_carrier_fl_num", "is_delayed")
    a = stratified_split(clean.repartition(3), "is_delayed", 0.2, 42).where("is_test").drop("is_test")
    b = stratified_split(clean.repartition(17), "is_delayed", 0.2, 42).where("is_test").drop("is_test")
    assert _key_cols(a) == _key_cols(b)
    per_class = {r["is_delayed"]: r for r in stratified_split(clean, "is_delayed", 0.2, 42)
                 .groupBy("is_delayed").agg(F.avg(F.col("is_test").cast("double")).alias("f")).collect()}
    for r in per_class.values():
        assert abs(r["f"] - 0.2) < 0.001


def test_subsample_is_partition_independent(spark):
    clean = load_clean(spark, SF_SMALL).select("fl_date", "origin", "dest", "crs_dep_time", "arr_delay")
    a = subsample(clean.repartition(2), 500, 7)
    b = subsample(clean.repartition(11), 500, 7)
    assert a.count() == 500
    assert _key_cols(a) == _key_cols(b)
    assert subsample(clean, 10**9, 7).count() == clean.count()


def test_running_totals_many_buckets(spark):
    rnd = random.Random(5)
    keys = rnd.sample(range(100000), 3000)
    rows = [(float(k) / 7.0, rnd.randint(0, 5), rnd.randint(0, 3)) for k in keys]
    df = spark.createDataFrame(rows, "score double, pos long, neg long")
    out = running_totals(df, "score", ["pos", "neg"], rows_per_bucket=100)
    got = {r["score"]: (r["cum_pos"], r["cum_neg"]) for r in out.collect()}
    acc_p = acc_n = 0
    for s, p, n in sorted(rows):
        acc_p += p
        acc_n += n
        assert got[s] == (acc_p, acc_n)


def test_auc_bucket_count_does_not_change_result(spark):
    rnd = random.Random(9)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 3)) for _ in range(5000)]
    df = spark.createDataFrame(rows, "label int, p double")
    one = roc_auc(df, rows_per_bucket=10**9).first()["auc"]
    many = roc_auc(df, rows_per_bucket=50).first()["auc"]
    assert one == many


def test_sample_delays_is_partition_independent(spark):
    from tarmac.operators.reports import sample_delays

    clean = load_clean(spark, SF_MID)
    a = sample_delays(clean.repartition(3)).collect()
    b = sample_delays(clean.repartition(29)).collect()
    assert a == b and len(a) == 10


def test_repeated_rows_are_split_and_sampled_one_by_one(spark):
    from tarmac.operators.features import COPIES, with_row_key

    rows = spark.range(3 * COPIES).select((F.col("id") % 3).cast("int").alias("label"), F.lit(None).cast("int").alias("x"))
    keyed = with_row_key(rows.where("label < 2 OR id < 30"))
    assert keyed.count() == 2 * COPIES + 10 == keyed.select("_row_key").distinct().count()
    split = stratified_split(keyed, "label", 0.2, 42, key_cols=["_row_key"])
    share = {r["label"]: r["f"] for r in split.groupBy("label").agg(F.avg(F.col("is_test").cast("double")).alias("f")).collect()}
    assert abs(share[0] - 0.2) < 0.001 and abs(share[1] - 0.2) < 0.001
    for keys in (None, ["_row_key"]):
        assert subsample(keyed, 5000, 3, key_cols=keys).count() == 5000
    # Without a key all copies share one bucket: the top-n of that bucket still fills the sample.
    assert subsample(rows.where("label = 0"), 5000, 3).count() == 5000


def test_row_key_numbers_more_copies_than_a_chunk_and_empty_input(spark):
    from tarmac.operators.features import COPIES, with_row_key

    same = spark.range(2 * COPIES + 7).select(F.lit("a").alias("v"))
    keyed = with_row_key(same)
    assert keyed.count() == 2 * COPIES + 7 == keyed.select("_row_key").distinct().count()
    assert with_row_key(same.limit(0)).count() == 0


def test_medians_by_selection(spark):
    """Equal to the aggregate over random doubles, heavy values and odd scales."""
    import numpy as np

    from tarmac.operators.features import column_medians

    gen = np.random.default_rng(8)
    n = 30_001
    cols = {
        "a": gen.normal(size=n), "b": np.exp(gen.normal(scale=60, size=n)), "c": gen.integers(0, 2, n).astype(float),
        "d": np.where(np.arange(n) < n // 2, -1e300, gen.random(n)), "e": np.full(n, 7.5), "g": np.round(gen.normal(size=n), 1),
    }
    rows = [tuple(float(x) for x in r) for r in zip(*cols.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(6)
    df = df.withColumn("f", F.when(F.col("a") > 0, F.col("a"))).withColumn("z", F.lit(None).cast("double"))
    df = df.withColumn("w", F.when(F.col("a") > 1, float("nan")).otherwise(F.col("b"))).withColumn("i", F.floor(F.col("a") * 10).cast("int"))
    names = [*cols, "f", "z", "w", "i"]
    for data in (df, df.where("a < 0.5 OR b > 1").limit(20_000)):
        data = data.orderBy("a").cache()
        clean = [F.median(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))).alias(c) for c in names]
        want = data.agg(*clean).first().asDict()
        for most in (50, 4096):
            assert column_medians(data, names, most=most) == want
        data.unpersist()
    assert column_medians(df.limit(0), ["a"]) == {"a": None}


def test_subsample_reads_its_input_once(spark, tmp_dir):
    """What follows reads the rows taken, not the input; rows of one hash are too few at first."""
    spark.range(4000).selectExpr("id", "id % 7 AS a").write.parquet(f"{tmp_dir}/rows")
    df = spark.read.parquet(f"{tmp_dir}/rows")
    got = subsample(df, 700, 5)
    assert not set(got.inputFiles()) & set(df.inputFiles())
    unit = df.withColumn("u", hash_unit(df, df.columns, 5)).orderBy("u").limit(700)
    assert {r["id"] for r in got.collect()} == {r["id"] for r in unit.collect()}
    same = spark.createDataFrame([(1,)] * 50 + [(2,)] * 50, "a long")
    assert subsample(same, 60, 5).count() == 60
