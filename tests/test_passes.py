"""Model steps that take few, cheap passes, against plain ones."""

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tarmac.operators import boosting as B
from tarmac.operators import models as M
from tarmac.operators.minibatch import MiniBatch, quality


def test_quality_of_many_models_at_once(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 0.5, (60, 2)) for m in (0, 3, 7)] + [[[50.0, 50.0]]])
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(x.tolist(), "a double, b double"))
    models = [MiniBatch(["a", "b"], np.array(c, dtype=float), np.zeros(len(c)), 0) for c in (
        [[0, 0], [7, 7]], [[0, 0], [3, 3], [7, 7], [50, 50]], [[0, 0], [3, 3], [900, 900]])]
    for m, (inertia, shape) in zip(models, quality(df.repartition(3), models)):
        found = m.assign(df, distance="d")
        assert abs(inertia - found.agg(F.sum("d")).first()[0]) < 1e-6
        assert abs(shape - M.silhouette(found)) < 1e-9


def test_pass_over_blocks_not_rows(spark):
    df = spark.range(5000).select("id", (F.col("id") % 50).cast("double").alias("a"), (F.col("id") % 7 < 3).cast("int").alias("y"))
    binner = B.fit_bins(df, ["a"], [])
    table = B.binned_table(df, binner, F.col("y"), F.lit(1.0), F.col("id"), [F.lit(True)], ["id"])
    trainer = B._Trainer(table, binner, [B.Boost(rounds=2, min_rows=1)])
    assert trainer.table.count() < 50 and trainer.table.columns == ["data", "raw"]
    scored = B.fit_many(table, binner, [B.Boost(rounds=2, min_rows=1)])[1]
    assert scored.columns == [*table.columns, "raw"] and sorted(r[0] for r in scored.select("id").collect()) == list(range(5000))


def test_leaf_of_many_rows_is_finished_by_one_task():
    rng = np.random.default_rng(4)
    sizes, n = np.array([20, 9, 5]), 3000
    bins = np.stack([rng.integers(0, s, n) for s in sizes], axis=1).astype(np.uint8)
    g, h = np.rint(rng.normal(size=n) * 1e6 + 1e6 * (bins[:, 0] > 9)), np.full(n, 1e6)
    got = B.finish(bins, g, h, 0, sizes, 2, B.Boost(num_leaves=8), np.array([True, True, False]), 1e6)
    paths = {}
    for path, found in got:
        rows = np.ones(n, dtype=bool)
        for i, side in enumerate(path):
            up = paths[path[:i]]
            rows &= np.frombuffer(up["left"], dtype=bool)[bins[:, up["feat"]]] == (side == "0")
        assert (found["n"], found["g"], found["h"]) == (rows.sum(), int(g[rows].sum()), int(h[rows].sum()))
        assert found["feat"] != 2
        paths[path] = found
    assert B.SMALL >= 1 << 20 and len(got) > 8


def test_forest_node_looks_at_no_more_features_than_it_tries(monkeypatch):
    from tarmac.operators import forest as T

    seen = []
    one = T._best_of_feature
    monkeypatch.setattr(T, "_best_of_feature", lambda part, *rest: seen.append(len(part)) or one(part, *rest))
    rng = np.random.default_rng(6)
    hist, sizes = rng.integers(1, 9, (50, 9, 4, 2)).reshape(50, 36, 2), np.full(9, 4)
    hist[:, :, :] = np.tile(hist[:, :4], (1, 9, 1))  # each feature holds the same rows
    feat, _, gain = T.best_splits(hist, sizes, 9, np.arange(50, dtype=np.uint64), T.Forest(), np.ones(2))
    assert sum(seen) == 50 * 3 and (feat != T.LEAF).all() and (gain >= 0).all()


def test_model_of_few_rows_takes_no_pass_for_each_tree(spark, monkeypatch):
    df = spark.range(3000).select("id", (F.col("id") % 50).cast("double").alias("a"), (F.col("id") % 7 < 3).cast("int").alias("y"))
    binner = B.fit_bins(df, ["a"], [])
    table = B.binned_table(df, binner, F.col("y"), F.lit(1.0), F.col("id"), [F.lit(True), F.col("id") < 1000])
    settings = [B.Boost(rounds=3, row_rate=0.7), B.Boost(rounds=2, objective="squared")]
    monkeypatch.setattr(B, "SMALL", 0)
    want = B.fit_many(table, binner, settings)[0]
    monkeypatch.setattr(B, "SMALL", 3000)
    monkeypatch.setattr(B._Trainer, "_pass", None)
    got = B.fit_many(table, binner, settings)[0]
    assert [len(m.trees) for m in got] == [3, 2] and max(len(t.feat) for m in got for t in m.trees) > 3
    for a, b in zip(want, got):
        assert all((getattr(x, c) == getattr(y, c)).all() for x, y in zip(a.trees, b.trees) for c in ("feat", "left", "kids", "value", "gain"))


def test_rows_are_binned_before_they_are_dealt(spark, monkeypatch):
    dealt, frame = [], type(spark.range(1))
    real = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: dealt.append(self.columns) or real(self, *a))
    df = spark.createDataFrame([(i, float(i), "x") for i in range(50)], "id long, a double, c string")
    table = B.binned_table(df, B.fit_bins(df, ["a"], ["c"]), F.col("a"), F.lit(1.0), F.col("id"), [F.lit(True)], ["id"])
    assert dealt == [["bins", "y", "w", "key", "member", "_k0"]] and table.count() == 50
