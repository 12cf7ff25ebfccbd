"""Leaf-wise boosting against one split after the other over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.operators import boosting as B
from tarmac.operators.features import stratified_folds

rng = np.random.default_rng(4)
N = 400
X = np.stack([rng.integers(0, 9, N), rng.normal(size=N).round(2), rng.integers(0, 4, N)], axis=1)
CAT = np.array(["red", "green", "blue", "grey", "rare"])[rng.choice(5, N, p=[.3, .3, .2, .19, .01])]
SIGNAL = 0.4 * X[:, 0] - 1.5 * (X[:, 1] > 0.3) * (X[:, 2] == 2) + np.where(CAT == "blue", 1.5, 0) - 1.5
Y = (rng.random(N) < 1 / (1 + np.exp(-SIGNAL))).astype(int)
W = np.where(Y == 1, 1.5, 0.75)


def frame(spark, parts=3):
    rows = [(i, float(a), float(b), float(c), str(k), int(y), float(w))
            for i, (a, b, c), k, y, w in zip(range(N), X.tolist(), CAT, Y, W)]
    rows[5] = (5, None, float("nan"), *rows[5][3:])
    return spark.createDataFrame(rows, "id long, a double, b double, c double, k string, y int, w double").repartition(parts)


def straight(bins, sizes, y, w, s, cats):
    """Best-first trees, one split at a time, on float sums."""
    raw = np.full(len(y), math.log((w * y).sum() / (w * (1 - y)).sum()))
    trees = []
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = w * (p - y), w * p * (1 - p)

        def best(rows):
            found = (0.0, None)
            for f in range(bins.shape[1]):
                b = bins[rows, f]
                level = range(int(sizes[f]))
                if f >= cats:
                    level = sorted(level, key=lambda v: (g[rows][b == v].sum() / (h[rows][b == v].sum() + 10), v))
                goes = []
                for v in list(level)[:-1]:
                    goes.append(v)
                    on = np.isin(b, goes)
                    lo, hi = rows[on], rows[~on]
                    if min(len(lo), len(hi)) < s.min_rows:
                        continue
                    gain = g[lo].sum() ** 2 / h[lo].sum() + g[hi].sum() ** 2 / h[hi].sum() - g[rows].sum() ** 2 / h[rows].sum()
                    if gain > found[0] + 1e-6:
                        found = (gain, (f, lo, hi))
            return found

        leaves = [(np.arange(len(y)), 0)]
        splits = []
        while len(leaves) < s.num_leaves:
            offers = [(best(r)[0], -i) if d < s.max_depth and len(r) >= 2 * s.min_rows else (0.0, -i) for i, (r, d) in enumerate(leaves)]
            gain, i = max(offers)
            if gain <= 0:
                break
            rows, d = leaves.pop(-i)
            _, (f, lo, hi) = best(rows)
            splits.append((f, round(gain, 3)))
            leaves += [(lo, d + 1), (hi, d + 1)]
        for rows, _ in leaves:
            raw[rows] -= s.rate * g[rows].sum() / h[rows].sum()
        trees.append(sorted(splits))
    return trees, raw


@pytest.mark.parametrize("leaves,depth,small", [(6, 8, 0), (31, 3, 150), (9, 8, 1000)])
def test_trees_equal_one_split_after_the_other(spark, monkeypatch, leaves, depth, small):
    """With histograms only, with small leaves finished in place, and whole trees so."""
    monkeypatch.setattr(B, "PENDING", 2)
    monkeypatch.setattr(B, "SMALL", small)
    df = frame(spark)
    binner = B.fit_bins(df, ["a", "b", "c"], ["k"], 16)
    assert binner.categories["k"]["rare"] == 5 and binner.sizes[3] == 6
    s = B.Boost(rounds=3, rate=0.3, max_depth=depth, num_leaves=leaves, min_rows=10)
    half = F.col("id") % 2 == 0
    table = B.binned_table(df, binner, F.col("y"), F.col("w"), F.col("id"), [F.lit(True), half], ["id"])
    models, scored = B.fit_many(table, binner, [s, s])
    rows = {r["id"]: r for r in scored.collect()}
    bins = np.array([list(rows[i]["bins"]) for i in range(N)])
    assert bins[5, 0] == 0 and bins[5, 1] == 0
    for m, mine in enumerate((np.arange(N), np.arange(0, N, 2))):
        trees, raw = straight(bins[mine], binner.sizes, Y[mine], W[mine], s, 3)
        got = [sorted((int(f), round(float(g), 3)) for f, g in zip(t.feat, t.gain) if f >= 0) for t in models[m].trees]
        assert got == trees
        assert max(len(t) for t in trees) <= leaves - 1 and any(trees)
        assert np.allclose([rows[int(i)]["raw"][m] for i in mine], raw, atol=1e-4)
    own = {r["id"]: r["raw"] for r in models[0].score(df, ["id"]).collect()}
    assert np.allclose([own[i] for i in range(N)], [rows[i]["raw"][0] for i in range(N)])
    walked = {n: 0 for n in binner.names}
    for t in models[0].trees:
        for f in t.feat[t.feat >= 0]:
            walked[binner.names[f]] += 1
    assert {n: c for n, (c, _) in models[0].importances().items()} == walked and sum(walked.values()) > 0


def test_models_do_not_depend_on_partitions(spark):
    s = B.Boost(rounds=3, num_leaves=8, min_rows=5, row_rate=0.7, col_rate=0.7)
    seen = []
    for parts in (1, 7):
        df = frame(spark, parts)
        binner = B.Binner({"a": np.arange(8.0), "b": np.array([-1, 0, 0.3, 1]), "c": np.arange(3.0)}, {"k": {"red": 1, "blue": 2}})
        table = B.binned_table(df, binner, F.col("y"), F.col("w"), F.col("id"), [F.lit(True)], ["id"]).repartition(parts)
        scored = B.fit_many(table, binner, [s])[1]
        seen.append({r["id"]: r["raw"][0] for r in scored.collect()})
    assert seen[0] == seen[1]


def test_squared_objective_and_edges(spark):
    df = frame(spark).withColumn("z", F.coalesce("a", F.lit(0.0)) * 3 + F.when(F.col("k") == "blue", 40.0).otherwise(0.0))
    binner = B.fit_bins(df, ["a", "b"], ["k"])
    table = B.binned_table(df, binner, F.col("z"), F.lit(1.0), F.col("id"), [F.lit(True), F.lit(None).cast("boolean")])
    (model, idle), _ = B.fit_many(table, binner, [B.Boost(rounds=8, rate=0.6, objective="squared", min_rows=3)] * 2)
    got = model.score(df, ["z"]).agg(F.avg(F.abs(F.col("z") - F.col("prediction")))).first()[0]
    assert got < 3.0
    assert all(len(t.feat) == 1 and t.value[0] == 0 for t in idle.trees)  # no training rows
    assert model.score(df.limit(0), ["z"]).count() == 0
    with pytest.raises(ValueError):
        B.fit_bins(df, ["a"], [], 1000)


def test_folds_differ_by_at_most_one_row(spark):
    rows = [(i, "x", i % 7 == 0) for i in range(1000)] + [(1, "x", None)] * 50
    df = spark.createDataFrame(rows, "id long, t string, y boolean").repartition(5)
    got = stratified_folds(df, "y", 3, 9)
    assert got.columns == ["id", "t", "y", "fold"] and got.count() == len(rows)
    for label in (True, False, None):
        n = [r["count"] for r in got.filter(F.col("y").eqNullSafe(F.lit(label))).groupBy("fold").count().collect()]
        assert len(n) == 3 and max(n) - min(n) <= 1
    again = stratified_folds(df.repartition(2), "y", 3, 9).filter("id > 1")
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in got.filter("id > 1").collect()}
