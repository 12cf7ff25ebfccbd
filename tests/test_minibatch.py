"""Mini-batch k-means against the same batches in numpy."""

import numpy as np
from pyspark.sql import functions as F

from tarmac.operators import minibatch as K

rng = np.random.default_rng(2)
MEANS = np.array([[0, 0], [6, 0], [0, 6]])
X = np.concatenate([rng.normal(m, 0.6, size=(300, 2)) for m in MEANS])
COLS = ["a", "b"]


def frame(spark, parts=3):
    rows = [(i * 31, float(a), float(b)) for i, (a, b) in enumerate(X)]
    return spark.createDataFrame(rows, "key long, a double, b double").repartition(parts)


def test_steps_equal_numpy(spark):
    df = frame(spark)
    table, n, a_round = K.batches(df, COLS, "key", 7, 100, 20)
    assert (n, a_round) == (900, 9)
    drawn = table.toPandas()
    per_round = drawn.assign(r=drawn["step"] // 9).groupby(["r", "_key"]).size()
    assert set(drawn["step"]) <= set(range(20)) and per_round.max() == 1  # a row is in one batch of a round
    assert (drawn[drawn["step"] < 18].groupby("_key").size() == 2).all() and drawn["_key"].nunique() == 900
    first = table.where("step < 3")
    options = K.plus_plus(first, COLS, [3], 4, 7)[0]
    pts = drawn[drawn["step"] < 3][COLS].to_numpy()
    far = lambda x, c: ((x[:, None] - c) ** 2).sum(axis=2)
    assert all((far(np.concatenate(o[None]), pts).min(axis=1) < 1e-20).all() for o in options)  # centres are rows
    centres = min(options, key=lambda o: far(pts, o).min(axis=1).sum()).copy()
    counts = np.zeros(3)
    for step in range(20):
        x = drawn[drawn["step"] == step][COLS].to_numpy()
        c = far(x, centres).argmin(axis=1)
        for j in range(3):
            m = (c == j).sum()
            if m:
                centres[j] = (centres[j] * counts[j] + x[c == j].sum(axis=0)) / (counts[j] + m)
                counts[j] += m
    model = K.fit(df, COLS, "key", 3, seed=7, batch=100, steps=20, starts=4, patience=99)
    assert model.steps == 20 and np.allclose(model.centres, centres, atol=1e-9) and (model.counts == counts).all()
    assert K.fit(frame(spark, 8), COLS, "key", 3, seed=7, batch=100, steps=20, starts=4, patience=99).centres.tolist() == model.centres.tolist()
    both = K.fit_many(df, COLS, "key", [2, 3], seed=7, batch=100, steps=20, starts=4, patience=99)
    assert both[1].centres.tolist() == model.centres.tolist() and both[0].counts.sum() == counts.sum()
    out = model.assign(df, distance="d").toPandas()
    want = far(out[COLS].to_numpy(), model.centres)
    assert (out["cluster"] == want.argmin(axis=1)).all() and np.allclose(out["d"], want.min(axis=1))
    assert sorted(out["cluster"].value_counts()) == [300, 300, 300]


def test_stops_early_and_odd_tables(spark):
    df = frame(spark)
    assert K.fit(df, COLS, "key", 3, batch=100, steps=60, patience=3).steps < 60
    same = df.limit(40).withColumns({"a": F.lit(1.0), "b": F.lit(2.0)})
    model = K.fit(same, COLS, "key", 3, batch=10, steps=4, starts=2)
    assert {tuple(c) for c in model.centres.tolist()} == {(1.0, 2.0)} and model.assign(same).count() == 40
    holes = df.withColumn("a", F.when(F.col("key") > 0, F.col("a")))
    assert K.fit(holes, COLS, "key", 2, batch=100, steps=3, starts=2).steps == 3
    assert K.fit(df.limit(0), COLS, "key", 2).steps == 0


def test_every_row_moves_the_centres(spark):
    """Five batches of ten rows would be a sample of the 900, and patience could end a model earlier."""
    df = frame(spark)
    for patience in (99, 1):
        two, three = K.fit_many(df, COLS, "key", [2, 3], batch=10, steps=5, starts=2, patience=patience)
        assert two.counts.sum() == three.counts.sum() == 900 and two.steps == three.steps == 5
    table, n, a_round = K.batches(df, COLS, "key", 7, 10, 5)
    assert (n, a_round) == (900, 5) and table.select("_key").distinct().count() == table.count() == 900
    small = K.batches(df, COLS, "key", 7, 100, 20)[0]
    assert small.groupBy("step").count().agg(F.max("count")).first()[0] < 200
