"""Mini-batch k-means: centres move by batches of rows drawn by their keys.

A hash of the row key, the seed and the round gives each row a place in one
batch a round, of about ``batch`` rows, or of more where ``steps`` of these would
not hold the table: the first round gives every row to the centres. The rows of
all steps that may be taken are written once, by step. A step assigns its batch
to the nearest centres and moves each centre to the mean of all rows it has been
given so far, so that its step size is one over their count. Starts are k-means++ draws over the first batches, all
starts in the same passes; the one with the least cost there goes on. Several
numbers of centres are fitted in the same passes, too. All rows are assigned in
the end by expressions, without a shuffle.

Tasks send sums as integers of fixed scale, one row for each centre, so centres
do not depend on partitioning.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.operators.boosting import _unit as unit_of
from tarmac.session import run_folder

BATCH, STEPS, STARTS, PATIENCE = 10_000, 100, 10, 10
START_BATCHES = 3
#: Rows of a batch that one task writes.
PART_ROWS = 100_000
#: Scale of the sums of squared distances, which only choose starts and stops.
DISTANCE = 2.0**20


def _distances(cols: list[str], centres: np.ndarray) -> list[Column]:
    def squared(centre):
        parts = [(F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(cols, centre)]
        return sum(parts[1:], parts[0])

    return [squared(c) for c in centres]


def nearest(cols: list[str], centres: np.ndarray) -> tuple[Column, Column]:
    """Number of the nearest centre (ties: the smaller) and the squared distance."""
    d = F.array(*_distances(cols, centres))
    return (F.array_position(d, F.array_min(d)) - 1).cast("int"), F.array_min(d)


def _unit(key: str, *salt) -> Column:
    """A value in (0, 1] from the row key."""
    bits = F.shiftrightunsigned(F.xxhash64(F.col(key), *[F.lit(s) for s in salt]), 12)
    return (bits.cast("double") + 1) / F.lit(float(1 << 52))


@dataclass
class MiniBatch:
    cols: list[str]
    centres: np.ndarray
    counts: np.ndarray  # rows of the batches that each centre was given
    steps: int

    def assign(self, df: DataFrame, out: str = "cluster", distance: str | None = None) -> DataFrame:
        """``df`` with the number of its nearest centre and, if named, the squared distance to it."""
        number, d = nearest(self.cols, self.centres)
        return df.withColumns({out: number, **({distance: d} if distance else {})})


def batches(df: DataFrame, cols: list[str], key: str, seed: int, batch: int, steps: int) -> tuple[DataFrame, int, int]:
    """Rows of the first ``steps`` batches with their ``step``, written to the
    shared folder (``_key``: a hash of the key); the number of rows of ``df``, and
    of batches in a round, which are at most ``steps``."""
    n = df.count()
    a_round = max(1, min(-(-n // batch), steps))
    rounds = -(-steps // a_round)
    step = F.explode(F.array(*[(F.floor((1 - _unit(key, seed, "round", r)) * a_round) + r * a_round).cast("int") for r in range(rounds)]))
    path = run_folder(df.sparkSession, "minibatch")
    drawn = df.select(F.xxhash64(F.col(key)).alias("_key"), *[F.col(c).cast("double").alias(c) for c in cols], step.alias("step"))
    part = F.pmod(F.col("_key"), F.lit(-(-n // (a_round * PART_ROWS)) or 1))
    drawn.where(F.col("step") < steps).repartition("step", part).write.partitionBy("step").parquet(path)
    return df.sparkSession.read.schema(drawn.schema).parquet(path), n, a_round


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = (x[:, :1] - centres[:, 0]) ** 2
    for i in range(1, x.shape[1]):
        out += (x[:, i:i + 1] - centres[:, i]) ** 2
    return out


def _points(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashed keys and points of a batch (_key, columns...)."""
    cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
    return cols[0], np.stack(cols[1:], axis=1)


def plus_plus(sample: DataFrame, cols: list[str], ks: list[int], starts: int, seed: int) -> list[np.ndarray]:
    """For each of ``ks`` a set of centres for every start (start, centre,
    column), the same up to the smaller number: each centre is a row drawn with
    probability by the squared distance to the nearest one so far, as the least
    exponential variate. One pass a centre; a task sends a row for each start."""
    found: list[list[list[float]]] = [[] for _ in range(starts)]
    for i in range(max(ks)):
        so_far = [np.array(f, dtype=float) for f in found]

        def race(batches, i=i, so_far=so_far):
            best: list[tuple] = [(math.inf, None)] * starts
            for b in batches:
                key, x = _points(b)
                if not len(x):
                    continue
                for s in range(starts):
                    weight = _far(x, so_far[s]).min(axis=1) if i else np.ones(len(x))
                    with np.errstate(divide="ignore"):
                        time = np.where(weight > 0, -np.log1p(-unit_of(key, seed * 1_000_003 + s * 1009 + i + 1)) / weight, math.inf)
                    at = int(time.argmin())
                    if time[at] < best[s][0]:
                        best[s] = (float(time[at]), x[at].tolist())
            won = [(s, t, p) for s, (t, p) in enumerate(best) if p]
            yield pa.RecordBatch.from_arrays([pa.array([w[j] for w in won], t) for j, t in enumerate(
                (pa.int32(), pa.float64(), pa.list_(pa.float64())))], names=["s", "t", "p"])

        rows = sample.select("_key", *cols).mapInArrow(race, "s int, t double, p array<double>").groupBy("s").agg(
            F.min(F.struct("t", "p")).alias("w")).collect()  # a row for each start
        won = {r["s"]: list(r["w"]["p"]) for r in rows}
        for s in range(starts):
            # Fewer different rows than centres: the first centre again.
            found[s].append(won.get(s) or found[s][0])
    return [np.array([f[:k] for f in found], dtype=float) for k in ks]


def _sums(rows: DataFrame, cols: list[str], models: list[np.ndarray], scale: float) -> list[np.ndarray]:
    """For each set of centres: rows, scaled sum of every column and scaled sum
    of squared distances of the rows nearest to each centre."""
    width = len(cols)

    def add(batches):
        total = [np.zeros((len(c), width + 2), dtype=np.int64) for c in models]
        for b in batches:
            _, x = _points(b)
            whole = np.rint(x * scale).astype(np.int64)
            for out, c in zip(total, models):
                d = _far(x, c)
                near = d.argmin(axis=1)
                np.add.at(out, near, np.column_stack([np.ones(len(x), dtype=np.int64), whole,
                                                      np.rint(d[np.arange(len(x)), near] * DISTANCE).astype(np.int64)]))
        parts = [(m, j, r) for m, out in enumerate(total) for j, r in enumerate(out) if r[0]]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.int32()),
                                          *[pa.array([int(p[2][i]) for p in parts], pa.int64()) for i in range(width + 2)]], names=names)

    names = ["m", "j", *[f"v{i}" for i in range(width + 2)]]
    schema = ", ".join(["m int, j int", *[f"{n} long" for n in names[2:]]])
    found = rows.select("_key", *cols).mapInArrow(add, schema).groupBy("m", "j").agg(*[F.sum(n).alias(n) for n in names[2:]])
    out = [np.zeros((len(c), width + 2)) for c in models]
    for r in found.collect():  # a row for each centre
        out[r["m"]][r["j"]] = [r["v0"], *[r[f"v{i + 1}"] / scale for i in range(width)], r[f"v{width + 1}"] / DISTANCE]
    return out


def quality(df: DataFrame, models: list[MiniBatch]) -> list[tuple[float, float]]:
    """For each model the summed squared distance of all rows to their nearest
    centres, and the mean silhouette by squared distances. Two passes for all
    models: sums of every cluster, then each row against them."""
    cols = models[0].cols
    rows, width, centres = df.select(*[F.col(c).cast("double").alias(c) for c in cols]), len(cols), [m.centres for m in models]
    names = ["m", "j", *[f"v{i}" for i in range(width + 3)]]

    def points(b):
        return np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)

    def add(batches):
        total = [np.zeros((len(c), width + 3)) for c in centres]  # rows, sums, squared norms, distances
        for x in map(points, batches):
            for out, c in zip(total, centres):
                d = _far(x, c)
                near = d.argmin(axis=1)
                each = [np.ones(len(x)), *x.T, (x**2).sum(axis=1), d[np.arange(len(x)), near]]
                out += np.stack([np.bincount(near, v, len(c)) for v in each], axis=1)
        parts = [(m, j, *r) for m, out in enumerate(total) for j, r in enumerate(out.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in parts], t) for i, t in enumerate(
            [pa.int32(), pa.int32()] + [pa.float64()] * (width + 3))], names=names)

    sums = [np.zeros((len(c), width + 3)) for c in centres]
    found = rows.mapInArrow(add, ", ".join(["m int, j int", *[f"{n} double" for n in names[2:]]])).groupBy("m", "j").agg(
        *[F.sum(n).alias(n) for n in names[2:]])
    for r in found.collect():  # a row for each centre
        sums[r["m"]][r["j"]] = [r[n] for n in names[2:]]
    if any((s[:, 0] > 0).sum() < 2 for s in sums):
        raise ValueError("Number of clusters must be greater than one.")

    def compare(batches):
        total = np.zeros(len(centres))
        for x in map(points, batches):
            for m, (c, s) in enumerate(zip(centres, sums)):
                near, on, n = _far(x, c).argmin(axis=1), np.arange(len(x)), s[:, 0]
                with np.errstate(divide="ignore", invalid="ignore"):
                    mean = (x**2).sum(axis=1)[:, None] + s[:, width + 1] / n - 2 * (x @ s[:, 1:width + 1].T) / n
                    own = mean[on, near] * n[near] / (n[near] - 1)
                    mean[:, n == 0] = math.inf
                    mean[on, near] = math.inf
                    other = mean.min(axis=1)
                    value = np.where(own < other, 1 - own / other, np.where(own > other, other / own - 1, 0.0))
                total[m] += value[n[near] > 1].sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(centres)), pa.int32()), pa.array(total)], names=["m", "s"])

    shape = {r["m"]: r["s"] for r in rows.mapInArrow(compare, "m int, s double").groupBy("m").agg(F.sum("s").alias("s")).collect()}
    return [(float(s[:, -1].sum()), shape[m] / float(s[:, 0].sum())) for m, s in enumerate(sums)]


def fit_many(df: DataFrame, cols: list[str], key: str, ks: list[int], seed: int = 42, batch: int = BATCH, steps: int = STEPS,
             starts: int = STARTS, patience: int = PATIENCE) -> list[MiniBatch]:
    """A model for each number of centres in ``ks`` from the complete rows of
    ``df`` (``key``: a row key), over the same batches. A model stops after
    ``steps`` batches, or when the smoothed cost of a batch has not fallen for
    ``patience`` of them, but not before it was given every row. Centres are not
    drawn anew when they get few rows. An empty table gives centres at zero."""
    df = df.dropna(subset=cols)
    table, n, a_round = batches(df, cols, key, seed, batch, steps)
    if not n:
        return [MiniBatch(cols, np.zeros((k, len(cols))), np.zeros(k), 0) for k in ks]
    batch = max(batch, -(-n // a_round))
    first = table.where(F.col("step") < min(START_BATCHES, a_round))
    top = table.agg(*[F.max(F.abs(c)).alias(f"_{i}") for i, c in enumerate(cols)]).first()
    # As fine as 64-bit sums allow over what a few batches can hold.
    scale = 2.0 ** min(40, math.floor(60 - math.log2(max(1.0, *top) * START_BATCHES * batch * 4)))
    options = plus_plus(first, cols, ks, starts, seed)
    flat = _sums(first, cols, [o for some in options for o in some], scale)
    cost = [[flat[i * starts + s][:, -1].sum() for s in range(starts)] for i in range(len(ks))]
    models = [MiniBatch(cols, some[int(np.argmin(c))].copy(), np.zeros(k), 0) for some, c, k in zip(options, cost, ks)]
    smooth: list[float | None] = [None] * len(ks)
    best, since = [math.inf] * len(ks), [0] * len(ks)
    rate = min(1.0, 2 * batch / (n + 1))
    for step in range(steps):
        going = [i for i in range(len(ks)) if since[i] < patience or step < a_round]
        if not going:
            break
        for i, got in zip(going, _sums(table.where(F.col("step") == step), cols, [models[i].centres for i in going], scale)):
            m, rows = models[i], got[:, 0]
            if not rows.sum():
                continue
            m.steps += 1
            on = rows > 0
            m.centres[on] = (m.centres[on] * m.counts[on, None] + got[on, 1:-1]) / (m.counts + rows)[on, None]
            m.counts += rows
            now = got[:, -1].sum() / rows.sum()
            smooth[i] = now if smooth[i] is None else smooth[i] * (1 - rate) + now * rate
            best[i], since[i] = (smooth[i], 0) if smooth[i] < best[i] else (best[i], since[i] + 1)
    return models


def fit(df: DataFrame, cols: list[str], key: str, k: int, **settings) -> MiniBatch:
    """One model, see ``fit_many``."""
    return fit_many(df, cols, key, [k], **settings)[0]
