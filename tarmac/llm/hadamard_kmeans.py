"""Clustering by progressive search in the Walsh-Hadamard domain.

Components become integers, and the Walsh-Hadamard transform of integers is
exact: squared distances between transforms are ``dim`` times those between the
vectors. Coefficients are ordered by sequency, coarse to fine. The search adds
up squared coefficient differences group by group; once a centroid's partial
sum is above the full distance of the one that looked nearest, it cannot win
and is dropped. What remains is carried through all coefficients.

The coefficients are written once. A round is one pass over them: tasks assign
their vectors and add up coefficients by cluster, and a row for each cluster and
coefficient reaches the driver, where the sums are transformed back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import quoted, shared_table

DIM, CLUSTERS, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
#: Integer components stay below this, so that transformed distances fit 64 bits.
LARGEST = 1 << 21
#: Vector and centroid pairs compared at a time.
PAIRS = 1 << 15


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis (a power of two), in sequency
    order: coefficient ``i`` belongs to the row with ``i`` changes of sign."""
    dim = x.shape[-1]
    h = np.ones((1, 1), dtype=np.int64)
    while len(h) < dim:
        h = np.block([[h, h], [h, -h]])
    order = np.argsort((np.diff(h, axis=1) != 0).sum(axis=1), kind="stable")
    y, step = x, 1
    while step < dim:  # butterflies
        y = y.reshape(*x.shape[:-1], dim // (2 * step), 2, step)
        y = np.concatenate([y[..., :1, :] + y[..., 1:, :], y[..., :1, :] - y[..., 1:, :]], axis=-2)
        y, step = y.reshape(x.shape), 2 * step
    return y[..., order]


def inverse(x: np.ndarray) -> np.ndarray:
    """Undo ``transform``, exactly."""
    dim = x.shape[-1]
    basis = transform(np.eye(dim, dtype=np.int64))  # basis[i, k]: component i in coefficient k
    return (x.astype(object) @ basis.T.astype(object)) // dim


def groups(dim: int) -> list[slice]:
    """Coefficient groups from coarse to fine, each as long as all before it."""
    edges = [0, min(4, dim)]
    while edges[-1] < dim:
        edges.append(2 * edges[-1])
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of every vector, ties to the smaller number, and the
    squared distance, both from coefficients; also exact for the transforms."""
    n, dim = x.shape
    coarse, *finer = groups(dim)
    part = ((x[:, None, coarse] - c[None, :, coarse]) ** 2).sum(axis=2)
    rows, guess = np.arange(n), part.argmin(axis=1)
    bound = ((x - c[guess]) ** 2).sum(axis=1)
    alive = part <= bound[:, None]
    alive[rows, guess] = False  # finished already
    for g in finer:
        r, k = np.nonzero(alive)
        if not len(r):
            break
        part[r, k] += ((x[r, g] - c[k, g]) ** 2).sum(axis=1)
        alive[r, k] = part[r, k] <= bound[r]
    part[~alive] = np.iinfo(np.int64).max
    part[rows, guess] = bound
    best = part.argmin(axis=1)
    return best, part[rows, best] // dim


def coefficients(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM) -> DataFrame:
    """``vec_id`` and ``x``, the coefficients of ``floor(1024 * component)``, of
    the vectors with exactly ``dim`` components, none null or non-finite. A
    component of 2048 or more in size is an error: distances would not be exact."""
    v = F.col(quoted(vec_col))
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kept = vectors.select(F.col(quoted(id_col)).alias("vec_id"), v.cast("array<double>").alias("v")).filter(
        (F.size(v) == dim) & finite)
    kind = kept.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            values = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            whole = np.floor(SCALE * values)
            if np.abs(whole).max(initial=0) >= LARGEST:
                raise ValueError(f"components of {LARGEST // SCALE} or more in size have no exact 64-bit distances")
            flat = transform(whole.astype(np.int64)).ravel()
            x = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), x], names=["vec_id", "x"])

    return kept.mapInArrow(run, f"vec_id {kind}, x array<long>")


def _blocks(column: pa.Array, dim: int, clusters: int) -> Iterator[np.ndarray]:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    size = max(1, PAIRS // clusters)
    for i in range(0, len(x), size):
        yield x[i:i + size]


def _sums(table: DataFrame, c: np.ndarray) -> dict[int, tuple[int, np.ndarray]]:
    """Vectors and summed coefficients of every non-empty cluster."""
    k, dim = c.shape

    def run(batches):
        n, total = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for b in batches:
            for x in _blocks(b.column(0), dim, k):
                best, _ = nearest(x, c)
                n += np.bincount(best, minlength=k)
                np.add.at(total, best, x)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(total[at].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "total"])

    parts = table.select("x").mapInArrow(run, "cluster int, n long, total array<long>")
    rows = parts.select("cluster", "n", F.posexplode("total").alias("at", "s")).groupBy("cluster", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(28,0)")).alias("s"))
    out: dict[int, tuple[int, np.ndarray]] = {}
    for r in rows.collect():  # clusters times coefficients
        out.setdefault(r["cluster"], (r["n"], np.zeros(dim, dtype=object)))[1][r["at"]] = int(r["s"])
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", clusters: int = CLUSTERS,
            rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM) -> DataFrame:
    """One row per kept vector (see ``coefficients``): ``vec_id``, ``cluster``,
    ``distance`` (squared, to the final centroid), ``cluster_inertia``,
    ``inertia`` and ``centroid`` (its integer components).

    Centroids start as the vectors with the smallest hashes of ``seed:vec_id``;
    of equal ids the smaller coefficients come first and a null id hashes as
    empty text. Fewer vectors than ``clusters`` give fewer centroids, an empty
    table an empty result. Repeated rows count each; other columns are ignored.
    """
    table = shared_table(coefficients(vectors, id_col, vec_col, dim), "coefficients")
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = table.orderBy(by_hash, "x").limit(clusters).select("x").collect()
    if first:
        centroids = np.array([inverse(np.array(r["x"])) for r in first])
        c = transform(centroids.astype(np.int64))
        for _ in range(rounds):
            for k, (n, total) in _sums(table, c).items():
                centroids[k] = [int(s) // n for s in inverse(total)]
            moved = transform(centroids.astype(np.int64))
            if (moved == c).all():  # later rounds would change nothing
                break
            c = moved
    else:
        centroids = c = np.zeros((1, dim), dtype=np.int64)
    kind = table.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [nearest(x, c) for x in _blocks(b.column(1), dim, len(c))]
            best, far = (np.concatenate(p) for p in zip(*found)) if found else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best.astype(np.int32)), pa.array(far)],
                                             names=["vec_id", "cluster", "distance"])

    rows = shared_table(table.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: r["i"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("i")).collect()}
    stats = table.sparkSession.createDataFrame(
        [(k, i, sum(inertia.values()), [int(v) for v in centroids[k]]) for k, i in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return rows.join(F.broadcast(stats), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: Column) -> Column:
    """Hash of a centroid's components as decimal integers joined by commas."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ","), 256)
