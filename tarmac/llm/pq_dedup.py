"""Embedding near-duplicates with a product-quantised inverted index.

Equal vectors are one class with a weight. Classes are dealt to inverted lists
by their nearest coarse centroid, and the residual is stored as one code per
subspace. A class probes every list that can hold a vector within the link
distance: for unit vectors, cosine >= t means a distance of at most
r = sqrt(2 - 2t), and a list is out of reach when the bisector between its
centroid and the own one is farther than r, so the probes are sufficient. Both
vectors of a link are in reach of each other's lists, so of two lists only one
probes the other. Neighbouring lists share a bin, and a class is sent once to
each bin in which it probes any list. In a list, distances come from a table of
the probe's residual against the codewords; an entry stays a candidate while its table distance is at most r
plus the entry's stored quantisation error (triangle inequality), so nothing
within reach is lost. Candidates are re-ranked by their exact cosine in double
precision.

Centroids and codewords are fitted on a bounded sample; every row is indexed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import quoted, shared_table
from tarmac.llm.graph import components

COSINE = 0.95
SUBSPACES, CODES, ROUNDS = 8, 64, 8
#: Lists: the square root of the classes, at most; fitting takes this many
#: sample vectors for each list.
MAX_LISTS, SAMPLE_PER_LIST = 2048, 32
#: Members and probes that meet in one task; a bin of lists aims at as many members.
MEMBERS, PROBES = 4096, 8192
SLACK = 1e-6


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None], 0)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_square(x[i:i + 4096], c).argmin(1) for i in range(0, len(x), 4096)] or [np.empty(0, int)])


class Index:
    """Coarse centroids and residual codebooks."""

    def __init__(self, sample: np.ndarray, lists: int, bins: int, cosine: float):
        self.reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
        self.centroids = _kmeans(sample, lists, 1)
        rest = sample - self.centroids[_nearest(sample, self.centroids)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [_kmeans(rest[:, at], CODES, 2 + j) for j, at in enumerate(self.cuts)]
        self.bins = _nearest(self.centroids, _kmeans(self.centroids, bins, 99))

    def encode(self, x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and quantisation error of unit vectors of the lists ``near``."""
        rest = x - self.centroids[near]
        codes = np.stack([_nearest(rest[:, at], b) for at, b in zip(self.cuts, self.books)], axis=1)
        back = np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)
        return codes.astype(np.uint8), np.sqrt(((rest - back) ** 2).sum(1))

    def probes(self, x: np.ndarray, near: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Which of ``lists`` each vector of list ``near`` probes: its own, and those
        in reach on its side of the pair of lists."""
        d = _square(x, self.centroids[lists])
        own = ((x - self.centroids[near]) ** 2).sum(1)[:, None]
        gap = np.sqrt(_square(self.centroids, self.centroids[lists]))[near]
        a, b = near[:, None], lists[None]
        turn = (a < b) == ((a + b) % 2 == 0)
        return (a == b) | (turn & (d - own <= 2 * gap * self.reach + 1e-9))

    def close(self, x: np.ndarray, at: int, codes: np.ndarray, err: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probe, entry) pairs of list ``at`` whose table-lookup distance is in reach."""
        rest = x - self.centroids[at]
        total = np.zeros((len(codes), len(x)), dtype=np.float32)
        for j, (cols, b) in enumerate(zip(self.cuts, self.books)):
            total += np.ascontiguousarray(_square(b, rest[:, cols]), dtype=np.float32)[codes[:, j]]
        entry, probe = np.nonzero(total <= ((self.reach + err + 1e-3) ** 2)[:, None])
        return probe, entry


def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / np.sqrt((x**2).sum(1))[:, None]


def _valid(vec) -> F.Column:
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vec.isNotNull() & F.exists(vec, lambda v: v != 0) & ~bad


def _meet(index: Index, cosine: float):
    """Function for one block of a bin: links between its probes and members, and
    a forest of them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, p = pdf[pdf.side == 0], pdf[pdf.side == 1]
        out = pd.DataFrame({"node": [], "vh": [], "links": [], "root": []}).astype("int64")
        if not len(m) or not len(p):
            return out
        mx, px = unit(m.vec), unit(p.vec)
        near, home = m.list.to_numpy(), p.list.to_numpy()
        codes, err = index.encode(mx, near)
        mid, pid = m.node.to_numpy(), p.node.to_numpy()
        same_m, same_p = m.vh.to_numpy(), p.vh.to_numpy()
        weight_m, weight_p = m.weight.to_numpy(), p.weight.to_numpy()
        parent: dict[int, int] = {}

        def find(v: int) -> int:
            parent.setdefault(v, v)
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        links, back = np.zeros(len(p), dtype=np.int64), np.zeros(len(m), dtype=np.int64)
        lists = np.unique(near)
        asks = index.probes(px, home, lists)
        for column, at in enumerate(lists.tolist()):
            entries, askers = np.flatnonzero(near == at), np.flatnonzero(asks[:, column])
            for i in range(0, len(askers), 256):
                some = askers[i:i + 256]
                a, b = index.close(px[some], at, codes[entries], err[entries])
                a, b = some[a], entries[b]
                keep = (pid[a] != mid[b]) | (same_p[a] != same_m[b])
                a, b = a[keep], b[keep]
                exact = np.concatenate([np.einsum("ij,ij->i", px[a[k:k + 8192]], mx[b[k:k + 8192]])
                                        for k in range(0, len(a), 8192)] or [np.empty(0)])
                a, b = a[exact >= cosine], b[exact >= cosine]
                np.add.at(links, a, weight_m[b])
                other = home[a] != at  # within a list, each of the two is a probe
                np.add.at(back, b[other], weight_p[a[other]])
                for u, v in zip(pid[a].tolist(), mid[b].tolist()):
                    u, v = find(u), find(v)
                    if u != v:
                        parent[max(u, v)] = min(u, v)
        found = [pd.DataFrame({"node": i[n > 0], "vh": h[n > 0], "links": n[n > 0], "root": i[n > 0]})
                 for i, h, n in ((pid, same_p, links), (mid, same_m, back))]
        tree = pd.DataFrame([(v, find(v)) for v in list(parent)], columns=["node", "root"], dtype="int64")
        tree["vh"], tree["links"] = 0, 0
        return pd.concat([out, *found, tree[tree.node != tree.root]])[["node", "vh", "links", "root"]].astype("int64")

    return run


def _links(classes: DataFrame, size: int, cosine: float, max_lists: int) -> DataFrame:
    """``node, vh, links, root`` rows of all classes of one dimension."""
    lists = max(1, min(max_lists, math.isqrt(size)))
    rows = classes.select("vec", F.xxhash64("node", "vh").alias("h")).orderBy("h").limit(lists * SAMPLE_PER_LIST)
    sample = unit([r["vec"] for r in rows.collect()])  # bounded by the limit
    index = Index(sample, lists, -(-size // MEMBERS), cosine)
    every = np.arange(len(index.centroids))

    def place(frames):
        for pdf in frames:
            for i in range(0, len(pdf), 1024):
                part = pdf.iloc[i:i + 1024].reset_index(drop=True)
                if not len(part):
                    continue
                x = unit(part.vec)
                near = _nearest(x, index.centroids)
                asks = index.probes(x, near, every)
                part["list"] = near
                own = part.assign(side=0, bin=index.bins[near])
                row, to = np.nonzero(np.stack([asks[:, index.bins == b].any(1) for b in range(index.bins.max() + 1)], axis=1))
                yield pd.concat([own, part.iloc[row].assign(side=1, bin=to)])[
                    ["side", "bin", "list", "node", "vh", "weight", "vec"]]

    vec = classes.schema["vec"].dataType.simpleString()
    placed = shared_table(classes.select("node", "vh", "weight", "vec").mapInPandas(
        place, f"side int, bin int, list int, node long, vh long, weight long, vec {vec}"), "postings")
    sizes = placed.groupBy("bin").agg(F.sum(1 - F.col("side")).alias("m"), F.sum("side").alias("p"))
    grid = sizes.select("bin", F.greatest(F.lit(1), F.ceil(F.col("m") / MEMBERS)).cast("int").alias("km"),
                        F.greatest(F.lit(1), F.ceil(F.col("p") / PROBES)).cast("int").alias("kp"))
    dealt = placed.join(F.broadcast(grid), "bin")  # one row per bin
    mine = F.pmod(F.xxhash64("node", "vh"), F.when(F.col("side") == 0, F.col("km")).otherwise(F.col("kp"))).cast("int")
    other = F.when(F.col("side") == 0, F.col("kp")).otherwise(F.col("km"))
    dealt = dealt.withColumn("mine", mine).withColumn("all", F.explode(F.sequence(F.lit(0), other - 1)))
    first = F.col("side") == 0
    dealt = dealt.select("side", "bin", "list", F.when(first, F.col("mine")).otherwise(F.col("all")).alias("i"),
                         F.when(first, F.col("all")).otherwise(F.col("mine")).alias("j"), "node", "vh", "weight", "vec")
    return dealt.groupBy("bin", "i", "j").applyInPandas(_meet(index, cosine), "node long, vh long, links long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE,
                    max_lists: int = MAX_LISTS) -> DataFrame:
    """One row per input row: ``vec_id``, ``n_links`` (other rows whose vector has
    a cosine of at least ``cosine``), ``component_id`` (smallest id reachable) and
    ``kept`` (the row's id is its component's).

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing (n_links 0, a component of their own). A row with a null id
    links like any other; it is never kept, and its component is null where no
    member has an id. Vectors of different lengths never
    link. Rows that repeat a vector link with each other. Ids are identities:
    rows with one id share a component. Other columns are ignored.
    """
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.col(quoted(vec_col)).alias("vec"))
    rows = rows.withColumn("vh", F.when(_valid(F.col("vec")), F.xxhash64("vec")))
    # Classes without an id get numbers above all ids, so that they are never the smallest of others.
    beyond = (rows.agg(F.max("vec_id")).first()[0] or 0) + 1
    named = shared_table(rows.filter("vh IS NOT NULL").groupBy("vec", "vh").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("weight")).withColumn("number", F.monotonically_increasing_id()), "vectors")
    classes = named.select("vec", "vh", F.coalesce("least", F.lit(max(beyond, 0)) + F.col("number")).alias("node"), "weight")
    sizes = {r[0]: r[1] for r in classes.groupBy(F.size("vec")).count().collect()}  # one row per length
    found = None
    for dim, n in sorted(sizes.items()):
        part = _links(classes.filter(F.size("vec") == dim), n, cosine, max_lists)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.col("vec_id").isNotNull().alias("kept"))
    found = shared_table(found, "links")
    near = found.groupBy("node", "vh").agg(F.sum("links").alias("links"))
    # Rows of one class are linked through their class and need no pairs.
    member = rows.filter("vh IS NOT NULL").join(classes.drop("weight"), ["vec", "vh"])
    edges = found.select(F.col("node").alias("src"), F.col("root").alias("dst")).unionByName(
        member.filter("vec_id <> node").select(F.col("vec_id").alias("src"), F.col("node").alias("dst")))
    comp = components(edges)
    counted = rows.join(classes, ["vec", "vh"], "left").join(near, ["node", "vh"], "left").join(
        comp.withColumnRenamed("node", "n"), F.coalesce("vec_id", "node") == F.col("n"), "left")
    counted = counted.withColumn("component", F.when(F.col("component") < max(beyond, 0), F.col("component")))
    return counted.select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))
