"""Gradient-boosted trees grown leaf by leaf, many models in the same passes.

Features are cut into bins once; the binned rows are a Parquet table in the
shared folder. A pass over it builds, in every task, histograms of gradients
for the open leaves of all models at once; the histograms are summed by model
and leaf over a shuffle, and one small row for each open leaf, its best split,
reaches the driver. Trees are best-first: the open leaf with the largest gain is
split next until there are ``num_leaves``. A leaf's split depends on its own
rows only, so a pass takes all leaves at once that the best-first order could
still reach; the result is the tree of one split after the other, in at most
``max_depth`` passes. A leaf of at most ``SMALL`` rows is finished in one pass:
its rows, in place of a histogram, go to one task, which splits on to the end.
A model that trains on no more rows than that is grown by one task, all its trees.

Gradients enter the histograms as integers of fixed scale, so sums, and with
them the models, do not depend on partitioning or on tasks run twice. Row
sampling is a hash of the row's key, the seed and the tree.
"""

from __future__ import annotations

import heapq
import math
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.session import run_folder

#: Trees a pass may have to apply to a row before its scores are written anew.
PENDING = 4
#: Rows of a leaf that one task splits on to the end (about 36 megabytes, and as
#: much again while it does). A leaf sent to a task saves a pass for each level below it.
SMALL = 1 << 20
#: Rows binned at a time, and the fewest and most rows of a part of the table.
ROWS, SPREAD, PART_ROWS = 1 << 14, 1 << 11, 1 << 20


@dataclass(frozen=True)
class Boost:
    """Size and sampling of a model. ``objective`` is ``logistic`` (labels 0 and
    1) or ``squared``; ``row_rate`` and ``col_rate`` are the shares of rows and
    features that each tree sees."""

    rounds: int = 300
    rate: float = 0.05
    max_depth: int = 8
    num_leaves: int = 31
    min_rows: int = 20
    row_rate: float = 1.0
    col_rate: float = 1.0
    l2: float = 0.0
    objective: str = "logistic"
    seed: int = 42


# ---------------------------------------------------------------------------
# Bins
# ---------------------------------------------------------------------------

@dataclass
class Binner:
    """Bin edges of numeric features and categories of the others. Bin 0 holds
    missing values and categories that were not kept."""

    edges: dict[str, np.ndarray]
    categories: dict[str, dict[str, int]]

    @property
    def names(self) -> list[str]:
        return [*self.edges, *self.categories]

    @property
    def sizes(self) -> np.ndarray:
        return np.array([len(e) + 2 for e in self.edges.values()] + [len(c) + 1 for c in self.categories.values()])

    def cut(self, batch: pa.RecordBatch) -> np.ndarray:
        """Bins of a batch that starts with the feature columns: (rows, features)."""
        out = np.zeros((batch.num_rows, len(self.names)), dtype=np.uint8)
        for j, e in enumerate(self.edges.values()):
            x = batch.column(j).to_numpy(zero_copy_only=False).astype(float)
            out[:, j] = np.where(np.isnan(x), 0, np.searchsorted(e, x) + 1)
        for j, c in enumerate(self.categories.values(), start=len(self.edges)):
            coded = batch.column(j).dictionary_encode()
            code = np.array([c.get(v, 0) for v in coded.dictionary.to_pylist()] + [0], dtype=np.uint8)
            out[:, j] = code[coded.indices.fill_null(len(code) - 1).to_numpy(zero_copy_only=False)]
        return out


def fit_bins(df: DataFrame, numeric: list[str], categorical: list[str], max_bins: int = 64) -> Binner:
    """Quantile edges (a sketch of fixed size for each column) and the most
    frequent categories, at most ``max_bins`` of each; rarer ones share bin 0."""
    if not 3 < max_bins <= 256:
        raise ValueError(f"max_bins must be 4 to 256: {max_bins}")
    edges: dict[str, np.ndarray] = {}
    if numeric:
        at = F.array(*[F.lit(i / (max_bins - 2)) for i in range(1, max_bins - 2)])
        known = [F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), at, 10_000).alias(c)
                 for c in numeric]
        row = df.agg(*known).first()
        edges = {c: np.unique(np.array(row[c] or [], dtype=float)) for c in numeric}
    kept: dict[str, dict[str, int]] = {c: {} for c in categorical}
    if categorical:
        pair = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in categorical]))
        counts = df.select(pair.alias("p")).groupBy("p.c", "p.v").agg(F.count(F.lit(1)).alias("n")).where("v IS NOT NULL")
        rank = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("n"), "v"))
        for r in counts.withColumn("r", rank).where(F.col("r") < max_bins).orderBy("c", "r").collect():  # max_bins a column
            kept[r["c"]][r["v"]] = r["r"]
    return Binner(edges, kept)


def _rows_of_bytes(x: np.ndarray) -> pa.Array:
    offsets = np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def _bytes_of_rows(column: pa.Array, width: int) -> np.ndarray:
    start = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[start:start + len(column) * width].reshape(-1, width)


# ---------------------------------------------------------------------------
# Trees
# ---------------------------------------------------------------------------

@dataclass
class Tree:
    """Arrays over nodes: split feature (-1: leaf), bins that go left, children,
    leaf value and gain of the split."""

    feat: np.ndarray
    left: np.ndarray
    kids: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def route(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row: a step for each level, by a table of the node
        that follows a node and a bin of its feature (leaves follow themselves)."""
        inner, width = self.feat >= 0, self.left.shape[1]
        follow = np.where(inner[:, None], np.where(self.left, self.kids[:, :1], self.kids[:, 1:]), np.arange(len(inner))[:, None])
        follow, feat = follow.astype(np.int64).ravel(), np.maximum(self.feat, 0).astype(np.int64)
        level = np.zeros(len(inner), dtype=np.int64)
        for i in np.flatnonzero(inner).tolist():  # children come after their parent
            level[self.kids[i]] = level[i] + 1
        node, cells = np.zeros(len(bins), dtype=np.int64), bins.ravel()
        first = np.arange(len(bins)) * bins.shape[1]
        for _ in range(int(level.max())):
            node = follow.take(node * width + cells.take(first + feat.take(node)))
        return node


@dataclass
class Booster:
    setting: Boost
    binner: Binner
    base: float
    trees: list[Tree] = field(default_factory=list)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for t in self.trees:
            out += t.value[t.route(bins)]
        return out

    def score(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Columns ``keep`` and ``raw`` (the sum of the trees), ``p`` (its
        logistic probability) and ``prediction`` (class or value)."""
        names, kept = self.binner.names, df.select(*keep)
        schema = ", ".join([*[f"`{c}` {t}" for c, t in kept.dtypes], "raw double"])

        def run(batches):
            for b in batches:
                raw = self.raw(self.binner.cut(b))
                yield pa.RecordBatch.from_arrays([*b.columns[len(names):], pa.array(raw)], names=[*keep, "raw"])

        features = [F.col(c).cast("double").alias(f"_f{i}") if c in self.binner.edges else F.col(c).cast("string").alias(f"_f{i}")
                    for i, c in enumerate(names)]
        out = df.select(*features, *keep).mapInArrow(run, schema)
        if self.setting.objective == "squared":
            return out.withColumn("prediction", F.col("raw"))
        p = 1 / (1 + F.exp(-F.col("raw")))
        return out.withColumns({"p": p, "prediction": (p > 0.5).cast("int")})

    def importances(self) -> dict[str, tuple[int, float]]:
        """Splits and summed gain of every feature."""
        out = {n: (0, 0.0) for n in self.binner.names}
        for t in self.trees:
            for f, g in zip(t.feat.tolist(), t.gain.tolist()):
                if f >= 0:
                    n, total = out[self.binner.names[f]]
                    out[self.binner.names[f]] = (n + 1, total + g)
        return out


class _Growing:
    """A tree under construction. Nodes are known by their place in ``nodes``; a
    node is open until its best split (or that it has none) is known."""

    def __init__(self, setting: Boost, cols: np.ndarray, rows: int):
        self.setting, self.cols = setting, cols
        self.nodes: list[dict] = [{"depth": 0, "n": rows}]

    def _chosen(self) -> list[int]:
        """Nodes that the best-first order splits, as far as splits are known."""
        heap, out = [], []

        def offer(i: int) -> None:
            if self.nodes[i].get("gain", 0.0) > 0:
                heapq.heappush(heap, (-self.nodes[i]["gain"], i))

        offer(0)
        while heap and len(out) < self.setting.num_leaves - 1:
            i = heapq.heappop(heap)[1]
            out.append(i)
            for k in self.nodes[i]["kids"]:
                offer(k)
        return out

    def open_nodes(self) -> list[int]:
        chosen = self._chosen()
        leaves = [0] if not chosen else [k for i in chosen for k in self.nodes[i]["kids"]]
        return [i for i in leaves if "gain" not in self.nodes[i]]

    def learn(self, i: int, found: dict) -> None:
        node = self.nodes[i]
        node.update(found)
        if node["gain"] > 0:
            node["kids"] = [len(self.nodes), len(self.nodes) + 1]
            parts = [(node["gl"], node["hl"], node["nl"]),
                     (node["g"] - node["gl"], node["h"] - node["hl"], node["n"] - node["nl"])]
            for g, h, n in parts:
                kid = {"depth": node["depth"] + 1, "g": g, "h": h, "n": n}
                if kid["depth"] >= self.setting.max_depth > 0 or n < 2 * self.setting.min_rows:
                    kid["gain"] = 0.0  # stays a leaf
                self.nodes.append(kid)

    def tree(self, sizes: np.ndarray, scale: float) -> tuple[Tree, list[int]]:
        """The chosen splits as a tree, and which node each of its places is."""
        chosen, order = set(self._chosen()), [0]
        for i in order:
            if i in chosen:
                order.extend(self.nodes[i]["kids"])
        place = {i: p for p, i in enumerate(order)}
        n = len(order)
        t = Tree(np.full(n, -1, dtype=np.int32), np.zeros((n, int(sizes.max())), dtype=bool), np.zeros((n, 2), dtype=np.int32),
                 np.zeros(n), np.zeros(n))
        for i, p in place.items():
            node = self.nodes[i]
            if i in chosen:
                t.feat[p], t.gain[p], t.kids[p] = node["feat"], node["gain"], [place[k] for k in node["kids"]]
                t.left[p, :len(node["left"])] = node["left"]
            elif node.get("g") is not None:
                t.value[p] = -self.setting.rate * node["g"] / max(node["h"] + self.setting.l2 * scale, 1e-9)
        return t, order


def best_split(hist: np.ndarray, sizes: np.ndarray, categorical: int, setting: Boost, cols: np.ndarray, scale: float) -> dict:
    """Best split of a leaf from its histogram (bins of all features end to end;
    gradient, hessian, rows): numeric features split by order, categories by
    the order of their mean gradient. Ties go to the first feature and bin."""
    first = np.cumsum(sizes) - sizes
    total = hist[:sizes[0]].sum(axis=0)
    g, h, n = (int(x) for x in total)
    best = {"g": g, "h": h, "n": n, "gain": 0.0, "feat": -1, "left": b"", "gl": 0, "hl": 0, "nl": 0}
    l2 = setting.l2 * scale
    for f in np.flatnonzero(cols).tolist():
        part = hist[first[f]:first[f] + sizes[f]]
        order = np.arange(len(part))
        if f >= categorical:
            mean = part[:, 0] / np.maximum(part[:, 1] + 10 * scale, 1)  # smoothed, as rare categories are noisy
            order = np.lexsort((order, mean))
        left = np.cumsum(part[order], axis=0)[:-1]
        right = total - left
        ok = (np.minimum(left[:, 2], right[:, 2]) >= setting.min_rows) & (np.minimum(left[:, 1], right[:, 1]) > 1e-3 * scale)
        if not ok.any():
            continue
        gain = np.full(len(left), -1.0)
        lo, hi = left[ok].astype(float), right[ok].astype(float)
        gain[ok] = lo[:, 0] ** 2 / (lo[:, 1] + l2) + hi[:, 0] ** 2 / (hi[:, 1] + l2) - float(g) ** 2 / (h + l2)
        k = int(gain.argmax())
        if gain[k] / scale > best["gain"] + 1e-12:
            goes = np.zeros(len(part), dtype=bool)
            goes[order[:k + 1]] = True
            best.update(gain=float(gain[k] / scale), feat=f, left=goes.tobytes(), gl=int(left[k, 0]), hl=int(left[k, 1]),
                        nl=int(left[k, 2]))
    return best


def histogram(columns: np.ndarray, at: np.ndarray | None, leaves: int, g: np.ndarray, h: np.ndarray, sizes: np.ndarray,
              cols: np.ndarray | None = None) -> np.ndarray:
    """Sums by (gradient, hessian, rows; leaf; bin) of rows in the leaves ``at``,
    from their bins by feature (features, rows). ``cols``: features to sum, besides the first."""
    first, out = np.cumsum(sizes) - sizes, np.zeros((3, leaves, int(sizes.sum())), dtype=np.int64)
    for f, size in enumerate(sizes.tolist()):
        if f and cols is not None and not cols[f]:
            continue
        cell = columns[f].astype(np.int64) if at is None else at * size + columns[f]
        for k, v in enumerate((g, h, None)):
            out[k, :, first[f]:first[f] + size] = np.bincount(cell, v, leaves * size).reshape(leaves, size)
    return out


def finish(bins: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, sizes: np.ndarray, categorical: int, setting: Boost,
           cols: np.ndarray, scale: float) -> list[tuple[str, dict]]:
    """Best splits of a leaf and of all leaves below it that the best-first order
    could reach, from its rows: (path of 0 left and 1 right, split)."""
    out: list[tuple[str, dict]] = []
    heap: list[tuple[float, int, str, np.ndarray, np.ndarray]] = []
    columns = np.ascontiguousarray(bins.T)

    def sums(rows: np.ndarray) -> np.ndarray:
        return histogram(columns[:, rows], None, 1, g[rows], h[rows], sizes, cols)[:, 0].T

    def look(path: str, rows: np.ndarray, hist: np.ndarray) -> None:
        found = best_split(hist, sizes, categorical, setting, cols, scale)
        out.append((path, found))
        if found["gain"] > 0:
            heapq.heappush(heap, (-found["gain"], len(out), path, rows, hist))

    whole = np.arange(len(bins))
    look("", whole, sums(whole))
    for _ in range(setting.num_leaves - 1):
        if not heap:
            break
        _, at, path, rows, hist = heapq.heappop(heap)
        found = out[at - 1][1]
        left = np.frombuffer(found["left"], dtype=bool)[columns[found["feat"], rows]]
        parts = [rows[left], rows[~left]]
        deep = 0 < setting.max_depth <= depth + len(path) + 1
        wanted = [not deep and len(part) >= 2 * setting.min_rows for part in parts]
        if not any(wanted):
            continue
        less = int(len(parts[1]) < len(parts[0]))  # the other side is what is left of the whole
        hists = [sums(parts[less])] * 2
        hists[1 - less] = hist - hists[less]
        for side in (0, 1):
            if wanted[side]:
                look(f"{path}{side}", parts[side], hists[side])
    return out


# ---------------------------------------------------------------------------
# Training
# ---------------------------------------------------------------------------

def _unit(key: np.ndarray, salt: int) -> np.ndarray:
    """Values in [0, 1) from 64-bit keys."""
    x = key.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64


def _gradients(objective: str, raw: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if objective == "squared":
        return w * (raw - y), w
    p = 1 / (1 + np.exp(-raw))
    return w * (p - y), w * p * (1 - p)


def binned_table(df: DataFrame, binner: Binner, label: Column, weight: Column, key: Column, member: list[Column],
                 keep: list[str] | None = None) -> DataFrame:
    """Rows as ``bins``, ``y``, ``w``, ``key``, ``member`` (which models train on
    the row) and ``keep``, written to the shared folder."""
    keep = keep or []
    features = [F.col(c).cast("double").alias(f"_f{i}") if c in binner.edges else F.col(c).cast("string").alias(f"_f{i}")
                for i, c in enumerate(binner.names)]
    member = [F.coalesce(m, F.lit(False)) for m in member]
    rest = df.select(*features, label.cast("double").alias("y"), weight.cast("double").alias("w"), key.cast("long").alias("key"),
                     F.array(*member).alias("member"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    width = len(features)
    names = rest.columns[width:]
    schema = ", ".join(["bins binary", *[f"{c} {t}" for c, t in rest.dtypes[width:]]])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                yield pa.RecordBatch.from_arrays([_rows_of_bytes(binner.cut(part)), *part.columns[width:]],
                                                 names=["bins", *names])

    # Small inputs are spread over the cores, large ones cut into parts of a million rows: as
    # bins, which are a fraction of the features' bytes.
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    rows = rest.mapInArrow(run, schema).repartition(max(min(cores, -(-n // SPREAD)), -(-n // PART_ROWS), 1), "key")
    path = run_folder(df.sparkSession, "boosting")
    rows.withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)}).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _block(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _blocks(batches):
    """The blocks of a trainer's table: a batch of rows and their scores each."""
    for b in batches:
        for data, raw in zip(b.column(0), b.column(1)):
            rows = pa.ipc.open_stream(data.as_buffer()).read_next_batch()
            yield data, rows, np.frombuffer(raw.as_buffer(), np.float64).reshape(rows.num_rows, -1)


def _tree_columns(setting: Boost, tree: int, n: int) -> np.ndarray:
    """Features that a tree may split on."""
    some = np.zeros(n, dtype=bool)
    draw = np.random.default_rng([setting.seed, tree]).permutation(n)
    some[draw[:max(1, round(setting.col_rate * n))]] = True
    return some


def _learn_paths(tree: _Growing, node: int, found: list[tuple[str, dict]]) -> None:
    """Put what ``finish`` found for a leaf into the tree."""
    at = {"": node}
    for path, f in found:
        tree.learn(at[path], {**f, "left": np.frombuffer(f["left"], dtype=bool)})
        for side, kid in enumerate(tree.nodes[at[path]].get("kids", [])):
            at[f"{path}{side}"] = kid


def _trees_of_rows(bins: np.ndarray, y: np.ndarray, w: np.ndarray, key: np.ndarray, sizes: np.ndarray, categorical: int, s: Boost,
                   base: float, scale: float, rows: int) -> list[Tree]:
    """All trees of a model from its rows."""
    raw, trees = np.full(len(bins), base), []
    for t in range(s.rounds):
        tree = _Growing(s, _tree_columns(s, t, len(sizes)), rows)
        on = slice(None) if s.row_rate >= 1 else np.flatnonzero(_unit(key, s.seed * 1_000_003 + t) < s.row_rate)
        g, h = _gradients(s.objective, raw[on], y[on], w[on])
        if len(g):
            _learn_paths(tree, 0, finish(bins[on], np.rint(g * scale), np.rint(h * scale), 0, sizes, categorical, s, tree.cols, scale))
        else:
            tree.learn(0, {"g": 0, "h": 0, "n": 0, "gain": 0.0})
        trees.append(tree.tree(sizes, scale)[0])
        raw += trees[-1].value[trees[-1].route(bins)]
    return trees


class _Trainer:
    """Training on a table of blocks: a row holds some thousand binned rows as one
    value and their scores as another, so that a pass hands over few values."""

    def __init__(self, table: DataFrame, binner: Binner, settings: list[Boost]):
        self.table, self.binner, self.settings = table, binner, settings
        self.sizes = binner.sizes
        sums = []
        for m, s in enumerate(settings):
            mine = F.when(F.get("member", F.lit(m)), F.col("w"))
            sums.append(F.count(mine).alias(f"n{m}"))
            sums += [F.sum(mine).alias(f"w{m}"), F.sum(mine * F.col("y")).alias(f"y{m}")]
        row = table.agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w"), F.max(F.abs("y")).alias("y"), *sums).first()
        self.boosters = [Booster(s, binner, self._base(s, row[f"w{m}"], row[f"y{m}"])) for m, s in enumerate(settings)]
        # Integer gradients: as fine as 64-bit (and exact double) sums allow.
        top = [max(row["w"] or 1.0, 1e-9) * (1.0 if s.objective == "logistic" else 4 * max(row["y"] or 1.0, 1.0)) for s in settings]
        self.scale = [2.0 ** min(30, math.floor(51 - math.log2(max(1.0, (row["n"] or 1) * t)))) for t in top]
        self.rows = [row[f"n{m}"] for m in range(len(settings))]
        self.applied = [0] * len(settings)  # trees already in the written scores
        self.rows_schema = ", ".join([*(f"`{c}` {t}" for c, t in table.dtypes), "raw array<double>"])
        bases = np.array([b.base for b in self.boosters])

        def pack(batches):
            for b in batches:
                if b.num_rows:
                    yield _Trainer._written([_block(b)], [np.tile(bases, (b.num_rows, 1))])

        self.table = self._stored(table.mapInArrow(pack, "data binary, raw binary"))

    @staticmethod
    def _written(blocks: list, raw: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary()), pa.array([r.tobytes() for r in raw], pa.binary())],
                                          names=["data", "raw"])

    @staticmethod
    def _stored(table: DataFrame) -> DataFrame:
        path = run_folder(table.sparkSession, "boosting")
        table.write.parquet(path)
        return table.sparkSession.read.parquet(path)

    @staticmethod
    def _base(s: Boost, w: float | None, y: float | None) -> float:
        if not w:
            return 0.0
        mean = (y or 0.0) / w
        if s.objective == "squared":
            return mean
        mean = min(max(mean, 1e-9), 1 - 1e-9)
        return math.log(mean / (1 - mean))

    def _scored(self, rows: pa.RecordBatch, raw: np.ndarray, applied: list[int]) -> tuple[np.ndarray, np.ndarray]:
        bins, raw = _bytes_of_rows(rows.column("bins"), len(self.sizes)), raw.copy()
        for m, b in enumerate(self.boosters):
            for t in b.trees[applied[m]:]:
                raw[:, m] += t.value[t.route(bins)]
        return bins, raw

    def write_scores(self) -> None:
        """Write the table anew with the scores of all trees so far."""
        applied = list(self.applied)
        scored = self._light(applied)

        def run(batches):
            for data, rows, raw in _blocks(batches):
                yield _Trainer._written([data.as_py()], [scored._scored(rows, raw, applied)[1]])

        self.table = self._stored(self.table.mapInArrow(run, "data binary, raw binary"))
        self.applied = [len(b.trees) for b in self.boosters]

    def scored_rows(self) -> DataFrame:
        """The rows of the blocks with ``raw``, every model's score."""
        applied = list(self.applied)
        scored = self._light(applied)

        def run(batches):
            for _, rows, raw in _blocks(batches):
                raw = scored._scored(rows, raw, applied)[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, raw.size + 1, raw.shape[1], dtype=np.int32)), pa.array(raw.ravel()))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], names=[*rows.schema.names, "raw"])

        return self._stored(self.table.mapInArrow(run, self.rows_schema))

    def _light(self, applied: list[int]) -> "_Trainer":
        """What tasks need: sizes and the trees that are not in the scores."""
        out = object.__new__(_Trainer)
        out.sizes = self.sizes
        out.boosters = [Booster(b.setting, None, b.base, [None] * a + b.trees[a:]) for b, a in zip(self.boosters, applied)]
        return out

    def train(self) -> list[Booster]:
        self._train_small([m for m, n in enumerate(self.rows) if n <= SMALL])
        growing: dict[int, _Growing] = {}
        while True:
            for m, b in enumerate(self.boosters):
                while m not in growing and len(b.trees) < b.setting.rounds:
                    growing[m] = _Growing(b.setting, self._columns(b), self.rows[m])
            if not growing:
                return self.boosters
            if max(len(b.trees) - a for b, a in zip(self.boosters, self.applied)) >= PENDING:
                self.write_scores()
            self._pass(growing)
            for m, tree in list(growing.items()):
                if not tree.open_nodes():
                    self.boosters[m].trees.append(tree.tree(self.sizes, self.scale[m])[0])
                    del growing[m]

    def _columns(self, b: Booster) -> np.ndarray:
        return _tree_columns(b.setting, len(b.trees), len(self.sizes))

    def _train_small(self, models: list[int]) -> None:
        """All trees of models whose rows one task can hold: the rows of each go to a task of its own."""
        if not models:
            return
        sizes, cats, width = self.sizes, len(self.binner.edges), len(self.sizes)
        work = {m: (self.settings[m], self.boosters[m].base, self.scale[m], self.rows[m]) for m in models}

        def send(batches):
            for _, b, _ in _blocks(batches):
                bins = _bytes_of_rows(b.column("bins"), width)
                rest = [b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "key")]
                member = b.column("member").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                rows = [(m, b"".join([x[member[:, m]].tobytes() for x in (bins, *rest)])) for m in work if member[:, m].any()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary()))],
                                                 names=["m", "data"])

        def grow(group: pa.Table) -> pa.Table:
            m, some = group.column("m")[0].as_py(), group.column("data").to_pylist()
            n = [len(x) // (width + 24) for x in some]
            bins = np.concatenate([np.frombuffer(x, np.uint8, c * width).reshape(c, width) for x, c in zip(some, n)])
            y, w, key = (np.concatenate([np.frombuffer(x, t, c, c * (width + 8 * i)) for x, c in zip(some, n)])
                         for i, t in enumerate((np.float64, np.float64, np.int64)))
            trees = _trees_of_rows(bins, y, w, key, sizes, cats, *work[m])
            return pa.table({"m": pa.array([m], pa.int32()), "trees": pa.array([pickle.dumps(trees)], pa.binary())})

        sent = self.table.mapInArrow(send, "m int, data binary").repartition(4 * len(models), "m")
        grown = {r["m"]: pickle.loads(r["trees"]) for r in sent.groupBy("m").applyInArrow(grow, "m int, trees binary").collect()}  # the models
        nothing = np.zeros((0, width), dtype=np.uint8), *[np.zeros(0)] * 2, np.zeros(0, dtype=np.int64)
        for m in models:  # a model without rows has trees of one leaf
            self.boosters[m].trees = grown[m] if m in grown else _trees_of_rows(*nothing, sizes, cats, *work[m])

    def _pass(self, growing: dict[int, _Growing]) -> None:
        """One pass: the best split of every open node of every growing tree."""
        sizes, n_bins, cats = self.sizes, int(self.sizes.sum()), len(self.binner.edges)
        applied, scored = list(self.applied), self._light(self.applied)
        work = {}
        for m, tree in growing.items():
            shape, order = tree.tree(sizes, self.scale[m])
            slot = np.full(len(order), -1, dtype=np.int64)
            opened = tree.open_nodes()
            slot[[order.index(i) for i in opened]] = np.arange(len(opened))
            b = self.boosters[m]
            small = np.array([tree.nodes[i]["n"] <= SMALL for i in opened])
            depth = [tree.nodes[i]["depth"] for i in opened]
            work[m] = (shape, slot, opened, b.setting, len(b.trees), self.scale[m], small, depth)
        cols = {m: t.cols for m, t in growing.items()}

        def count(batches):
            large = {m: np.cumsum(~w[6]) - 1 for m, w in work.items()}  # place among the leaves with histograms
            sums = {m: np.zeros((3, int((~w[6]).sum()), n_bins), dtype=np.int64) for m, w in work.items()}
            for _, b, raw in _blocks(batches):
                bins, raw = scored._scored(b, raw, applied)
                columns = np.ascontiguousarray(bins.T)
                y, w, key = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "key"))
                member = b.column("member").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                rows = []
                for m, (shape, slot, opened, s, t, scale, small, _) in work.items():
                    on = member[:, m]
                    if s.row_rate < 1:
                        on = on & (_unit(key, s.seed * 1_000_003 + t) < s.row_rate)
                    on = np.flatnonzero(on)
                    at = slot[shape.route(bins if len(on) == len(bins) else bins[on])]
                    on, at = on[at >= 0], at[at >= 0]
                    g, h = _gradients(s.objective, raw[on, m], y[on], w[on])
                    g, h = np.rint(g * scale), np.rint(h * scale)
                    for k in np.flatnonzero(small).tolist():
                        mine = at == k
                        rows.append((m, k, b"".join((bins[on[mine]].tobytes(), g[mine].tobytes(), h[mine].tobytes()))))
                    if small.all():
                        continue
                    many = ~small[at]
                    sums[m] += histogram(columns[:, on[many]], large[m][at[many]], sums[m].shape[1], g[many], h[many], sizes, cols[m])
                yield parts([r for r in rows if r[2]])
            yield parts([(m, k, sums[m][:, i].T.tobytes())
                         for m, w in work.items() for i, k in enumerate(np.flatnonzero(~w[6]).tolist())])

        def parts(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))],
                                              names=["m", "k", "data"])

        def decide(batches):
            sums: dict[tuple[int, int], np.ndarray] = {}
            whole: dict[tuple[int, int], list[bytes]] = {}
            for b in batches:
                for m, k, data in zip(*[c.to_pylist() for c in b.columns]):
                    if work[m][6][k]:
                        whole.setdefault((m, k), []).append(data)
                    elif (m, k) in sums:
                        sums[m, k] += np.frombuffer(data, dtype=np.int64).reshape(-1, 3)
                    else:
                        sums[m, k] = np.frombuffer(data, dtype=np.int64).reshape(-1, 3).copy()
            rows = [(m, k, 0, "", best_split(x, sizes, cats, work[m][3], cols[m], work[m][5])) for (m, k), x in sums.items()]
            width = len(sizes)
            for (m, k), some in whole.items():
                n = [len(x) // (width + 16) for x in some]
                bins = np.concatenate([np.frombuffer(x, np.uint8, c * width).reshape(c, width) for x, c in zip(some, n)])
                g, h = (np.concatenate([np.frombuffer(x, np.float64, c, c * (width + 8 * i)) for x, c in zip(some, n)]) for i in (0, 1))
                found = finish(bins, g, h, work[m][7][k], sizes, cats, work[m][3], cols[m], work[m][5])
                rows += [(m, k, i, path, f) for i, (path, f) in enumerate(found)]
            yield pa.RecordBatch.from_pylist([{"m": m, "k": k, "i": i, "path": path, **f} for m, k, i, path, f in rows], schema=pa.schema(
                [("m", pa.int32()), ("k", pa.int32()), ("i", pa.int32()), ("path", pa.string()), ("g", pa.int64()), ("h", pa.int64()),
                 ("n", pa.int64()), ("gain", pa.float64()), ("feat", pa.int32()), ("left", pa.binary()), ("gl", pa.int64()),
                 ("hl", pa.int64()), ("nl", pa.int64())]))

        leaves = sum(len(w[2]) for w in work.values())
        data = self.table.mapInArrow(count, "m int, k int, data binary")
        cores = self.table.sparkSession.sparkContext.defaultParallelism
        # Some parts more than leaves, so that few large leaves seldom share a task.
        best = data.repartition(max(min(4 * leaves, 2 * cores), leaves // 16), "m", "k").mapInArrow(
            decide, "m int, k int, i int, path string, g long, h long, n long, gain double, feat int, left binary, gl long, hl long, nl long")
        at: dict[tuple[int, int, str], int] = {}
        answered = set()
        for r in sorted(best.collect(), key=lambda r: (r["m"], r["k"], r["i"])):  # rows for each open leaf, few each
            m, k, path = r["m"], r["k"], r["path"]
            node = at.get((m, k, path), work[m][2][k])
            found = {c: r[c] for c in ("g", "h", "n", "gain", "feat", "gl", "hl", "nl")}
            growing[m].learn(node, {**found, "left": np.frombuffer(r["left"], dtype=bool)})
            answered.add((m, k))
            for side, kid in enumerate(growing[m].nodes[node].get("kids", [])):
                at[m, k, f"{path}{side}"] = kid
        for m, w in work.items():  # a leaf that no row reached stays one
            for k, i in enumerate(w[2]):
                if (m, k) not in answered:
                    growing[m].learn(i, {"g": 0, "h": 0, "n": 0, "gain": 0.0})


def fit_many(table: DataFrame, binner: Binner, settings: list[Boost]) -> tuple[list[Booster], DataFrame]:
    """Train model ``i`` with ``settings[i]`` on the rows of a ``binned_table``
    whose ``member[i]`` is set. All models advance in the same passes. Returns
    the models and the table with ``raw``, every model's score of every row."""
    trainer = _Trainer(table, binner, settings)
    models = trainer.train()
    return models, trainer.scored_rows()


def f1_by(scored: DataFrame, masks: list[Column]) -> list[tuple[float, int]]:
    """F1 of the positive class and the number of rows for model ``i`` over the
    rows of ``masks[i]``, all from one aggregate."""
    aggs = []
    for i, mask in enumerate(masks):
        yes, y = F.get("raw", F.lit(i)) > 0, F.col("y") == 1
        aggs += [F.count_if(mask & y & yes).alias(f"tp{i}"), F.count_if(mask & (y != yes)).alias(f"bad{i}"),
                 F.count_if(mask).alias(f"n{i}")]
    row = scored.agg(*aggs).first()
    out = []
    for i in range(len(masks)):
        den = 2 * row[f"tp{i}"] + row[f"bad{i}"]
        out.append((2 * row[f"tp{i}"] / den if den else 0.0, row[f"n{i}"]))
    return out
