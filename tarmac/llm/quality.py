"""Quality classification by co-training of two views.

One naive Bayes classifier sees the text (hashed words it contains, character
statistics), the other the page's metadata (source, language, declared size and
line layout). In every round each labels all unlabelled documents it is sure of,
and these pseudo-labels, beside the true ones, train the other. Both are then
calibrated on held-back labels and their log-odds are combined to score every
document.

Training is counting: a round is one pass over a table of features that sums, for
both classes, the documents with each feature. The counts are whole numbers over
all documents, so the models do not depend on partitions or retries. The texts
are read once; a pass shuffles at most ``2 * SIZE`` counts a task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import byte_slices, quoted, shared_table

#: Held-back labelled documents that calibrate the views, at most.
CALIBRATED = 4000
#: Rounds of exchange, and the log-odds from which a view is sure (nine to one).
ROUNDS, SURE = 4, math.log(9)
BUCKETS, META_BUCKETS, CACHE = 1 << 13, 1 << 9, 200_000
STATS, LEVELS, META = 8, 32, 6
#: All features of both views: words, levels of the statistics, metadata.
TEXT_SIZE = BUCKETS + STATS * LEVELS
SIZE = TEXT_SIZE + META_BUCKETS
RIDGE = 0.1


class Words:
    """Hashed bucket of a word, cached within bounds."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def ids(self, text: str) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known.clear()
        known, words = self.known, text.split()
        for w in words:
            if w not in known:
                known[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % BUCKETS
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))


def text_stats(text: str, ids: np.ndarray) -> list[float]:
    """Shares of kinds of characters, and how much the words repeat."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(b) or not len(ids):
        return [0.0] * STATS
    kinds = np.bincount(b, minlength=256) / len(b)
    punct = kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()
    return [10 * kinds[65:91].sum(), 10 * kinds[48:58].sum(), 10 * punct, 10 * kinds[33], 10 * kinds[124],
            float(len(ids) > 1 and (ids[1:] == ids[:-1]).mean()) * 5, len(np.unique(ids)) / len(ids),
            len(b) / len(ids) / 10]


def stat_levels(stats: list[float]) -> np.ndarray:
    """Each statistic's level, finer near zero, as a number among all of them."""
    level = (np.sqrt(np.array(stats) / 5) * LEVELS).astype(np.int64).clip(0, LEVELS - 1)
    return level + np.arange(STATS) * LEVELS


def meta_ids(source, lang, n_chars, text: str) -> list[int]:
    """Hashed metadata: source, language, their pair, size class and layout."""
    lines = text.count("\n") + 1
    size = int(math.log2(1 + max(0, n_chars if n_chars is not None else 0)) * 2)
    layout = int(math.log2(1 + len(text) / lines) * 2)
    names = [f"s{source}", f"l{lang}", f"sl{source}|{lang}", f"n{size}", f"r{int(math.log2(lines))}", f"w{layout}"]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % META_BUCKETS for x in names]


def features(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``words`` (different word buckets) and ``rest`` (levels of the
    statistics, then metadata) as 16-bit numbers; of columns ``doc_id, text,
    source, lang, n``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known = Words()
        for batch in batches:
            for b in byte_slices(batch, 1):
                words, rest = [], []
                for text, *meta in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                    text = text or ""
                    ids = known.ids(text)
                    words.append(np.unique(ids).astype("<u2").tobytes())
                    row = [*stat_levels(text_stats(text, ids)), *meta_ids(*meta, text)]
                    rest.append(np.array(row, dtype="<u2").tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary()), pa.array(rest, pa.binary())],
                                                 names=["doc_id", "words", "rest"])

    return docs.select("doc_id", "text", "source", "lang", "n").mapInArrow(run, f"doc_id {kind}, words binary, rest binary")


@dataclass
class Rows:
    """Features of some documents: word buckets end to end, and the others."""

    flat: np.ndarray
    owner: np.ndarray
    n_words: np.ndarray
    stats: np.ndarray
    meta: np.ndarray

    @classmethod
    def of(cls, words: list[bytes], rest: list[bytes]) -> Rows:
        flat = np.frombuffer(b"".join(words), dtype="<u2").astype(np.int64)
        n = np.array([len(w) // 2 for w in words], dtype=np.int64)
        other = np.frombuffer(b"".join(rest), dtype="<u2").astype(np.int64).reshape(-1, STATS + META)
        return cls(flat, np.repeat(np.arange(len(n)), n), n, other[:, :STATS], other[:, STATS:])

    def counts(self, for_text: np.ndarray, for_meta: np.ndarray) -> np.ndarray:
        """Documents with each feature; the masks choose who counts in which view."""
        out = np.bincount(self.flat[for_text[self.owner]], minlength=SIZE)
        out += np.bincount(BUCKETS + self.stats[for_text].ravel(), minlength=SIZE)
        return out + np.bincount(TEXT_SIZE + self.meta[for_meta].ravel(), minlength=SIZE)


@dataclass
class Views:
    """Both classifiers: log-ratio of every feature, and a calibration of each view."""

    ratio: np.ndarray
    text: np.ndarray = field(default_factory=lambda: np.zeros(STATS + 2))
    meta: np.ndarray = field(default_factory=lambda: np.zeros(META + 1))

    @classmethod
    def of(cls, counts: np.ndarray) -> Views:
        """From (2, SIZE) counts of bad and good documents, plus one each."""
        groups = [slice(0, BUCKETS), *[slice(BUCKETS + i * LEVELS, BUCKETS + (i + 1) * LEVELS) for i in range(STATS)],
                  slice(TEXT_SIZE, SIZE)]
        ratio = np.zeros(SIZE)
        for g in groups:
            c = counts[:, g] + 1.0
            rate = np.log(c / c.sum(axis=1, keepdims=True))
            ratio[g] = rate[1] - rate[0]
        return cls(ratio)

    def margins(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Columns that the calibration weighs, for the text and the metadata view."""
        n = len(rows.n_words)
        words = np.bincount(rows.owner, weights=self.ratio[rows.flat], minlength=n) / np.sqrt(np.maximum(rows.n_words, 1))
        one = np.ones((n, 1))
        return (np.hstack([words[:, None], self.ratio[BUCKETS + rows.stats], one]),
                np.hstack([self.ratio[TEXT_SIZE + rows.meta], one]))

    def calibrate(self, rows: Rows, y: np.ndarray) -> Views:
        self.text, self.meta = (_logistic(x, y) for x in self.margins(rows))
        return self

    def logits(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        text, meta = self.margins(rows)
        return text @ self.text, meta @ self.meta


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic fit by Newton steps, drawn to zero by ``RIDGE``."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - RIDGE * w)
        w = w + step / max(1.0, np.abs(step).max())
    return w


def tally(table: DataFrame, views: Views | None = None) -> np.ndarray:
    """Counts by class, (2, SIZE), over all rows of a feature table. Without
    ``views`` the label ``good`` decides in both; otherwise the metadata view's
    sure answers count in the text view and the reverse."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((2, SIZE), dtype=np.int64)
        for batch in batches:
            for b in byte_slices(batch, 0):
                rows = Rows.of(b.column(0).to_pylist(), b.column(1).to_pylist())
                if views is None:
                    text = meta = np.array(b.column(2).to_pylist(), dtype=float) * 2 - 1
                else:
                    text, meta = (z * (np.abs(z) >= SURE) for z in views.logits(rows))
                for c, sign in ((0, -1), (1, 1)):
                    total[c] += rows.counts(meta * sign > 0, text * sign > 0)
        c, i = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(total[c, i])],
                                         names=["c", "i", "n"])

    sums = table.select("words", "rest", "good").mapInArrow(run, "c int, i int, n long").groupBy("c", "i").agg(F.sum("n").alias("n"))
    out = np.zeros((2, SIZE), dtype=np.int64)
    for r in sums.collect():  # at most 2 * SIZE rows
        out[r["c"], r["i"]] = r["n"]
    return out


def joined_counts(true: np.ndarray, pseudo: np.ndarray) -> np.ndarray:
    """True and pseudo-labelled counts; in each class and view the pseudo-labels
    weigh at most as much as the true ones, at every size of the input."""
    out = true.astype(float)
    for g in (slice(0, TEXT_SIZE), slice(TEXT_SIZE, SIZE)):
        a, b = true[:, g].sum(axis=1, keepdims=True), pseudo[:, g].sum(axis=1, keepdims=True)
        out[:, g] += pseudo[:, g] * (a / np.maximum(np.maximum(a, b), 1))
    return out


def co_train(table: DataFrame, calibrated: int = CALIBRATED, rounds: int = ROUNDS) -> tuple[Views | None, float]:
    """Both views and the prior log-odds of good, from a feature table with a
    nullable label ``good``; (None, 0) when the labels are not of two classes."""
    labelled, others = table.filter("good IS NOT NULL"), table.filter("good IS NULL")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    n = {(r["held"], r["good"]): r["n"] for r in labelled.groupBy(held.alias("held"), "good").agg(F.count("*").alias("n")).collect()}
    good, bad = (n.get((True, c), 0) + n.get((False, c), 0) for c in (True, False))
    if not good or not bad:
        return None, 0.0
    # A class that lies on one side of the cut only: all labels train and calibrate.
    cut = all(n.get((h, c), 0) for h in (True, False) for c in (True, False))
    sample = (labelled.filter(held) if cut else labelled).orderBy(F.xxhash64("doc_id", F.lit("order")), "doc_id", "words", "rest").limit(calibrated)
    kept = sample.select("words", "rest", "good").collect()
    rows, y = Rows.of([bytes(r["words"]) for r in kept], [bytes(r["rest"]) for r in kept]), np.array([float(r["good"]) for r in kept])
    true = tally(labelled.filter(~held) if cut else labelled)
    views = Views.of(true).calibrate(rows, y)
    for _ in range(rounds):
        views = Views.of(joined_counts(true, tally(others, views))).calibrate(rows, y)
    return views, math.log(good / bad)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars",
                  label_id: str = "doc_id", label_col: str = "quality", calibrated: int = CALIBRATED,
                  rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``p_text``, ``p_meta`` (calibrated
    probabilities of good quality), ``score`` (combined) and ``keep`` (score >= 0.5).

    All documents take part with their whole texts: labelled ones by their label
    (of repeated labels the mean, 0.5 or more is good), the others by
    pseudo-labels. A quarter of the labelled ones, at most ``calibrated`` by a
    hash of the id, calibrates. With labels of one class only, or none, every
    score is 0.5 and all are kept. Null texts count as empty, other nulls as a
    value of their own; a null id has no label; repeated rows get equal answers.
    """
    names = [id_col, text_col, source_col, lang_col, size_col]
    rows = docs.select(*[F.col(quoted(c)).alias(a) for c, a in zip(names, ["doc_id", "text", "source", "lang", "n"])])
    lab = (labels.select(F.col(quoted(label_id)).alias("id"), F.col(quoted(label_col)).cast("double").alias("y"))
           .filter("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg((F.avg("y") >= 0.5).alias("good")))
    found = features(rows)
    table = shared_table(found.join(lab, found["doc_id"] == lab["id"], "left").drop("id"), "quality")
    views, prior = co_train(table, calibrated, rounds)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for b in byte_slices(batch, 1):
                logits = [np.zeros(b.num_rows)] * 2
                if views is not None:
                    logits = views.logits(Rows.of(b.column(1).to_pylist(), b.column(2).to_pylist()))
                p = [1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (*logits, logits[0] + logits[1] - prior)]
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, p), pa.array(p[2] >= 0.5)],
                                                 names=["doc_id", "p_text", "p_meta", "score", "keep"])

    return table.select("doc_id", "words", "rest").mapInArrow(
        run, f"doc_id {kind}, p_text double, p_meta double, score double, keep boolean")
