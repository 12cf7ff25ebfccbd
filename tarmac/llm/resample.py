"""Resampling of documents towards a target distribution, with exact integer
weights from bit-sliced counts.

Features are runs of words, hashed into buckets. A bucket's gain is the scaled
log-ratio of its smoothed shares in the target and in the corpus. A document's
weight is the mean gain over its features: its bucket counts are cut into bit
planes (plane ``j`` holds bit ``j`` of every bucket's count), the gains into
planes of their two's complement, and the sum over buckets of count times gain
is the sum over pairs of planes of ``2^(j+k)`` times the population count of
their AND; the planes of the gains' sign count negatively. Gumbel noise from a
hash of the id turns the weights into a draw without replacement: the highest
scores are taken.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import quoted, shared_table

BUCKETS, RUN, PERCENT, MIN_WORDS, SEED, SCALE = 10_000, 1, 10, 20, 2024, 1000
#: A-Z in lower case, word bytes (0-9, a-z and all outside ASCII) as they are, others blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Bytes of text cut into words at a time; documents and features summed at a time.
STEP, DOCS, FEATURES = 1 << 20, 512, 1 << 18


def bucket_runs(text: str | None, buckets: int = BUCKETS, run: int = RUN):
    """Buckets of a text's features, a stretch at a time, with the number of words in it."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS)
    at, before = 0, []
    while at < len(raw):
        end = raw.find(b" ", at + STEP)
        end = len(raw) if end < 0 else end
        words = raw[at:end].split()
        parts = [np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))]
        line = before + words
        for n in range(2, run + 1):  # runs that end in this stretch
            first = max(0, len(before) - n + 1)
            grams = [b" ".join(line[i:i + n]) for i in range(first, len(line) - n + 1)]
            parts.append(np.fromiter(map(zlib.crc32, grams), dtype=np.uint32, count=len(grams)))
        yield np.concatenate(parts) % buckets, len(words)
        before = line[max(0, len(line) - run + 1):] if run > 1 else []
        at = end


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """Features of all texts in each bucket. One row for each bucket reaches the driver."""

    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for text in b.column(0):
                for found, _ in bucket_runs(text.as_py(), buckets, run):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    parts = docs.select(F.col(quoted(text_col)).alias("text")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Gain of every bucket from its counts in the corpus and in the target."""
    s_all, t_all, b = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(scale * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b))))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of integers (two's complement), 64 to a word: (bits, words)."""
    pad = -len(values) % 64
    of = [(values >> k) & 1 for k in range(bits)]
    return np.array([np.packbits(np.pad(x, (0, pad)).astype(np.uint8), bitorder="little").view("<u8") for x in of])


def plane_sums(doc: np.ndarray, bucket: np.ndarray, count: np.ndarray, n_docs: int, gain_planes: np.ndarray) -> np.ndarray:
    """Sum of count times gain for every document; each (document, bucket) is listed once."""
    out = np.zeros(n_docs, dtype=np.int64)
    top = len(gain_planes) - 1
    for j in range(int(count.max(initial=0)).bit_length()):
        on = np.flatnonzero((count >> j) & 1)
        rows, row = np.unique(doc[on], return_inverse=True)
        plane = np.zeros((len(rows), gain_planes.shape[1]), dtype=np.uint64)
        bit = np.uint64(1) << (bucket[on] & 63).astype(np.uint64)
        np.bitwise_or.at(plane, (row, bucket[on] >> 6), bit)
        for k, gain in enumerate(gain_planes):
            both = np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64) << (j + k)
            out[rows] += -both if k == top else both
    return out


class _Block:
    """Documents whose feature counts are being gathered."""

    def __init__(self, buckets: int, gain_planes: np.ndarray):
        self.buckets, self.gain_planes = buckets, gain_planes
        self.keys, self.counts, self.held, self.n = [], [], 0, 0

    def add(self, found: np.ndarray) -> None:
        self.keys.append(found.astype(np.int64) + self.n * self.buckets)
        self.counts.append(np.ones(len(found), dtype=np.int64))
        self.held += len(found)
        if self.held >= FEATURES:
            self._compact()

    def _compact(self) -> None:
        if self.keys:
            keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
            counts = np.zeros(len(keys), dtype=np.int64)
            np.add.at(counts, at, np.concatenate(self.counts))
            self.keys, self.counts = [keys], [counts]
            self.held = len(keys) // 2  # what stays is no reason to compact again

    def sums(self) -> np.ndarray:
        self._compact()
        keys, counts = (self.keys[0], self.counts[0]) if self.keys else (np.empty(0, np.int64),) * 2
        return plane_sums(keys // self.buckets, keys % self.buckets, counts, self.n, self.gain_planes)


def gumbel(seed: int, doc_id: str | None) -> int:
    """Scaled Gumbel noise of an id."""
    h = int(hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
          buckets: int = BUCKETS, run: int = RUN, seed: int = SEED) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``n_features``, ``weight``
    and ``score``. Texts that are null or have no words have no features and a
    weight of 0; a null id takes its noise from the empty text. An empty corpus
    or target has no features and smoothed shares of its own. Repeated rows get
    equal answers; other columns are ignored."""
    gain = gains(bucket_counts(docs, text_col, buckets, run), bucket_counts(target, target_col, buckets, run))
    bits = int(np.abs(gain).max()).bit_length() + 1
    gain_planes = planes(gain, bits)
    doc_id = F.col(quoted(id_col))
    src = docs.select(doc_id.alias("doc_id"), doc_id.cast("string").alias("name"), F.col(quoted(text_col)).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run_(batches):
        for b in batches:
            words, features, total = (np.zeros(b.num_rows, dtype=np.int64) for _ in range(3))
            block, first = _Block(buckets, gain_planes), 0
            for row in range(b.num_rows):
                for found, n in bucket_runs(b.column(2)[row].as_py(), buckets, run):
                    block.add(found)
                    words[row] += n
                    features[row] += len(found)
                block.n += 1
                if block.n == DOCS or block.held >= FEATURES or row + 1 == b.num_rows:
                    total[first:row + 1] = block.sums()
                    block, first = _Block(buckets, gain_planes), row + 1
            weight = total // np.maximum(features, 1)
            noise = np.array([gumbel(seed, x.as_py()) for x in b.column(1)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (words, features, weight, weight + noise))],
                                             names=["doc_id", "n_words", "n_features", "weight", "score"])

    return src.mapInArrow(run_, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """``weigh`` plus ``rank``: of the documents with at least ``min_words`` words
    the highest-scored ``percent`` in a hundred (rounded down) are drawn, ties by
    smaller id, and numbered from 1; the others' rank is null. Null ids come
    last among ties; rows that repeat in id and score are numbered one by one.

    Scores are integers of a range set by the gains and the noise (well under
    200,000 values), so their histogram is a small table: it gives every score
    the number of documents above it, and only ties are sorted."""
    rows = shared_table(weigh(docs, target, **options), "weights")
    may = F.col("n_words") >= min_words
    every = Window.orderBy(F.desc("score"))
    sizes = rows.filter(may).groupBy("score").agg(F.count("*").alias("n"))
    above = sizes.select("score", (F.sum("n").over(every) - F.col("n")).alias("above"), F.sum("n").over(Window.partitionBy()).alias("all"))
    taken = shared_table(above.withColumn("draw", F.floor(percent * F.col("all") / 100)).filter("above < draw").drop("all"), "drawn-scores")
    cut = taken.agg(F.min("score")).first()[0]
    drawn = may & (F.col("score") >= cut) if cut is not None else F.lit(False)
    # Equal rows are one group until their ranks are known.
    ties = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_words", "n_features", "weight")
    groups = rows.filter(drawn).groupBy(*rows.columns).agg(F.count("*").alias("m")).join(F.broadcast(taken), "score")
    upto = F.sum("m").over(ties.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    groups = groups.withColumn("last", F.col("above") + upto)
    rank = F.explode(F.sequence(F.col("last") - F.col("m") + 1, F.col("last")))
    ranked = groups.select(*rows.columns, "draw", rank.alias("rank"))
    ranked = ranked.select(*rows.columns, F.when(F.col("rank") <= F.col("draw"), F.col("rank")).alias("rank"))
    rest = rows.filter(~drawn).select("*", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)
