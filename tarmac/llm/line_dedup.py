"""Line deduplication by winnowing over line hashes.

The lines of a document that are not blank form a sequence of hashes. A window
is the shortest run of lines from a given line on, or up to a given line, that
has at least ``min_words`` words, and its fingerprint is its smallest line hash.
Whatever run of that many words two places share, they share its windows and so
a selected fingerprint (the guarantee of winnowing).

The windows of a shared run cover all its lines: if the run has ``min_words``
words up to a line, the window that ends there lies inside it, and otherwise the
window that starts at the run's first line reaches past that line.

Positions with one fingerprint match as far as the lines on both sides of it
agree. A match is extended from the fingerprint's line back to a window's first
line and on to its last, and 128-bit digests of the windows' lines tell which
positions agree that far. Of those, every one but the first (by document id,
text hash and line) is a later repeat; overlapping repeats merge into runs that
reach as far as any earlier document agrees, and their lines are deleted.
Positions that agree are reduced to the first before the shuffle and then joined
to it, so no pairs arise, and a frequent line is one key for each different
window around it, not one for all of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import byte_slices, join_on_key, quoted, shared_table, shielded, small_batches, unshielded, with_key

MIN_WORDS = 25


def line_windows(raw: bytes, min_words: int) -> list[tuple[int, int, int, int, bytes]]:
    """Windows of a text, from and up to every line: (first line, last line,
    fingerprint, its line, 16-byte digest). Lines are numbered in the text, blank ones
    included, from 0."""
    at, digests, words = [], [], []
    for i, line in enumerate(raw.split(b"\n")):
        n = len(line.split())
        if n:
            at.append(i)
            digests.append(xxhash.xxh3_128_digest(line.strip()))
            words.append(n)
    total = np.concatenate(([0], np.cumsum(words))).astype(np.int64)
    ends = np.searchsorted(total, total[:-1] + min_words, side="left") - 1
    starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    joined = b"".join(digests)
    h = np.frombuffer(joined, dtype="<u8")[::2]
    out = []
    forwards = {(s, e) for s, e in enumerate(ends.tolist()) if e < len(at)}
    for s, e in sorted(forwards.union((s, e) for e, s in enumerate(starts.tolist()) if s >= 0)):
        low = s + int(h[s:e + 1].argmin())
        digest = digests[s] if s == e else xxhash.xxh3_128_digest(joined[16 * s:16 * e + 16])
        out.append((at[s], at[e], int(h[low]), at[low], digest))
    return out


def _windows(docs: DataFrame, min_words: int) -> DataFrame:
    src = docs.select("__id", "__tk", F.col("__text").cast("binary").alias("raw")).filter("raw IS NOT NULL")
    schema = f"__id {src.schema['__id'].dataType.simpleString()}, __tk long, s int, e int, f long, c binary"

    def run(batches):
        for batch in batches:
            for b in byte_slices(batch, 2):
                row, found = [], []
                for i, raw in enumerate(b.column(2)):
                    w = line_windows(raw.as_py(), min_words)
                    row += [i] * len(w)
                    found += w
                s, e, f, _, c = zip(*found) if found else [()] * 5
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(s, pa.int32()), pa.array(e, pa.int32()),
                     pa.array(np.array(f, dtype=np.uint64).view(np.int64)), pa.array(c, pa.binary())],
                    names=["__id", "__tk", "s", "e", "f", "c"])

    return src.mapInArrow(run, schema)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = MIN_WORDS) -> DataFrame:
    """Later repeated windows as line ranges: ``__id``, ``__tk`` (document key),
    ``s``, ``e`` (first and last line); overlapping ones form the runs."""
    rows = with_key(docs.select(F.col(quoted(id_col)), F.col(quoted(text_col)).alias("__text")), id_col, "__text")
    small_batches(docs.sparkSession)
    win = shared_table(_windows(rows, min_words), "windows")
    place = F.struct("__id", "__tk", "s")
    agreed = win.groupBy("f", "c").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # A repeated row has equal positions and is the same document: no repeat of itself.
    several = agreed.filter("first <> last").select("f", "c", "first")
    return win.join(several, ["f", "c"]).filter(place != F.col("first")).select("__id", "__tk", "s", "e")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later repeated runs deleted from the text, plus
    ``lines_removed`` (long; an equally named input column is replaced).

    Of every run the first occurrence stays: documents are ordered by id (null
    first) and then by text hash. Every different line survives somewhere. A
    blank line goes with the line before it. Null and empty texts stay as they
    are, and rows that repeat id and text count as one document and are equal
    in the result. Documents of at least ``min_words`` words that repeat others
    entirely lose every word; shorter ones stay.
    """
    docs, names = shielded(docs)
    id_col, text_col = names.get(id_col, id_col), names.get(text_col, text_col)
    runs = repeated_runs(docs, id_col, text_col, min_words).groupBy("__id", "__tk").agg(
        F.collect_set(F.struct("s", "e")).alias("__runs"))
    both = join_on_key(with_key(docs, id_col, text_col), runs, "left")

    @F.pandas_udf("text string, gone long")
    def cut(text: pd.Series, runs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([without_lines(t, r) for t, r in zip(text, runs)], columns=["text", "gone"])

    # Only texts that lose lines go to Python, and once: a filter on the result
    # would else run it again.
    text, some = F.col(quoted(text_col)), F.col("__runs").isNotNull()
    done = both.withColumn("__cut", cut.asNondeterministic()(F.when(some, text), F.col("__runs")))
    keep = [c for c in docs.columns if c != "lines_removed"]
    return unshielded(done.select(
        *[F.when(some, F.col("__cut.text")).otherwise(text).alias(c) if c == text_col else F.col(quoted(c)) for c in keep],
        F.col("__cut.gone").alias("lines_removed")), names)


def without_lines(text: str | None, runs) -> tuple[str | None, int]:
    if runs is None or text is None:
        return text, 0
    lines = text.split("\n")
    edge = np.zeros(len(lines) + 1, dtype=np.int64)
    for r in runs:
        edge[r["s"]] += 1
        edge[r["e"] + 1] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    for i, line in enumerate(lines):
        if i and gone[i - 1] and not line.strip():
            gone[i] = True
    return "\n".join(x for x, g in zip(lines, gone) if not g), int(gone.sum())
