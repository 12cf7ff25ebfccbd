"""Best-fit packing of tokenised documents into sequences of fixed capacity.

The plan is made on counts: a histogram of piece lengths has at most
``capacity`` entries whatever the corpus. Working down from the longest pieces,
the gap that a length leaves is looked up among the single lengths, the sums of
two and the sums of three that are still available (exact complements); a found
combination is consumed as often as its counts allow. What has no exact
complement is filled best-fit. The plan, a list of patterns with repeat counts,
is then dealt to the pieces by their rank within their length. A piece of full
length is a sequence and needs no rank; the others are ranked in as many buckets
as their length's count asks for.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import quoted, shared_table, small_batches

CAPACITY = 2048
#: Text of other characters, or naming a special token, goes to the
#: ``tokenizers`` library; the rest to the same vocabulary as ranks, which
#: gives the same ids several times as fast.
PLAIN = re.compile("[^\x00-ɏ]|<\\|")
#: Pieces of one length that a task ranks at once, about.
RANKED_TOGETHER = 50_000

_TOKENIZERS: dict[str, object] = {}


def tokenizer(json_path: str, ranks_path: str | None = None):
    """Function from a text to its ids as ``uint32``; kept per worker process."""
    key = f"{json_path}|{ranks_path}"
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = _load(json_path, ranks_path)
    return _TOKENIZERS[key]


def _load(json_path: str, ranks_path: str | None):
    slow: list = []

    def exact(text: str) -> np.ndarray:
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(json_path))
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, dtype="<u4")

    if ranks_path is None:
        return exact
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if PLAIN.search(text):
            return exact(text)
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    return encode


def pieces(docs: DataFrame, json_path: str, ranks_path: str | None, capacity: int = CAPACITY, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of every row: ``doc_id``, ``piece``, ``start``, ``length``,
    ``ids_crc32`` (and ``ids``). A document is its ids and then id 0; a null or
    empty text is id 0 alone. Only longer ones are cut, into pieces of
    ``capacity`` ids of which the first may be shorter."""
    src = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches):
        encode = tokenizer(json_path, ranks_path)
        for b in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(0)).astype("<u4", copy=False)
                cut = (len(ids) - 1) % capacity + 1
                bounds = [0, *range(cut, len(ids) + 1, capacity)]
                for k, (a, z) in enumerate(zip(bounds, bounds[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(z - a)
                    crc.append(zlib.crc32(ids[a:z].tobytes()))
                    if with_ids:
                        kept.append(ids[a:z].astype(np.int64))
            cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(kept, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(run, schema)


def _complement(avail: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """Up to three available lengths that sum to ``gap``, longest first."""
    if gap == 0:
        return ()
    if avail[gap]:
        return (gap,)

    def pair(total: int, top: int) -> tuple[int, int] | None:
        a = np.arange(min(total - 1, top), (total - 1) // 2, -1)
        if len(a) == 0:
            return None
        ok = (avail[a] > 0) & (avail[total - a] > (a == total - a))
        return (int(a[k]), total - int(a[k])) if ok[k := int(ok.argmax())] else None

    if gap >= 2 and (found := pair(gap, gap)):
        return found
    if gap < 3:
        return None
    there = (avail[:gap] > 0).astype(np.float32)
    sums = np.convolve(there, there)[:gap + 1]  # sums of two available lengths
    for a in np.flatnonzero((there > 0) & (sums[gap - np.arange(gap)] > 0))[::-1].tolist():
        avail[a] -= 1
        found = pair(gap - a, a)
        avail[a] += 1
        if found:
            return (a, *found)
    return None


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns ``({length: pieces in a sequence}, sequences)`` that use up ``counts``
    (index: length, 0 to capacity)."""
    avail = np.array(counts, dtype=np.int64)
    out = []
    for top in range(capacity, 0, -1):
        while avail[top] > 0:
            content, gap = {top: 1}, capacity - top
            avail[top] -= 1
            while gap > 0:
                found = _complement(avail[:gap + 1], gap)
                if found is None:  # best fit: the longest that fits
                    fits = np.flatnonzero(avail[1:gap + 1])
                    if len(fits) == 0:
                        break
                    found = (int(fits[-1]) + 1,)
                for n in found:
                    content[n] = content.get(n, 0) + 1
                    avail[n] -= 1
                gap -= sum(found)
            more = min(int(avail[n]) // k for n, k in content.items())
            for n, k in content.items():
                avail[n] -= more * k
            out.append((content, more + 1))
    return out


def _places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces of it in a sequence, first
    sequence, offset), by first rank."""
    ranks, out, sequence = {}, {}, 0
    for content, times in patterns:
        offset = 0
        for n, k in content.items():
            at = ranks.get(n, 0)
            out.setdefault(n, []).append((at, k, sequence, offset))
            ranks[n] = at + k * times
            offset += k * n
        sequence += times
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


def pack(pieces_table: DataFrame, capacity: int = CAPACITY, row: Column | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces with a ``length``
    from 1 to ``capacity``. The table is read several times and should be
    materialised. Repeated rows are packed each, and spread over the buckets of
    their length when ``row`` tells them apart; an empty table gives an empty result."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces_table.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    buckets = -(-counts // RANKED_TOGETHER)
    counts[capacity] = 0
    patterns = plan(counts, capacity)
    places, sequences = _places(patterns), sum(times for _, times in patterns)

    among = F.get(F.split(F.lit(",".join(map(str, buckets))), ",").cast("array<int>"), F.col("length").cast("int"))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", *([] if row is None else [row])), among)
    rows = pieces_table.withColumn("__b", bucket).filter(F.col("length") < capacity)
    sizes = shared_table(rows.groupBy("length", "__b").agg(F.count("*").alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy("length", "__b").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = (rows.withColumn("__r", F.row_number().over(within)).join(first, ["length", "__b"])
              .withColumn("__rank", F.col("__first") + F.col("__r") - 1))
    names = pieces_table.columns
    schema = ", ".join(f"{quoted(c)} {t}" for c, t in pieces_table.dtypes) + ", sequence_id long, offset long"

    def deal(batches):
        for b in batches:
            length, rank = b.column(names.index("length")).to_numpy(), b.column(len(names)).to_numpy()
            seq, off = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            for n in np.unique(length):
                rows, at = places[int(n)], np.flatnonzero(length == n)
                hit = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                inside = rank[at] - hit[:, 0]
                seq[at] = hit[:, 2] + inside // hit[:, 1]
                off[at] = hit[:, 3] + inside % hit[:, 1] * n
            cols = [b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    dealt = ranked.select(*[quoted(c) for c in names], "__rank").mapInArrow(deal, schema)
    full = pieces_table.filter(F.col("length") == capacity).select(
        *[quoted(c) for c in names], (F.monotonically_increasing_id() + sequences).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    return dealt.unionByName(full)


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str | None = None, capacity: int = CAPACITY,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack whole documents; see ``pieces`` and ``pack``."""
    small_batches(docs.sparkSession)
    table = shared_table(pieces(docs, json_path, ranks_path, capacity, id_col, text_col, with_ids), "pieces")
    return pack(table, capacity, F.xxhash64("_metadata.file_name", "_metadata.row_index"))
