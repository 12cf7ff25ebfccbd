"""Removal of repeated byte strings with two-stage suffix sorting.

A byte goes when a string of ``length`` bytes that covers it also starts
anywhere else. Suffixes that share ``length`` bytes have to meet in one suffix
array, and no task can hold the corpus, so suffixes are dealt by content:

1. Every window of ``length`` bytes is anchored at its smallest ``GRAM``-byte
   hash. Equal windows have equal anchors, so a window can only repeat among the
   windows of its anchor. Consecutive windows of one anchor form a region.
   Regions whose anchor occurs once are unique and go no further.
2. Of the rest, equal regions are one slice with a multiplicity. Slices are dealt
   to tasks by anchor; an anchor with many slices is spread over several shards.
3. A task lays its slices end to end and sorts their suffixes in two stages:
   those smaller than their successor directly, the others by induction in one
   scan over the buckets of first bytes. Neighbours whose common prefix reaches
   ``length`` are repeated.
4. Shards of one anchor exchange digests of the windows they could not match.

The suffixes' order is exact to ``length`` bytes, which is all that is needed.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import byte_slices, join_on_key, quoted, shared_table, with_key

LENGTH, GRAM = 200, 32
#: Bytes anchored and bytes sorted at a time; slices of an anchor in one shard.
STEP, SORT_BYTES, SHARD = 1 << 18, 1 << 17, 500
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        x = np.full(n, base, dtype=np.uint64)
        x[0] = 1
        return np.multiply.accumulate(x)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def regions(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Regions of texts laid end to end: text index, first and last window start
    in the text, anchor hash, hash of the region's bytes."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    b = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n, none = len(b), tuple(np.empty(0, dtype=np.int64) for _ in range(5))
    if n < length:
        return none
    up, down = _powers(max(2 * STEP, n + 1))
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + _U(1)) * up[:n], out=total[1:])
    g = _mix((total[gram:] - total[:-gram]) * down[:n - gram + 1])
    # Low bits hold the place: ties of the hash go to the first place.
    low = (g & ~_U(0xFFFFFFFF)) | np.arange(len(g), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[:len(low) - (width - have)], low[width - have:])
    anchor = (low & _U(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    count = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + starts[owner]
    if not len(at):
        return none
    new = np.flatnonzero(np.concatenate(([True], (np.diff(anchor[at]) != 0) | (np.diff(owner) != 0))))
    first, last = at[new], at[np.concatenate((new[1:], [len(at)])) - 1]
    stop = last + length
    content = _mix((total[stop] - total[first]) * down[first]) + (stop - first).astype(np.uint64)
    who = owner[new]
    return who, first - starts[who], last - starts[who], g[anchor[first]].view(np.int64), content.view(np.int64)


def sort_suffixes(text: np.ndarray, useful: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The starts in ``useful`` (a mask over ``text``) in the order of their
    suffixes, exact to ``length`` bytes. ``text`` ends with padding."""
    n = len(useful)
    change = np.append(np.flatnonzero(text[1:n + 1] != text[:n]), n - 1)
    nxt = change[np.searchsorted(change, np.arange(n))]
    rises = text[nxt] < text[nxt + 1]  # smaller than its successor
    # An induced suffix needs its successor, up to the next that is sorted directly.
    direct = np.append(np.flatnonzero(rises), n - 1)
    needed = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(useful)
    upto = direct[np.searchsorted(direct, at)]
    np.add.at(needed, at, 1)
    np.add.at(needed, upto + 1, -1)
    member = np.cumsum(needed)[:n] > 0
    raw = text.tobytes()
    sorted_ = np.flatnonzero(member & rises)
    keys = [raw[i:i + length] for i in sorted_.tolist()]
    sorted_ = sorted_[np.array(sorted(range(len(keys)), key=keys.__getitem__), dtype=np.int64)]
    del keys
    heads = text[sorted_]
    bounds = np.searchsorted(heads, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    falls = member & ~rises
    if falls[n - 1]:  # induced from the padding, the smallest suffix of all
        induced[text[n - 1]].append(np.array([n - 1]))

    def before(found: np.ndarray) -> np.ndarray:
        prev = found[found > 0] - 1
        return prev[falls[prev]]

    for c in range(256):
        parts, level = [], np.concatenate(induced[c]) if induced[c] else np.empty(0, dtype=np.int64)
        while len(level):
            parts.append(level)
            level = before(level)
            level = level[text[level] == c]
        parts.append(sorted_[bounds[c]:bounds[c + 1]])
        bucket = np.concatenate(parts)
        out.append(bucket)
        prev = before(bucket)
        prev = prev[text[prev] > c]
        if len(prev):
            by = np.argsort(text[prev], kind="stable")
            prev, char = prev[by], text[prev][by]
            for d, group in zip(char[first := np.flatnonzero(np.diff(char, prepend=c))].tolist(),
                                np.split(prev, first[1:])):
                induced[d].append(group)
    order = np.concatenate(out)
    return order[useful[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether each suffix in ``order`` shares ``length`` bytes with the next."""
    left, right = order[:-1], order[1:]
    alive = np.arange(len(left))
    words = np.ndarray(shape=(len(text) - 7,), dtype=np.uint64, buffer=text.data, strides=(1,))
    for k in [*range(0, length - 7, 8), length - 8]:
        alive = alive[words[left[alive] + k] == words[right[alive] + k]]
    out = np.zeros(len(left), dtype=bool)
    out[alive] = True
    return out


def repeated_windows(slices: list[bytes], copies: list[int], length: int = LENGTH):
    """For slices laid end to end: slice and offset of every window, whether it
    is repeated, and the first member of its class."""
    sizes = np.array([len(s) for s in slices], dtype=np.int64)
    body = b"".join(slices)
    text = np.frombuffer(body + b"\0" * (length + 8), dtype=np.uint8)
    starts = np.cumsum(sizes) - sizes
    count = sizes - length + 1
    owner = np.repeat(np.arange(len(sizes)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = starts[owner] + offset
    useful = np.zeros(len(body), dtype=bool)
    useful[at] = True
    order = sort_suffixes(text, useful, length)
    same = common_prefixes(text, order, length)
    group = np.concatenate(([0], np.cumsum(~same)))
    place = np.empty(len(body), dtype=np.int64)
    place[order] = group
    group_of = place[at]
    weight = np.bincount(group_of, weights=np.asarray(copies)[owner])
    first = np.full(len(weight), len(at), dtype=np.int64)
    np.minimum.at(first, group_of, np.arange(len(at)))
    return owner, offset, weight[group_of] > 1, first[group_of] == np.arange(len(at))


def _anchor_table(rows: DataFrame, length: int) -> DataFrame:
    src = rows.select("__id", "__tk", F.col("__text").cast("binary").alias("raw")).filter(F.octet_length("raw") >= length)
    schema = f"h long, c long, __id {src.schema['__id'].dataType.simpleString()}, __tk long, p int, q int"

    def run(batches):
        for b in batches:
            part, who, shift, held = [], [], [], 0

            def flush():
                i, p, q, h, c = regions(part, length)
                at = np.asarray(shift)[i] if len(i) else i
                take = pa.array(np.asarray(who)[i] if len(i) else i, pa.int64())
                return pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(c), b.column(0).take(take), b.column(1).take(take),
                     pa.array((p + at).astype(np.int32)), pa.array((q + at).astype(np.int32))],
                    names=["h", "c", "__id", "__tk", "p", "q"])

            for row, raw in enumerate(b.column(2)):
                raw = raw.as_py()
                for s in range(0, max(1, len(raw) - length + 1), STEP):  # long texts in overlapping parts
                    part.append(raw[s:s + STEP + length - 1])
                    who.append(row)
                    shift.append(s)
                    held += len(part[-1])
                    if held >= STEP:
                        yield flush()
                        part, who, shift, held = [], [], [], 0
            if part:
                yield flush()

    return src.mapInArrow(run, schema)


def _packed(rows: DataFrame) -> DataFrame:
    """Texts compressed for the shuffle: ``__id``, ``__tk``, ``z``."""
    src = rows.select("__id", "__tk", F.col("__text").cast("binary").alias("raw"))
    schema = f"__id {src.schema['__id'].dataType.simpleString()}, __tk long, z binary"

    def run(batches):
        shrink = zstandard.ZstdCompressor(level=1)
        for b in batches:
            z = [None if not x.is_valid else shrink.compress(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.binary())], names=["__id", "__tk", "z"])

    return src.mapInArrow(run, schema)


def _cut(rows: DataFrame, slices: DataFrame, length: int) -> DataFrame:
    """The bytes of slices from the text of their first document."""
    wanted = slices.groupBy("__id", "__tk").agg(F.collect_list(F.struct("h", "c", "n", "k", "s", "p", "q")).alias("w"))
    both = join_on_key(_packed(rows), wanted, "inner").dropDuplicates(["__id", "__tk"]).select("z", "w")

    def run(batches):
        grow = zstandard.ZstdDecompressor()
        names = ["h", "c", "n", "k", "s"]
        for b in batches:
            for z, w in zip(b.column(0), b.column(1)):
                raw = grow.decompress(z.as_py())
                for i in range(0, len(w.values), 1024):
                    some = w.values.slice(i, 1024)
                    ends = zip(some.field("p").to_pylist(), some.field("q").to_pylist())
                    cut = pa.array([raw[p:q + length] for p, q in ends], pa.binary())
                    yield pa.RecordBatch.from_arrays([*[some.field(c) for c in names], cut], names=[*names, "b"])

    return both.mapInArrow(run, "h long, c long, n long, k long, s long, b binary")


def _sorted(slices: DataFrame, length: int) -> DataFrame:
    """Suffix-sort slices. Rows ``h, c, a, z`` are repeated window starts a..z-1
    of a slice; rows with digests ``d1, d2`` are windows (or, with a = -1, repeated
    classes) of anchors that are spread over shards."""
    dealt = slices.repartition("h", "s").sortWithinPartitions("h", "s")
    names = ["h", "c", "a", "z", "d1", "d2"]

    def digest(body: bytes) -> tuple[int, int]:
        x = xxhash.xxh3_128_intdigest(body)
        return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)

    def found(h, c, n, k, body):
        owner, offset, rep, lead = repeated_windows(body, n, length)
        h, c, spread = np.asarray(h), np.asarray(c), np.asarray(k) > 1
        on = np.flatnonzero(rep)
        new = np.flatnonzero(np.concatenate(([True], (np.diff(owner[on]) != 0) | (np.diff(offset[on]) != 1)))) if len(on) else on
        first, last = on[new], on[np.concatenate((new[1:], [len(on)])).astype(np.int64) - 1] if len(on) else on
        yield [h[owner[first]], c[owner[first]], offset[first], offset[last] + 1, None, None]
        far = np.flatnonzero(spread[owner] & (~rep | lead))
        if len(far):
            d = np.array([digest(body[i][o:o + length]) for i, o in zip(owner[far].tolist(), offset[far].tolist())],
                         dtype=np.int64).reshape(-1, 2)
            yield [h[owner[far]], c[owner[far]], np.where(rep[far], -1, offset[far]), offset[far] + 1, d[:, 0], d[:, 1]]

    def batch(cols) -> pa.RecordBatch:
        size = len(cols[0])
        return pa.RecordBatch.from_arrays(
            [pa.nulls(size, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in cols], names=names)

    def run(batches):
        held, size, last = [], 0, None
        for b in (part for whole in batches for part in byte_slices(whole, 5)):
            for row in zip(*[b.column(i).to_pylist() for i in range(6)]):
                bucket = (row[0], row[4])
                if size >= SORT_BYTES and bucket != last:
                    h, c, n, k, _, body = zip(*held)
                    yield from map(batch, found(h, c, n, k, body))
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
                last = bucket
        if held:
            h, c, n, k, _, body = zip(*held)
            yield from map(batch, found(h, c, n, k, body))

    return dealt.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Byte ranges ``s`` (first) to ``e`` (exclusive) of repeated strings:
    ``__id``, ``__tk`` (document key), overlapping ranges as they were found."""
    rows = with_key(docs.select(F.col(quoted(id_col)), F.col(quoted(text_col)).alias("__text")), id_col, "__text")
    every = _anchor_table(rows, length)
    # As a table of its own, so that the join's shuffle can split a common anchor.
    often = shared_table(every.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "anchors")
    region = shared_table(every.join(often, "h"), "regions")
    slices = region.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("__id", "__tk", "p", "q")).alias("at"))
    shards = region.groupBy("h").agg(F.approx_count_distinct("c").alias("m")).select(
        "h", F.greatest(F.lit(1), F.ceil(F.col("m") / SHARD)).cast("long").alias("k"))
    placed = slices.join(shards, "h").select("h", "c", "n", "k", F.pmod("c", "k").alias("s"), "at.*")
    marks = shared_table(_sorted(_cut(rows, placed, length), length), "repeats")
    near = marks.filter("d1 IS NULL").select("h", "c", "a", "z")
    open_ = marks.filter("d1 IS NOT NULL")
    again = open_.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("a").alias("least")).filter(
        "n > 1 OR least < 0").select("d1", "d2")
    far = open_.filter("a >= 0").join(again, ["d1", "d2"]).select("h", "c", "a", "z")
    return region.join(near.unionByName(far), ["h", "c"]).select(
        "__id", "__tk", (F.col("p") + F.col("a")).alias("s"), (F.col("p") + F.col("z") + (length - 1)).alias("e"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``
    (maximal removed runs) and ``kept`` (the remaining bytes).

    Every byte covered by a string of ``length`` bytes that starts anywhere else,
    in any row, is removed; matches never cross rows and are judged on the input.
    Null counts as empty, texts shorter than ``length`` stay. A repeated row
    repeats all its strings, so each such row loses every byte it can.
    """
    rows = with_key(docs.select(F.col(quoted(id_col)), F.col(quoted(text_col)).alias("__text")), id_col, "__text")
    spans = repeated_spans(docs, id_col, text_col, length).groupBy("__id", "__tk").agg(
        F.collect_set(F.struct("s", "e")).alias("w"))
    both = join_on_key(_packed(rows), spans, "left").select("__id", "z", "w")
    kind = both.schema["__id"].dataType.simpleString()

    def run(batches):
        grow = zstandard.ZstdDecompressor()
        for b in (part for whole in batches for part in byte_slices(whole, 1)):
            done = [without(grow.decompress(z.as_py()) if z.is_valid else b"", w) for z, w in zip(b.column(1), b.column(2))]
            cols = list(zip(*done)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(x, pa.int64()) for x in cols[:3]], pa.array(cols[3], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def without(raw: bytes, spans) -> tuple[int, int, int, bytes]:
    """Size, removed bytes, maximal removed runs and the rest of a text."""
    if not spans.is_valid or not len(spans):
        return len(raw), 0, 0, raw
    edge = np.zeros(len(raw) + 1, dtype=np.int64)
    values = spans.values
    np.add.at(edge, values.field("s").to_numpy(), 1)
    np.add.at(edge, values.field("e").to_numpy(), -1)
    gone = np.cumsum(edge)[:-1] > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return len(raw), int(gone.sum()), runs, np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()


