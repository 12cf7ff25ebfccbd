"""SimHash near-duplicates with pigeonring candidate pruning.

Every document gets a 64-bit fingerprint of its word shingles. Two documents
are linked when their fingerprints differ in at most ``max_bits`` bits; groups
are the connected components of the links.

Candidates come from the pigeonring principle. The fingerprint is cut into
four segments on a ring. If all four differences sum to at most 3, then some
segment starts a chain whose first 1, 2, 3 and 4 segments differ by at most
0.75, 1.5, 2.25 and 3 bits, that is 0, 1, 2 and 3. The join key of a start is
therefore its own segment (equal) together with the next one (equal or one
flipped bit); the third bound is checked on the joined pair, before the full
Hamming distance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import join_on_key, quoted, shared_table, shielded, small_batches, unshielded, with_key
from tarmac.llm.graph import components

SEED = 42
SEGMENTS, WIDTH, MAX_BITS = 4, 16, 3
#: Members of one chain key up to which its pairs come from a plain join;
#: larger keys are compared block by block (``_crowded_links``).
CROWDED, BLOCK, LEFT_BLOCK = 48, 1024, 8192
#: Shingles hashed at a time, which bounds a task's memory for any text length.
STEP = 1 << 16


def fingerprint(raw: bytes | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text. Null and texts without
    words give 0. Words are runs without blanks, A-Z is lower-cased."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1:].tolist()
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + STEP], stops[at:at + STEP])],
                     dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` without its text, plus ``__fp`` (the fingerprint as a signed long)."""
    rest = [c for c in docs.columns if c != text_col]
    src = docs.select(*[quoted(c) for c in rest], F.col(quoted(text_col)).cast("binary").alias("__raw"))
    schema = src.drop("__raw").withColumn("__fp", F.lit(0).cast("long")).schema

    def run(batches):
        for b in batches:
            raw = b.column(b.num_columns - 1)
            fp = np.array([fingerprint(x.as_py(), shingle) for x in raw], dtype=np.uint64).view(np.int64)
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fp)], names=[*rest, "__fp"])

    return src.mapInArrow(run, schema)


def _chains(fps: DataFrame, flips: bool) -> DataFrame:
    """Rows ``key, fp`` for each of the four starts; with ``flips`` the second
    segment is varied by setting one of its zero bits (of two segments one bit
    apart, exactly one has a zero there, so each pair meets once)."""
    size, mask = WIDTH, (1 << WIDTH) - 1

    def seg(i: int):
        return F.shiftrightunsigned("fp", size * (i % SEGMENTS)).bitwiseAND(F.lit(mask).cast("long"))

    def keys(i: int):
        head = F.lit(i << 2 * size).cast("long").bitwiseOR(F.shiftleft(seg(i), size))
        tail = seg(i + 1)
        if not flips:
            return F.array(head.bitwiseOR(tail))
        bits = F.array(*[F.lit(1 << b).cast("long") for b in range(size)])
        return F.transform(F.filter(bits, lambda b: tail.bitwiseAND(b) == 0),
                           lambda b: head.bitwiseOR(tail).bitwiseOR(b))

    starts = [keys(i) for i in range(SEGMENTS)]
    return fps.select("fp", F.explode(F.flatten(F.array(*starts))).alias("key"))


def _distance(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def _third_ok(a, b, key):
    """Chain bound of three segments: at most 2 bits over segments i, i+1, i+2,
    that is: the difference without segment i+3 (the one before the start)."""
    start = F.shiftrightunsigned(key, 2 * WIDTH)
    x = a.bitwiseXOR(b)
    last = F.lit((1 << WIDTH) - 1).cast("long")
    rest = [F.bit_count(x.bitwiseAND(F.bitwise_not(F.shiftleft(last, WIDTH * ((i + 3) % SEGMENTS)))))
            for i in range(SEGMENTS)]
    out = F.lit(True)
    for i in range(SEGMENTS):
        out = F.when(start == i, rest[i] <= 2).otherwise(out)
    return out


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``src, dst`` between the distinct values of the long column ``fp``
    that connect the same groups as all pairs within ``max_bits`` (0 to 3)."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("four segments prove distances of at most 3 bits")
    own, varied = _chains(fps, False), _chains(fps, True)
    crowd = shared_table(own.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED), "crowded")
    plain = own.join(crowd, "key", "left_anti")
    both = plain.select("key", F.col("fp").alias("dst"), F.lit(0).alias("d")).join(
        own.select("key", F.col("fp").alias("src"), F.lit(0).alias("e")).unionByName(
            varied.select("key", F.col("fp").alias("src"), F.lit(1).alias("e"))), "key")
    a, b = F.col("src"), F.col("dst")
    few = (both.filter((a < b) | (F.col("e") == 1)).filter(_third_ok(a, b, F.col("key")))
           .filter(_distance(a, b) <= max_bits).select("src", "dst"))
    return few.unionByName(_crowded_links(own, varied, crowd, max_bits))


def _crowded_links(own: DataFrame, varied: DataFrame, crowd: DataFrame, max_bits: int) -> DataFrame:
    """Links within keys of many members. Members are dealt to blocks, every
    block meets the blocks of its key, and a meeting returns a spanning forest
    of the links it finds: no more rows than it has members. Both sides are cut
    by their own counts, as the varied members of a key can outnumber it."""
    members = shared_table(
        own.select("key", "fp", F.lit(0).alias("e")).unionByName(varied.select("key", "fp", F.lit(1).alias("e")))
        .join(crowd.select("key"), "key"), "members")
    sizes = members.groupBy("key").agg(F.count("*").alias("m"), F.count_if(F.col("e") == 0).alias("n")).select(
        "key", F.ceil(F.col("m") / LEFT_BLOCK).cast("int").alias("rows"), F.ceil(F.col("n") / BLOCK).cast("int").alias("cols"))
    members = members.join(sizes, "key")

    def mine(k: str):
        return F.pmod(F.xxhash64("fp"), F.col(k)).cast("int")

    def all_of(k: str):
        return F.explode(F.sequence(F.lit(0), F.col(k) - 1))

    # A member of the key is on both sides; a varied one is only on the left.
    left = members.select("key", "fp", F.lit(0).alias("side"), mine("rows").alias("i"), all_of("cols").alias("j"))
    right = members.filter("e = 0").select("key", "fp", F.lit(1).alias("side"), mine("cols").alias("j"), all_of("rows").alias("i"))
    met = left.unionByName(right)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf.fp[pdf.side == 0].to_numpy().view(np.uint64)
        b = pdf.fp[pdf.side == 1].to_numpy().view(np.uint64)
        return pd.DataFrame(forest(a, b, max_bits), columns=["src", "dst"])

    return met.groupBy("key", "i", "j").applyInPandas(meet, "src long, dst long")


def forest(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Rows ``(node, root)`` joining the values of ``a`` and ``b`` that are
    linked, directly or through others, within ``max_bits``."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = inv[:len(a)], inv[len(a):]
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for at in range(0, len(a), 256):
        near = np.bitwise_count(a[at:at + 256, None] ^ b[None, :]) <= max_bits
        rows, cols = np.nonzero(near)
        pairs = np.unique(ia[at + rows].astype(np.int64) * len(nodes) + ib[cols])
        for x, y in zip((pairs // len(nodes)).tolist(), (pairs % len(nodes)).tolist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    root = np.array([find(x) for x in range(len(nodes))], dtype=np.int64)
    moved = root != np.arange(len(nodes))
    return np.stack([nodes[moved].view(np.int64), nodes[root[moved]].view(np.int64)], axis=1)


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> DataFrame:
    """``__id``, ``__tk`` (document key), ``__fp`` and ``__group`` of every row."""
    keyed = with_key(docs.select(F.col(quoted(id_col)), F.col(quoted(text_col)).alias("__text")), id_col, "__text")
    small_batches(docs.sparkSession)
    rows = shared_table(with_fingerprints(keyed.select("__id", "__tk", "__text"), "__text", shingle), "fingerprints")
    fps = rows.select(F.col("__fp").alias("fp")).distinct()
    comp = components(links(fps, max_bits))
    # Written, so that the join's two sides are plain shuffles and the rows of
    # a fingerprint with many copies are split over tasks.
    named = shared_table(fps.join(comp, fps["fp"] == comp["node"], "left").select(
        "fp", F.coalesce("component", "fp").alias("__group")), "groups")
    return rows.join(named, rows["__fp"] == named["fp"]).drop("fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                   max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id whose document can be reached by links.

    Null and blank texts have fingerprint zero and are linked like any other;
    short texts are one shingle. Repeated rows get equal answers. A null id is
    never a component id unless no member has one. Extra columns are ignored.
    """
    rows = _grouped(docs, id_col, text_col, shingle, max_bits)
    firsts = shared_table(rows.groupBy("__group").agg(F.min("__id").alias("component_id")), "firsts")
    return rows.join(firsts, "__group").select(
        F.col("__id").alias("doc_id"), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                     max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group: the document with the smallest id
    (null ids last, equal ids by text hash), once if it is listed repeatedly."""
    docs, names = shielded(docs)
    id_col, text_col = names.get(id_col, id_col), names.get(text_col, text_col)
    rows = _grouped(docs, id_col, text_col, shingle, max_bits)
    first = rows.groupBy("__group").agg(F.min(F.struct(F.col("__id").isNull().alias("n"), "__id", "__tk")).alias("k"))
    kept = join_on_key(with_key(docs, id_col, text_col), first.select("k.__id", "k.__tk"), "left_semi")
    return unshielded(kept.dropDuplicates(["__id", "__tk"]).drop("__id", "__tk"), names)
