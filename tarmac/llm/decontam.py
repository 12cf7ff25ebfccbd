"""Benchmark decontamination with DataFrame functions only.

The test n-grams form a hash set: a bitmap of hashes, of a size fixed by their
number, which every task probes for each window of words, and a table of
the n-grams themselves, joined by their exact words to verify what the bitmap
let through. The documents' texts are read once and never shuffled.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import join_on_key, quoted, shared_table, shielded, unshielded, with_key

#: Word characters: all but \x00-\x2F, \x3A-\x60 and \x7B-\x7F. Written as what
#: is in the class, which the JVM matches ten times as fast as its complement.
WORD = r"[0-9a-z\x80-\x{10FFFF}]"
NGRAM = 13
#: Contaminated: at least this share (one in so many) of the words is hit.
SHARE = 20
#: Bitmap bits for each test n-gram, and the largest bitmap (1 MB). A fuller
#: bitmap only lets more windows through to the exact join.
BITS_PER_GRAM, MAX_BITS = 256, 1 << 23
#: Test n-grams of more bytes than this, the items' ids included, are joined by a
#: shuffle instead.
BROADCAST_BYTES = 32 << 20


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD + "+"), F.lit(0))


def _probe(words: Column, at: Column, length: int) -> Column:
    """Hash under which the bitmap knows a window: of its first, middle and last word."""
    return F.xxhash64(F.get(words, at - 1), F.get(words, at - 1 + length // 2), F.get(words, at + (length - 2)))


def _starts(words: Column, length: int) -> Column:
    """1-based starts of the windows of ``length`` words; empty if there are fewer."""
    n = F.size(words) - (length - 1)
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def test_ngrams(bench: DataFrame, item_col: str, text_col: str, ngram: int) -> DataFrame:
    """One row per distinct test n-gram: ``gram`` (words joined by a blank),
    ``len``, ``h`` (hash of its first, middle and last word) and ``items`` (ids as text)."""
    b = bench.select(F.col(quoted(item_col)).cast("string").alias("item"), words_of(F.col(quoted(text_col))).alias("w"))
    n = F.least(F.size("w"), F.lit(ngram))
    b = b.filter(F.size("w") > 0).withColumn("len", n)
    at = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1))
    b = b.select("item", "len", "w", at.alias("at")).select(
        "item", "len", F.slice("w", F.col("at"), F.col("len")).alias("win"))
    first, middle, last = F.get("win", 0), F.get("win", F.floor(F.col("len") / 2).cast("int")), F.get("win", F.col("len") - 1)
    return b.groupBy(F.array_join("win", " ").alias("gram"), "len", F.xxhash64(first, middle, last).alias("h")).agg(
        F.collect_set("item").alias("items"))


def _bitmap(grams: DataFrame, bits: int) -> Column:
    """The bitmap as a constant array of ``bits / 64`` longs (1 MB at most)."""
    pos = F.col("h").bitwiseAND(F.lit(bits - 1).cast("long"))
    words = grams.select(F.shiftright(pos, 6).alias("id"), F.expr("shiftleft(1L, CAST(h & 63 AS INT))").alias("bit")
                         ).groupBy("id").agg(F.bit_or("bit").alias("bits"))
    dense = [0] * (bits // 64)
    for row in words.collect():  # bounded by the bitmap
        dense[row["id"]] = row["bits"]
    return F.split(F.lit(",".join(map(str, dense))), ",").cast("array<bigint>")


def benchmark_hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", ngram: int = NGRAM,
                   share: int = SHARE) -> DataFrame:
    """One row per row of ``docs``: ``__id``, ``__tk`` (document key), ``n_words``,
    ``n_hit`` (words inside any occurrence of a test window), ``items`` (ids, sorted
    as text, of the items whose windows occur), ``spans`` (sorted ``pos``, ``len``
    in words, pos from 0) and ``contaminated``.

    Null and empty texts have no words and no hits; an item without words has
    no window, a shorter one is a single window. Items with a null id take part
    in hits and not in ``items``. An empty benchmark hits nothing. Repeated rows
    get equal answers; other columns are ignored.
    """
    grams = shared_table(test_ngrams(bench, item_col, item_text_col, ngram), "ngrams")
    ids = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16)
    stat = grams.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("gram") + ids + 64), F.lit(0)).alias("bytes"),
                     F.sort_array(F.collect_set("len")).alias("lens")).first()  # lens: at most ngram values
    bits = 1 << 12
    while bits < min(MAX_BITS, BITS_PER_GRAM * stat["n"]):
        bits *= 2
    words, bitmap = F.col("__w"), _bitmap(grams, bits)

    def maybe(h: Column) -> Column:
        pos = h.bitwiseAND(F.lit(bits - 1).cast("long"))
        word = F.get(bitmap, F.shiftright(pos, 6).cast("int"))
        return F.getbit(word, h.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1

    def candidates(length: int) -> Column:
        passed = F.filter(_starts(words, length), lambda i: maybe(_probe(words, i, length)))
        return F.transform(passed, lambda i: F.struct(
            (i - 1).alias("pos"), F.lit(length).alias("len"),
            F.array_join(F.slice(words, i, length), " ").alias("gram")))

    empty = F.array().cast("array<struct<pos:int,len:int,gram:string>>")
    found = F.concat(empty, *[candidates(n) for n in stat["lens"]])
    rows = with_key(docs.select(F.col(quoted(id_col)), F.col(quoted(text_col)).alias("__text"))
                    .withColumnRenamed(id_col, "__doc"), "__doc", "__text")
    rows = rows.select("__id", "__tk", words_of(F.col("__text")).alias("__w")).select(
        "__id", "__tk", F.size("__w").cast("long").alias("n_words"), found.alias("found"))
    rows = rows.select("__id", "__tk", "n_words", F.posexplode_outer("found").alias("k", "c")).select(
        "__id", "__tk", "n_words", (F.coalesce("k", F.lit(0)) == 0).cast("long").alias("first"), "c.*")
    right = grams.select("gram", "items")
    if stat["bytes"] <= BROADCAST_BYTES:
        right = F.broadcast(right)
    rows = rows.join(right, "gram", "left")
    span = F.when(F.col("items").isNotNull(), F.struct("pos", "len"))
    found = rows.groupBy("__id", "__tk").agg(
        F.max("n_words").alias("n_words"), F.sum("first").alias("copies"),
        F.sort_array(F.collect_set(span)).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("spans", zero, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["pos"] + s["len"] - F.greatest(a["end"], s["pos"]))).alias("n"),
        F.greatest(a["end"], s["pos"] + s["len"]).alias("end")))
    out = found.withColumn("n_hit", covered["n"].cast("long")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "__copy")


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      **options) -> DataFrame:
    """``docs`` without its contaminated documents, columns as they were."""
    docs, names = shielded(docs)
    id_col, text_col = names.get(id_col, id_col), names.get(text_col, text_col)
    bad = benchmark_hits(docs, bench, id_col, text_col, **options).filter("contaminated").select("__id", "__tk").distinct()
    return unshielded(join_on_key(with_key(docs, id_col, text_col), bad, "left_anti").drop("__id", "__tk"), names)


def remove_spans(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 **options) -> DataFrame:
    """``docs`` with the hit words cut out of the text; what stands between
    words stays. A null text stays null."""
    docs, names = shielded(docs)
    id_col, text_col = names.get(id_col, id_col), names.get(text_col, text_col)
    hits = benchmark_hits(docs, bench, id_col, text_col, **options).filter("n_hit > 0").select(
        "__id", "__tk", "spans").dropDuplicates(["__id", "__tk"])
    both = join_on_key(with_key(docs, id_col, text_col), hits, "left")
    letter = WORD.replace("a-z", "a-zA-Z")
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    text = F.col(quoted(text_col))
    parts = F.regexp_extract_all(text, F.lit(f"{gap}+|{letter}+"), F.lit(0))
    lead = F.when(text.rlike(f"^{gap}"), 1).otherwise(0)
    spans = F.col("spans")

    def stays(part: Column, at: Column) -> Column:
        own = F.floor((at - lead) / 2)
        is_word = F.pmod(at - lead, F.lit(2)) == 0
        return ~(is_word & F.exists(spans, lambda s: (s["pos"] <= own) & (own < s["pos"] + s["len"])))

    cut = F.array_join(F.filter(parts, stays), "")
    return unshielded(both.withColumn(text_col, F.when(spans.isNotNull(), cut).otherwise(text)).select(
        *[quoted(c) for c in docs.columns]), names)
