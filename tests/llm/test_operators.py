"""Corpus operators against brute-force versions on small hand-made tables.

The table has nulls in every column, empty, blank and long texts, repeated
rows, equal ids with different texts, and extra columns whose names clash with
those that the operators use inside.
"""

import collections
import hashlib
import math
import re
import sys
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tarmac.llm import (
    common, decontam, langid, line_dedup, packing, pii, pq_dedup, pseudo_lm, quality, simhash, suffix,
)
from tarmac.llm.graph import components
from tarmac.llm.queries import vocabulary

rng = np.random.default_rng(3)
SYL = ["ka", "lo", "mi", "ter", "un", "ves", "or", "ap", "zin", "quo"]


def prose(n):
    return " ".join("".join(rng.choice(SYL, rng.integers(1, 4))) for _ in range(n))


PASSAGE = prose(60)
LONG = "\n".join(prose(40) for _ in range(300))
ROWS = [
    (1, f"{prose(50)}\n{PASSAGE}\n{prose(30)}", "en", "s", 1),
    (2, f"{prose(20)}\n{PASSAGE}", "en", "s", None),
    (2, f"{prose(20)}\n\n{PASSAGE}\nshort", "fr", None, 2),
    (3, LONG, "fr", "s", 3),
    (4, LONG, "fr", "s", 3),
    (4, LONG, "fr", "s", 3),
    (5, None, "en", "s", 1),
    (6, "", None, "s", 1),
    (7, "  \n\t ", "en", None, 1),
    (8, "one two", "en", "s", 1),
    (None, PASSAGE, "en", "s", 1),
    (None, None, None, None, None),
    (9, "aaaa " * 200, "de", "s", 1),
    (10, LONG.replace("ka", "KA", 3), "fr", "s", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    extra = {c: __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1) for c in ("h", "n", "key", "fp", "items", "length")}
    return df.withColumns(extra)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_simhash(docs, empty):
    def brute(t):
        words = (t or "").encode().lower().split()
        grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        return sum((2 * sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) > len(grams)) << b for b in range(64))

    fps = [brute(r[1]) for r in ROWS]
    comp = list(range(len(ROWS)))
    for _ in ROWS:
        comp = [min(c for c, g in zip(comp, fps) if (f ^ g).bit_count() <= 3) for f in fps]
    least = [min((r[0] for r, d in zip(ROWS, comp) if d == c and r[0] is not None), default=None) for c in comp]
    want = sorted(((r[0], f"{f:016x}", m) for r, f, m in zip(ROWS, fps, least)), key=repr)
    assert sorted(map(tuple, simhash.simhash_groups(docs).collect()), key=repr) == want
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(comp))
    assert simhash.simhash_groups(empty).count() == 0


def test_simhash_links_find_every_pair(spark, monkeypatch):
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = [b ^ np.uint64(sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 5), replace=False)))
             for b in base for _ in range(12)]
    fps = np.unique(np.array([*base, *flips], dtype=np.uint64)).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    u = fps.view(np.uint64)
    want = {int(a): int(b) for a, b in simhash.forest(u, u, 3)}
    for crowded in (48, 1):  # plain joins, then blocks
        monkeypatch.setattr(simhash, "CROWDED", crowded)
        monkeypatch.setattr(simhash, "BLOCK", 3 if crowded == 1 else 1024)
        monkeypatch.setattr(simhash, "LEFT_BLOCK", 5 if crowded == 1 else 8192)
        got = collections.defaultdict(set)
        for r in components(simhash.links(df)).collect():
            got[r["component"]].add(r["node"])
        groups = collections.defaultdict(set)
        for x in fps.tolist():
            groups[want.get(x, x)].add(x)
        assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_decontamination(spark, docs, empty):
    item = " ".join(PASSAGE.split()[5:30])
    bench = spark.createDataFrame([(1, item), (2, "One, TWO"), (3, None), (4, "?!"), (None, item), (1, item)],
                                  "item_id long, text string")
    got = {(r["__id"], r["n_words"]): r for r in decontam.benchmark_hits(docs, bench).collect()}
    assert len(decontam.benchmark_hits(docs, bench).collect()) == len(ROWS)
    assert got[(8, 2)]["n_hit"] == 2 and got[(8, 2)]["items"] == ["2"] and got[(8, 2)]["contaminated"]
    assert got[(None, 60)]["n_hit"] == 25 and got[(None, 60)]["items"] == ["1"]
    assert got[(1, 140)]["n_hit"] == 25 and got[(1, 140)]["spans"][0]["pos"] == 55
    assert not got[(5, 0)]["contaminated"] and not got[(3, 12000)]["contaminated"]
    assert decontam.benchmark_hits(empty, bench).count() == 0
    assert decontam.benchmark_hits(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    left = decontam.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.filter("text = 'one two'").count() == 0
    cut = {r["text"] for r in decontam.remove_spans(docs, bench).filter("doc_id IS NULL").collect()}
    assert None in cut and not any(item in (t or "") for t in cut)


def test_decontamination_joined_by_a_shuffle(spark, docs, monkeypatch):
    """Beyond the size bound, which counts the items' ids, the answers are the same."""
    bench = spark.createDataFrame([(f"item {i:040d}", " ".join(PASSAGE.split()[5:30])) for i in range(30)], "item_id string, text string")
    wide = decontam.benchmark_hits(docs, bench)
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 5000)  # less than the ids, more than the 13 n-grams alone
    joined = decontam.benchmark_hits(docs, bench)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(wide) and "strategy=broadcast" not in plan(joined)
    assert sorted(map(str, wide.collect())) == sorted(map(str, joined.collect()))


def test_line_dedup(docs, empty):
    order = sorted({(r[0] is not None, r[0] or 0, r[1] is not None and r[1], r[1]) for r in ROWS if r[1] is not None},
                   key=lambda r: (r[0], r[1]))
    out = line_dedup.dedup_lines(docs).collect()
    assert len(out) == len(ROWS) and line_dedup.dedup_lines(empty).count() == 0
    lines = collections.Counter(x for r in {(r["doc_id"], r["text"]) for r in out} for x in (r[1] or "").split("\n")
                                if len(x.split()) >= line_dedup.MIN_WORDS)
    want = {x for r in order for x in r[3].split("\n") if len(x.split()) >= line_dedup.MIN_WORDS}
    assert set(lines) == want and max(lines.values()) == 1  # each long line survives exactly once
    assert {r["text"] for r in out if r["doc_id"] == 4} == {""}
    assert [r["text"] for r in out if r["doc_id"] == 8] == ["one two"]


def test_line_windows_cover_short_lines():
    run = [prose(6) for _ in range(8)]
    a = line_dedup.line_windows("\n".join([prose(30), *run, prose(30)]).encode(), 25)
    b = line_dedup.line_windows("\n".join([prose(9), *run, prose(9)]).encode(), 25)
    shared = {(w[2], w[4]) for w in a} & {(w[2], w[4]) for w in b}
    assert len(shared) == 4  # every window inside the shared run, by fingerprint and digest


def test_line_windows_by_plain_minima():
    text = "\n".join([prose(9), "", prose(4), prose(30), " ", prose(13), prose(13), prose(2)])
    lines = [(i, x.strip().encode()) for i, x in enumerate(text.split("\n")) if x.strip()]
    want = set()
    for s in range(len(lines)):
        for e in range(s, len(lines)):
            n = [len(x.split()) for _, x in lines[s:e + 1]]
            if sum(n) >= 25 and (sum(n[:-1]) < 25 or sum(n[1:]) < 25):
                digests = [xxhash.xxh3_128_digest(x) for _, x in lines[s:e + 1]]
                f, at = min((int.from_bytes(d[:8], "little"), i) for d, (i, _) in zip(digests, lines[s:e + 1]))
                want.add((lines[s][0], lines[e][0], f, at, digests[0] if s == e else xxhash.xxh3_128_digest(b"".join(digests))))
    got = line_dedup.line_windows(text.encode(), 25)
    assert set(got) == want and len(got) == len(want)


def test_line_dedup_takes_whole_runs(spark):
    """Short lines behind the last full window go too, whichever earlier
    document they repeat; against all pairs of positions."""
    gen = np.random.default_rng(5)
    pool = [prose(int(n)) for n in gen.integers(1, 14, 12)] + ["", prose(40)]
    texts = ["\n".join(pool[i] for i in gen.integers(0, len(pool), 12)) for _ in range(12)]
    head, tails = prose(30), [prose(3) + "\n" + prose(4), prose(5)]
    texts += [f"{head}\n{tails[0]}", f"{head}\n{tails[1]}", f"{head}\n{tails[1]}", f"{head}\n{tails[0]}", texts[3], texts[7]]
    rows = list(enumerate(texts))
    lines = [[(i, x) for i, x in enumerate(t.split("\n")) if x.strip()] for t in texts]
    gone = [set() for _ in texts]
    for d, later in enumerate(lines):
        for e, first in enumerate(lines[:d + 1]):
            for i in range(len(later)):
                for j in range(i if d == e else len(first)):
                    run = []
                    for (at, x), (_, y) in zip(later[i:], first[j:]):
                        if x != y:
                            break
                        run.append((at, x))
                    if sum(len(x.split()) for _, x in run) >= line_dedup.MIN_WORDS:
                        gone[d] |= {at for at, _ in run}
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept = lambda t: [x for x in t.split("\n") if x.strip()]
    for d, t in rows:
        assert kept(out[d]["text"]) == [x for i, x in lines[d] if i not in gone[d]], d
    assert [kept(out[d]["text"]) for d in (13, 14, 15)] == [[tails[1]], [], []]


def test_suffix_dedup(docs, empty, monkeypatch):
    texts = [(r[1] or "").encode() for r in ROWS]
    seen = collections.Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))

    def brute(t):
        gone = np.zeros(len(t) + 1, dtype=int)
        for i in range(len(t) - 199):
            if seen[t[i:i + 200]] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        g = np.cumsum(gone)[:-1] > 0
        runs = int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum())
        return len(t), int(g.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~g])

    want = sorted(((r[0], *brute(t)) for r, t in zip(ROWS, texts)), key=repr)
    for shard in (2000, 1):
        monkeypatch.setattr(suffix, "SHARD", shard)
        got = sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix.remove_repeats(docs).collect()), key=repr)
        assert got == want
    assert suffix.remove_repeats(empty).count() == 0


def test_packing_of_full_and_repeated_pieces(spark, monkeypatch):
    """Full pieces are sequences of their own; equal rows go to several buckets."""
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 4)
    gen = np.random.default_rng(4)
    rows = [(i, 0, 0, int(n), 7) for i, n in enumerate(gen.integers(1, 12, 60))] + [(1, 0, 0, 6, 7)] * 40
    rows += [(100, k, 12 * k, 12, 7) for k in range(30)] + [(101, 0, 0, 12, 7)] * 5
    table = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3)
    path = common.shared_table(table, "test-pieces")
    got = collections.defaultdict(list)
    for r in packing.pack(path, 12, F.xxhash64("_metadata.file_name", "_metadata.row_index")).collect():
        got[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in got.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 12
    assert sorted(n for places in got.values() for _, n in places) == sorted(r[3] for r in rows)
    rest = np.bincount([r[3] for r in rows if r[3] < 12], minlength=13)
    assert len(got) == 35 + sum(times for _, times in packing.plan(rest, 12))  # the plan's sequences and the full pieces


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    voc = vocabulary()
    tok = Tokenizer.from_file(voc["json_path"])
    rows = packing.pack_documents(docs, **voc, with_ids=True).collect()
    got = collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        got[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in got.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= packing.CAPACITY
    total = sum(r["length"] for r in rows)
    assert total == sum(len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ROWS)
    assert len(got) == math.ceil(total / packing.CAPACITY)
    first = sorted((r for r in rows if r["doc_id"] == 3), key=lambda r: r["piece"])
    assert [x for r in first for x in r["ids"]] == [*tok.encode(LONG, add_special_tokens=False).ids, 0]
    assert all(r["length"] == packing.CAPACITY for r in first[1:])
    assert packing.pack_documents(empty, **voc).count() == 0


def test_plan_uses_every_piece():
    counts = np.zeros(2049, dtype=int)
    np.add.at(counts, rng.integers(1, 2049, 5000), 1)
    used = np.zeros_like(counts)
    for content, times in packing.plan(counts):
        assert sum(n * k for n, k in content.items()) <= 2048
        for n, k in content.items():
            used[n] += k * times
    assert (used == counts).all()


def test_language_id(spark, docs, empty):
    words = {"en": ["the", "and", "house", "with"], "de": ["der", "und", "haus", "mit"]}
    rows = [(i, " ".join(rng.choice(words[lang], 30)), lang) for i in range(80) for lang in ("en", "de")]
    rows += [(1000, None, "en"), (1001, "123 !", "de"), (None, "the house", None), (1002, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("lang", "lang")
    out = langid.identify(df).collect()
    held = [r for r in out if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["doc_id"] < 80]
    assert held and all(r["__lang"] == r["lang"] and r["__score"] > 0.9 for r in held)
    assert {r["__lang"] for r in out if r["doc_id"] in (1000, 1001, 1002)} == {"und"}
    assert langid.identify(empty).count() == 0
    assert {r["__lang"] for r in langid.identify(df.filter("doc_id = 1000")).collect()} == {"und"}
    mixed = langid.Tagger(langid.train([r[1] for r in rows[:100]], [r[2] for r in rows[:100]]))
    share = mixed.shares([["the", "and"] * 8 + ["der", "und"] * 8])[0]
    assert abs(share[0] - 0.5) < 0.1


def test_language_sample_counts_copies_once(spark):
    """A large group of copies that is drawn takes no other text's place."""
    from pyspark.sql import functions as F

    from tarmac.llm.common import text_hash

    draw = F.pmod(F.xxhash64(text_hash(F.col("text")), F.lit("sample")), F.lit(1 << 20))
    texts = [(f"text {i}",) for i in range(2000)]
    copied = spark.createDataFrame(texts, "text string").orderBy(draw).first()["text"]
    rows = [(copied, "a")] * 500 + [(f"a {i}", "a") for i in range(20)] + [(f"z {i}", "z") for i in range(20)]
    df = spark.createDataFrame(rows, "text string, lang string")
    got, langs = langid.training_sample(df, "text", "lang", F.lit(True), text_hash(F.col("text")), 3)
    assert langs == ["a"] * 3 + ["z"] * 3 and len(set(got)) == 6


def test_forward_backward_matches_enumeration():
    import itertools

    score, trans = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    gamma, pairs = langid.forward_backward(score, np.ones(4, dtype=int), trans, want_pairs=True)
    total, marg, exp = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in itertools.product(range(3), repeat=4):
        w = math.exp(sum(score[t, y] for t, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        total += w
        for t, y in enumerate(path):
            marg[t, y] += w
        for a, b in zip(path, path[1:]):
            exp[a, b] += w
    assert np.allclose(gamma, marg / total) and np.allclose(pairs, exp / total)


def test_near_duplicate_vectors(spark, monkeypatch):
    x = rng.normal(size=(150, 16))
    x = np.concatenate([x, x[:60] + rng.normal(scale=0.05, size=(60, 16)), x[:5], 3 * x[5:9]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None, 1.0]), (904, []), (None, x[0].tolist()), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u = np.concatenate([x, x[:1]])  # the null id has the vector of row 0
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.95
    comp = np.arange(len(u))
    for _ in range(10):
        comp = np.array([comp[n].min() for n in near])
    for members, probes in ((pq_dedup.MEMBERS, pq_dedup.PROBES), (16, 8)):  # one block, several bins and blocks
        monkeypatch.setattr(pq_dedup, "MEMBERS", members)
        monkeypatch.setattr(pq_dedup, "PROBES", probes)
        got = {r["vec_id"]: r for r in pq_dedup.near_duplicates(df).collect()}
        assert len(got) == len(rows)
        for i in range(len(x)):
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum() - 1, comp[i], comp[i] == i)
        assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 906))
        assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (near[-1].sum() - 1, comp[-1], False)
    assert pq_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_without_ids_and_repeated_rows(spark):
    v, w = [1.0, 0.0], [0.999, 0.001]
    df = spark.createDataFrame([(1, v), (None, v), (2, w), (2, w), (None, [0.0, 1.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(((r[0] or 0, r[1], r[2] or 0, r[3]) for r in pq_dedup.near_duplicates(df).collect()))
    assert got == [(0, 1, 0, False), (0, 1, 0, False), (0, 3, 1, False), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False)]


def test_pseudonyms(spark, docs, empty):
    text = "a.bee@x.org 4173893178530722 +1 (755) 555-9729 42.179.73.104 2024-02-29 123-45-6789"
    bad = "4173893178530723 300.1.1.1 2023-02-30 000-12-3456 +1 (155) 555-9729"
    df = spark.createDataFrame([(1, text, 0), (2, text + "!", 0), (3, bad, 0), (4, None, 0), (5, "", 0)], "doc_id long, text string, n_replaced int")
    out = {r["doc_id"]: r for r in pii.pseudonymise(df, "k").collect()}
    new = out[1]["text"].split(" ")
    assert out[1]["n_replaced"] == 6 and out[2]["text"] == out[1]["text"] + "!"
    assert not set(new) & set(text.split(" ")) - {"+1"}
    d = [int(c) for c in new[1]]
    assert len(d) == 16 and sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0
    assert out[3]["text"] == bad and out[3]["n_replaced"] == 0 and out[4]["text"] is None and out[5]["text"] == ""
    assert pii.pseudonymise(docs, "k").count() == len(ROWS) and pii.pseudonymise(empty, "k").count() == 0


def test_pseudonyms_among_other_signs(spark):
    card = "4173893178530722"
    texts = [f"{card} 12/27", f"{card} 123", f"2 {card}", "4173 8931 7853 0722 123", "jos\u00e9@x.com", "_john@x.com", "-john@x.com",
             "andr\u00e9.46@mail8.example.com", ".john@x.com", "\u0438\u0432\u0430\u043d@x.com", "@x.com", "4173893178530723 12/27", f"{card} 2024-02-29"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.pseudonymise(df, "k").collect()}
    new = [out[i]["text"] for i in range(len(texts))]
    alone = pii.pseudonymise(spark.createDataFrame([(0, card)], "doc_id long, text string"), "k").first()["text"]
    assert alone != card and new[:3] == [f"{alone} 12/27", f"{alone} 123", f"2 {alone}"]
    assert new[3].replace(" ", "") == alone + "123" and len(new[3]) == len(texts[3])
    for i in range(4, 10):
        assert out[i]["n_replaced"] == 1 and len(new[i]) == len(texts[i]) and new[i].endswith(texts[i][texts[i].index("@"):])
        local, was = new[i].split("@")[0], texts[i].split("@")[0]
        assert local != was and [c.isalpha() for c in local] == [c.isalpha() for c in was] and local[-1] != was[-1] or local[:-1] != was[:-1]
    assert new[10:12] == texts[10:12] and out[12]["n_replaced"] == 2 and new[12].startswith(alone + " ")


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    df = spark.range(17 * 40).select(F.floor(F.col("id") / 40).alias("l"), F.pmod("id", F.lit(40)).alias("r"))
    p = df.select(pii.feistel("k", "t", F.col("l"), F.col("r"), F.lit(17).cast("long"), F.lit(40).cast("long")).alias("p"))
    assert p.distinct().count() == 17 * 40


def quality_rows():
    rows, labels = [], []
    for i in range(200):
        good = i % 2
        words = prose(40) if good else prose(40).upper().replace(" ", "!! ")
        rows.append((i, words, "en", f"src{i % 3}", 100))
        if i < 120:
            labels.append((i, good))
    return rows, labels + [(None, 1), (3, None), (1, 1)]


def test_quality(spark, docs, empty):
    rows, labels = quality_rows()
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality.score_quality(spark.createDataFrame(rows, SCHEMA), lab).filter("doc_id >= 120").collect()
    assert sum(r["keep"] == bool(r["doc_id"] % 2) for r in out) >= 0.95 * len(out)
    assert quality.score_quality(docs, lab).count() == len(ROWS) and quality.score_quality(empty, lab).count() == 0
    assert {r["score"] for r in quality.score_quality(docs, lab.limit(0)).collect()} == {0.5}


def test_quality_does_not_depend_on_partitions(spark):
    rows, labels = quality_rows()
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    rows += [rows[7], rows[8], (None, None, None, None, None), (None, prose(30), "en", "src1", 3)]
    got = [sorted(map(tuple, quality.score_quality(spark.createDataFrame(rows, SCHEMA).repartition(n), lab).collect()), key=repr)
           for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == len(rows)


def test_quality_exchange_against_plain_counts(spark):
    """One round over all unlabelled documents, counted by hand: each view's
    sure answers are counted in the other view only."""
    rows, labels = quality_rows()
    lab = dict(labels[:120])
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n_chars", "n")
    table = quality.features(df).join(spark.createDataFrame(list(lab.items()), "doc_id long, good int"), "doc_id", "left")
    table = table.withColumn("good", table["good"] == 1)
    plain = {r["doc_id"]: (set(np.frombuffer(r["words"], "<u2").tolist()), np.frombuffer(r["rest"], "<u2").tolist())
             for r in table.collect()}
    for i, text, lang, source, n in rows:
        assert plain[i][0] == {zlib.crc32(w.lower().encode()) % quality.BUCKETS for w in text.split()}
        assert plain[i][1][quality.STATS:] == quality.meta_ids(source, lang, n, text)

    def by_hand(given):  # {document: (class in the text view, class in the metadata view)}
        out = np.zeros((2, quality.SIZE), dtype=np.int64)
        for i, (text, meta) in given.items():
            for x in [*plain[i][0], *(quality.BUCKETS + s for s in plain[i][1][:quality.STATS])] if text is not None else []:
                out[text, x] += 1
            for x in plain[i][1][quality.STATS:] if meta is not None else []:
                out[meta, quality.TEXT_SIZE + x] += 1
        return out

    true = quality.tally(table.filter("good IS NOT NULL"))
    assert (true == by_hand({i: (g, g) for i, g in lab.items()})).all()
    kept = table.filter("good IS NOT NULL").collect()
    one = quality.Rows.of([bytes(r["words"]) for r in kept], [bytes(r["rest"]) for r in kept])
    views = quality.Views.of(true).calibrate(one, np.array([float(r["good"]) for r in kept]))
    views.meta = np.array([0.0] * quality.META + [quality.SURE])  # sure of good whatever the page
    given = {}
    for i in plain:
        if i not in lab:
            z = views.logits(quality.Rows.of([np.array(sorted(plain[i][0]), "<u2").tobytes()], [np.array(plain[i][1], "<u2").tobytes()]))[0][0]
            given[i] = (1, int(z > 0) if abs(z) >= quality.SURE else None)
    pseudo = quality.tally(table.filter("good IS NULL"), views)
    assert (pseudo == by_hand(given)).all() and pseudo[0].any()
    joined = quality.joined_counts(true, 1000 * pseudo)
    assert joined.sum() <= 2 * true.sum() + 1e-6


def test_pseudo_likelihood(spark, docs, empty):
    out = pseudo_lm.score_documents(docs).collect()
    assert len(out) == len(ROWS) and pseudo_lm.score_documents(empty).count() == 0
    by = {r["doc_id"]: r for r in out}
    assert by[5]["n_words"] == 0 and by[5]["mean_log_prob"] is None and by[5]["log_prob"] == 0
    assert all(abs(r["log_prob"] - r["n_words"] * r["mean_log_prob"]) < 1e-6 for r in out if r["n_words"])
    pattern = spark.createDataFrame([(i, "up down left right " * 60) for i in range(40)] + [(99, "right up left down " * 60)],
                                    "doc_id long, text string").coalesce(1)
    s = {r["doc_id"]: r["mean_log_prob"] for r in pseudo_lm.score_documents(pattern).collect()}
    assert s[0] > s[99]


def test_pseudo_likelihood_tells_words_of_a_class_apart(spark):
    """A word's probability has its share of the class's count; without training
    and context, that is its share of the corpus."""
    frequent = [f"top{i}" for i in range(pseudo_lm.FREQUENT)]
    named = [f"rare{i}" for i in range(200)]
    bucket = lambda w: zlib.crc32(w.encode()) % pseudo_lm.OTHERS
    a, b = next((x, y) for x in named for y in named if x < y and bucket(x) == bucket(y))
    rows = [(0, " ".join(frequent * 30)), (1, f"{a} " * 20), (2, a), (3, b), (4, f"{a} {b} {b}"), (2, a)]
    out = pseudo_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    s = {r["doc_id"]: r["log_prob"] for r in out}
    assert abs(s[2] - s[3] - math.log(23 / 3)) < 1e-4  # 23 and 3 of the class's 26


def test_pseudo_likelihood_trains_on_every_position(spark):
    """A step raises the base score of its targets only: over the rounds, of all words."""
    words = [f"w{i}" for i in range(7)]
    p = pseudo_lm.initial(np.ones(pseudo_lm.VOCAB))
    raised = [set(np.flatnonzero(pseudo_lm._round(spark.createDataFrame([(" ".join(words),)], "text string"), words, p, turn)["base"]
                                 > p["base"]).tolist()) for turn in range(pseudo_lm.ROUNDS)]
    assert set.union(*raised) == set(range(7)) and sum(map(len, raised)) == 7


def test_words_are_runs_of_word_characters():
    """Of every character, as the expression finds them in the lower-cased text."""
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for text in ("".join(f"a{c}B" for c in points), "".join(f"a{c}B" for c in points[:128]), " ", "\u0130x \u00b2"):
        assert pseudo_lm.words_of(text) == re.findall(r"\w+", text.lower())
    assert pseudo_lm.words_of(None) == pseudo_lm.words_of("") == []


def test_coded_texts_hold_every_word_in_order(spark):
    """Texts are cut into words once: codes, counts and slices give them back."""
    texts = [None, "", "Up, down up", "x " * 30, "\u00c9t\u00e9 " * 50 + "up", "..."] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    coded = pseudo_lm.coded_texts(df, "doc_id", "text")
    got = []
    for r in coded.collect():
        words, row = (r["words"] or "").split(), r.asDict()
        spelled = [w for part in pseudo_lm.texts_of(row, np.arange(len(words))) for w in part]
        got += [(i, [words[k] for k in w]) for i, w in zip(r["ids"], spelled)]
        assert sum(r["times"]) == sum(r["sizes"]) and len(set(words)) == len(words)
    assert got == [(i, pseudo_lm.words_of(t)) for i, t in enumerate(texts)]
    counts = {r["word"]: r["n"] for r in pseudo_lm.word_counts(coded).collect()}
    assert counts == {"up": 9, "down": 3, "x": 90, "\u00e9t\u00e9": 150}


def test_cut_makes_no_object_of_a_word():
    """The words of all texts, as one array: no Python string for each."""
    texts = [None, "", "Up, down", "up", " \u039f\u0394\u039f\u03a3 \u03a3\u0391\u03a3, \u0130stanbul\u0130", "\u00c9t\u00e9\u4e16\u754c x", "...", "a" * 9]
    sizes, words = pseudo_lm.cut(texts)
    assert words.to_pylist() == [w for t in texts for w in pseudo_lm.words_of(t)]
    assert sizes.tolist() == [len(pseudo_lm.words_of(t)) for t in texts]
    assert [len(x) for x in pseudo_lm.cut([None, "..."])] == [2, 0]
    assert pseudo_lm.words_of(texts[4]) == re.findall(r"\w+", texts[4].lower())
    many = [" ".join(f"w{i} \u00e9{i}" for i in range(20_000))]
    before = sys.getallocatedblocks()
    kept = pseudo_lm.cut(many)
    assert len(kept[1]) == 40_000 and sys.getallocatedblocks() - before < 4000


def test_coded_texts_without_words(spark):
    df = spark.createDataFrame([(0, None), (1, "..."), (2, "")], "doc_id long, text string").coalesce(1)
    row = pseudo_lm.coded_texts(df, "doc_id", "text").first()
    assert (list(row["ids"]), list(row["sizes"]), row["words"], list(row["times"])) == ([0, 1, 2], [0, 0, 0], None, [])
    assert [tuple(r) for r in pseudo_lm.score_documents(df).orderBy("doc_id").collect()] == [(i, 0, 0.0, None) for i in range(3)]


@pytest.mark.parametrize("top", [pseudo_lm.PLAIN - 2, 200.0])
def test_training_with_large_scores_follows_the_gradient(top):
    """Scores near the bound, which steps may pass before it is looked at, and beyond it."""
    p = pseudo_lm.initial(np.arange(pseudo_lm.VOCAB) + 1.0)
    p["base"][:4] = top
    line = np.resize(np.array([1, 2, 3, 1, 5, 2, 9]), pseudo_lm.BATCH * (pseudo_lm.LOOK + 1))
    target, ctx = pseudo_lm.contexts([line])
    net, one = pseudo_lm.Network(p), pseudo_lm.Network(p)
    net.train_on(target, ctx)
    assert np.isfinite(net.at).all()
    one.train_on(target[:pseudo_lm.BATCH], ctx[:pseudo_lm.BATCH])
    y = target[:pseudo_lm.BATCH]
    near = np.einsum("vd,kde->kve", p["emb"], p["mix"]).astype(np.float64)
    h = np.tanh(sum(near[k][ctx[:pseudo_lm.BATCH, k]] for k in range(ctx.shape[1])) + p["bias"])
    z = h @ p["out"] + p["base"]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    g = ((z / z.sum(axis=1, keepdims=True)) - np.eye(pseudo_lm.VOCAB)[y]).mean(axis=0)
    assert np.abs(one.base - (p["base"] - pseudo_lm.RATE * g / np.sqrt(1e-4 + g * g))).max() < 1e-3


def test_training_step_follows_the_gradient():
    """A mini-batch moves every parameter by its AdaGrad step of the mean loss."""
    p = {k: v.astype(np.float64) for k, v in pseudo_lm.initial(np.arange(pseudo_lm.VOCAB) + 1.0).items()}
    target, ctx = pseudo_lm.contexts([np.array([1, 2, 3, 1, 5, 2]), np.array([7, 1])])
    net = pseudo_lm.Network(p)
    net.train_on(target, ctx)
    got = net.parameters()
    loss = lambda q: -pseudo_lm.log_probs(pseudo_lm.scoring_tables(q), target, ctx).mean()
    for k, at in (("emb", (1, 3)), ("mix", (2, 4, 5)), ("bias", (6,)), ("out", (7, 2)), ("base", (1,))):
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][at] += 1e-4
        down[k][at] -= 1e-4
        g = (loss(up) - loss(down)) / 2e-4
        assert abs(got[k][at] - (p[k][at] - pseudo_lm.RATE * g / math.sqrt(1e-4 + g * g))) < 2e-3


def test_log_probs_match_direct_softmax():
    p = pseudo_lm.initial(np.ones(pseudo_lm.VOCAB))
    target, ctx = pseudo_lm.contexts([np.array([1, 2, 3, 4, 5]), np.array([7])])
    got = pseudo_lm.log_probs(pseudo_lm.scoring_tables(p), target, ctx)
    for y, c, g in zip(target, ctx, got):
        h = np.tanh(sum(p["emb"][w] @ p["mix"][k] for k, w in enumerate(c)) + p["bias"])
        z = h @ p["out"] + p["base"]
        assert abs(g - (z[y] - np.log(np.exp(z).sum()))) < 1e-4
    assert hashlib.sha256(target.tobytes()).hexdigest() and (ctx[-1] == pseudo_lm.EDGE).all()


def test_repeated_ids_share_nothing_else(spark):
    df = spark.createDataFrame([(3, 1), (1, 2), (5, 5), (9, 8)], "src long, dst long")
    got = {(r["node"], r["component"]) for r in components(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
