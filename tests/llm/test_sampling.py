"""Resampling, clustering and byte-pair encoding against straight versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from tarmac.llm import bpe, hadamard_kmeans, resample
from tarmac.llm.queries import vocabulary

gen = np.random.default_rng(11)
TEXTS = [
    "The red fox, the RED fox!", "a" * 30 + " b", None, "", " ,;! \n", "naïve Ünï 日本 x9 x9 x9",
    " ".join(gen.choice(["up", "down", "left", "Right", "é", "9"], 3000)), "the red fox " * 9,
]


def table(spark, texts, ids=None):
    rows = [(i, t, 1, 2) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int, n long")


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return "".join(c if c.isdigit() and c.isascii() or "a" <= c <= "z" or ord(c) > 127 else " " for c in low).split(" ")


def straight(docs, target, buckets, run, seed, percent, least):
    def features(t):
        w = [x for x in words(t) if x]
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, run + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for b in features(text)[1]:
            s[b] += 1
    for text in target:
        for b in features(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    rows = []
    for i, text in docs:
        n, f = features(text)
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        name = "" if i is None else i
        h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    may = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1:4]))
    return rows, may[:percent * len(may) // 100]


@pytest.mark.parametrize("run,buckets", [(1, 10_000), (3, 61)])
def test_resample(spark, monkeypatch, run, buckets):
    monkeypatch.setattr(resample, "STEP", 40)  # texts in several stretches
    monkeypatch.setattr(resample, "DOCS", 3)
    monkeypatch.setattr(resample, "FEATURES", 100)
    ids = [*range(len(TEXTS)), None, 3, 3, *range(100, 140)]
    texts = [*TEXTS, "one two three", "up down", "up down", *[" ".join(gen.choice(["up", "down", "in"], 30)) for _ in range(40)]]
    target = ["up up in", None, "the fox", ""]
    rows, drawn = straight(list(zip(ids, texts)), target, buckets, run, 2024, 30, 2)
    got = resample.resample(table(spark, texts, ids).repartition(3), table(spark, target), percent=30, min_words=2,
                            buckets=buckets, run=run).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got), key=repr) == sorted(rows, key=repr)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["doc_id"], r["score"]) for r in ranked] == [(r[0], r[4]) for r in drawn]


def test_resample_edges(spark):
    docs, none = table(spark, TEXTS), table(spark, [None, ""])
    assert resample.resample(docs.limit(0), docs).count() == 0
    assert {r["weight"] for r in resample.resample(none, none).collect()} == {0}
    same = table(spark, ["up down " * 20] * 50, [7] * 50)  # one row repeated: numbered one by one
    ranks = sorted(r["rank"] for r in resample.resample(same, docs).collect() if r["rank"])
    assert ranks == [1, 2, 3, 4, 5]


def test_plane_sums_are_exact():
    gain = gen.integers(-20000, 20000, 700)
    doc, bucket = np.divmod(np.sort(gen.choice(5 * 700, 2000, replace=False)), 700)
    count = gen.integers(1, 1 << 40, 2000) >> gen.integers(0, 40, 2000)
    count = np.maximum(count, 1)
    want = [sum(int(c) * int(gain[b]) for d, b, c in zip(doc, bucket, count) if d == k) for k in range(5)]
    bits = int(np.abs(gain).max()).bit_length() + 1
    assert resample.plane_sums(doc, bucket, count, 5, resample.planes(gain, bits)).tolist() == want


def lloyd(x, ids, k, rounds, seed):
    order = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"{seed}:{ids[i]}".encode()).hexdigest(),))
    c = x[order[:k]].copy()
    for _ in range(rounds):
        far = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        best = far.argmin(axis=1)
        for j in range(k):
            if (best == j).any():
                c[j] = x[best == j].sum(axis=0) // (best == j).sum()
    far = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    return c, far.argmin(axis=1), far.min(axis=1)


def test_cluster(spark):
    raw = np.concatenate([gen.normal(m, 0.3, (60, 64)) for m in (-1, 0, 0.2, 2)])
    raw[7] = raw[9]  # equal vectors
    rows = [(i, v.tolist(), 0, 0) for i, v in enumerate(raw)]
    odd = [[0.5] * 63, [0.5] * 65, [None] + [0.0] * 63, [float("nan")] + [0.0] * 63, [float("-inf")] + [0.0] * 63, None, []]
    rows += [(1000 + i, v, 0, 0) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, x int").repartition(5)
    x = np.floor(1024 * raw).astype(np.int64)
    for rounds in (0, 1, 10):
        c, best, far = lloyd(x, list(range(len(x))), 8, rounds, 3)
        got = {r["vec_id"]: r for r in hadamard_kmeans.cluster(df, rounds=rounds).collect()}
        assert sorted(got) == list(range(len(x)))
        for i, r in got.items():
            assert (r["cluster"], r["distance"], r["centroid"]) == (best[i], far[i], c[best[i]].tolist())
            assert r["cluster_inertia"] == far[best == best[i]].sum() and r["inertia"] == far.sum()
    assert hadamard_kmeans.cluster(df.limit(0)).count() == 0
    few = hadamard_kmeans.cluster(df.filter("vec_id < 3")).collect()
    assert {r["distance"] for r in few} == {0} and len(few) == 3
    with pytest.raises(Exception, match="no exact 64-bit"):
        hadamard_kmeans.cluster(spark.createDataFrame([(1, [3000.0] * 64)], "vec_id long, embedding array<double>"))


def test_cluster_repeated_and_null_ids(spark):
    v = [[float(i % 3)] * 64 for i in range(30)]
    df = spark.createDataFrame([(None if i % 5 else i % 2, x) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = hadamard_kmeans.cluster(df, clusters=4).collect()
    assert len(got) == 30 and all(r["distance"] >= 0 for r in got)


def test_transform_is_exact():
    x = gen.integers(-2000, 2000, (20, 64))
    y = hadamard_kmeans.transform(x)
    assert (hadamard_kmeans.inverse(y) == x).all()
    signs = (np.diff(hadamard_kmeans.transform(np.eye(64, dtype=int)).T, axis=1) != 0).sum(axis=1)
    assert signs.tolist() == list(range(64))  # coarse to fine
    c = gen.integers(-2000, 2000, (9, 64))
    c[4] = c[2]  # a tie goes to the smaller number
    best, far = hadamard_kmeans.nearest(y, hadamard_kmeans.transform(c))
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (best == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()


PATH = vocabulary()["json_path"]
PIECES = ["a", "b", " ", "  ", "\n", "aaaa", "the", "ing", "é", "日本", "😀", "'s", "'", "1", "23", "<|endoftext|>", "<|", "՘",
          "\x85", "​", " \n ", "Ä", "==", "....", "\t", "　"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_encoder_equals_library(monkeypatch):
    monkeypatch.setattr(bpe, "STEP", 23)  # texts in several stretches
    own, lib = bpe.Encoder(bpe.load_automaton(PATH), PATH), library()
    pick = random.Random(5)
    texts = ["".join(pick.choice(PIECES) for _ in range(pick.randint(0, 30))) for _ in range(1500)]
    texts += ["".join(pick.choice("aabcdeinorst ") for _ in range(pick.randint(0, 150))) for _ in range(800)]
    texts += [c * n for c in "a -=.0x" for n in (1, 2, 3, 17, 48, 49, 129, 5000)]
    for t in texts:
        some = [w for part in own.words(t) for w in part]
        assert "".join(some) == t
        got = own.tokens(some)[0].tolist() if some else []
        assert got == lib.encode(t, add_special_tokens=False).ids, t


def test_automaton_equals_successive_merges():
    """A small vocabulary: every word over its bytes, against the merges applied in order."""
    labels = [b"a", b"b", b"c"]
    merges = []
    for u, v in [(0, 0), (0, 1), (3, 0), (4, 2), (3, 3), (1, 6), (5, 4), (2, 2), (9, 0), (10, 3)]:
        merges.append((u, v, len(labels)))
        labels.append(labels[u] + labels[v])
    fsa = bpe.Automaton(labels, merges, {})
    own = bpe.Encoder(fsa, "")
    import itertools

    def straight_(word):
        ids = [b"abc".index(bytes([x])) for x in word]
        for u, v, w in merges:
            i = 0
            while i + 1 < len(ids):
                if ids[i:i + 2] == [u, v]:
                    ids[i:i + 2] = [w]
                i += 1
        return ids

    every = [bytes(w) for n in range(1, 9) for w in itertools.product(b"abc", repeat=n)]
    flat, count = own.read(every)
    ends = np.cumsum(count)
    for w, a, z in zip(every, ends - count, ends):
        assert flat[a:z].tolist() == straight_(w), w
    longer = [bytes(gen.choice(list(b"abc"), 200).tolist()) for _ in range(20)]
    flat, count = own.read(longer)
    assert flat.tolist() == [t for w in longer for t in straight_(w)]


def test_encode_and_decode_tables(spark, monkeypatch):
    long = "\n".join(f"line {i} of a very long text, naïve 日本" for i in range(30000))
    texts = [*TEXTS, long, "<|endoftext|>x<|endoftext|>", TEXTS[0], "՘՘ a"]
    df = table(spark, texts, [*range(len(texts) - 1), None]).withColumnsRenamed({"n": "ids"}).repartition(2)
    out = bpe.encode(df, PATH)
    assert out.columns == ["doc_id", "ids"]
    lib = library()
    rows = bpe.decode(out, PATH).collect()
    want = [(None if i == len(texts) - 1 else i, lib.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in enumerate(texts)]
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in rows), key=repr) == sorted(want, key=repr)
    assert bpe.decode(bpe.encode(df.limit(0), PATH), PATH).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([160, 999999, -1, None],), ([50256, 64],)], "ids array<int>")
    text = [r["decoded"] for r in bpe.decode(odd, PATH).collect()]
    assert text[:2] == [None, ""] and text[2] == "�" == lib.decode([160]) and text[3] == "<|endoftext|>a"


def test_other_kinds_of_vocabulary_are_refused(tmp_path):
    import json
    import pathlib

    spec = json.loads(pathlib.Path(PATH).read_text())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.load_automaton(str(tmp_path / "v.json"))
