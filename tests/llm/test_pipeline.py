"""The corpus pipeline stage by stage, on a table whose columns clash with the
operators' own names."""

import collections

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tarmac.llm import langid, line_dedup, simhash
from tarmac.llm.common import ARROW_BYTES, ARROW_BYTES_CONF

gen = np.random.default_rng(21)
WORDS = {"en": ["the", "and", "house", "with", "over", "green", "river"], "de": ["der", "und", "haus", "mit", "\u00fcber", "gr\u00fcn", "fluss"]}


def prose(lang, n):
    return " ".join("".join(gen.choice(WORDS[lang], 2)) + str(gen.choice(["", "s", "er"])) for _ in range(n))


SHARED = prose("en", 60)
BENCH = prose("en", 40)
ROWS = [(i, prose(lang, 45), lang) for i, lang in enumerate(["en", "de"] * 30)]
COPY = ROWS[0][1]
ROWS += [(100, None, "en"), (101, "", "en"), (102, "123 !!", "de"), (103, prose("en", 30) + "\n" + SHARED, "en"),
         (104, prose("en", 30) + "\n" + SHARED, "en"), (105, SHARED, "en"), (106, COPY + " end", "en"), (106, COPY + " end", "en"),
         (107, prose("en", 30) + " " + BENCH, "en"), (None, prose("de", 50), None), (108, "\n".join(prose("de", 40) for _ in range(60)), "de")]
CLASH = ["__id", "__tk", "__lang", "__score", "__text", "h", "fp", "lines_removed"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(*r, "s", None if r[1] is None else len(r[1])) for r in ROWS],
                               "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(c) for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, BENCH), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def keys(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_keep_columns_and_take_effect(spark, docs, folder):
    now = docs
    seen = {}
    for name, stage in P.STAGES[:-1]:
        now = P.shared_table(stage(spark, now, folder), name)
        assert now.columns == docs.columns
        assert all(r[c] == c for r in now.collect() for c in CLASH)
        seen[name] = keys(now)
    first = seen["language_id"]
    assert first == collections.Counter((i, t) for i, t, _ in ROWS if t and any(c.isalpha() for c in t))
    second = {i: t for (i, t) in seen["line_dedup"]}
    assert 105 not in second and SHARED in second[103] and SHARED not in second[104]
    assert sum(SHARED in t for t in second.values()) == 1
    # One document of every group of fingerprints within three bits.
    before = spark.createDataFrame([k for k, n in seen["line_dedup"].items() for _ in range(n)], "doc_id long, text string")
    bits = {r["doc_id"]: int(r["fingerprint"], 16) for r in simhash.simhash_groups(before).collect()}
    group = {i: i for i in bits}
    for _ in bits:
        group = {i: min((group[j] for j in bits if (bits[i] ^ bits[j]).bit_count() <= 3), key=lambda x: (x is None, x or 0)) for i in bits}
    assert {i for i, _ in seen["simhash_near_dedup"]} == set(group.values()) and set(seen["simhash_near_dedup"].values()) == {1}
    assert seen["simhash_near_dedup"] - seen["decontamination"] == collections.Counter([(107, second[107])])
    assert not seen["decontamination"] - seen["simhash_near_dedup"]


def test_run_packs_what_is_left(spark, docs, folder):
    from tokenizers import Tokenizer

    from tarmac.llm.queries import vocabulary

    now = docs
    for _, stage in P.STAGES[:-1]:
        now = P.shared_table(stage(spark, now, folder), "t")
    lib = Tokenizer.from_file(vocabulary()["json_path"])
    want = collections.Counter((r["doc_id"], len(lib.encode(r["text"], add_special_tokens=False).ids) + 1) for r in now.collect())
    got = collections.defaultdict(int)
    for r in P.run(spark, folder).collect():
        got[r["doc_id"]] += r["length"]
    assert collections.Counter(got.items()) == want


def test_empty_table(spark, docs, folder):
    now = docs.limit(0)
    for name, stage in P.STAGES:
        now = P.shared_table(stage(spark, now, folder), name)
        assert now.count() == 0


def test_rejected_share(spark, docs, folder):
    known = langid.identify(docs.drop("__lang", "__score"))
    assert known.filter("__score < 0.3 AND __lang <> 'und'").count() == 0


def evaluations(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_texts_pass_python_once(spark, docs, folder):
    known, cut = P.language_id(spark, docs, folder), P.line_dedup(spark, docs, folder)
    assert evaluations(known) == evaluations(cut) == 1
    assert "MapInArrow" not in known._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("number", [0, 1, 2, 4])
def test_texts_reach_python_in_small_batches(spark, docs, folder, number):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    spark.conf.set(ARROW_BYTES_CONF, "64m")
    try:
        P.STAGES[number][1](spark, docs, folder)
        wide = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("word "), 1000).alias("text"))
        assert max(r["n"] for r in wide.mapInArrow(sizes, "n long").collect()) < 1.5 * ARROW_BYTES
        spark.conf.set(ARROW_BYTES_CONF, "1m")  # a lower bound stays
        P.STAGES[number][1](spark, docs, folder)
        assert spark.conf.get(ARROW_BYTES_CONF) == "1m"
    finally:
        spark.conf.unset(ARROW_BYTES_CONF)


def test_lines_are_cut_only_where_a_run_repeats(spark):
    run = " ".join(f"w{i}" for i in range(30))
    rows = [(1, "a\n" + run), (2, "b\n" + run + "\n \nc"), (2, "b\n" + run + "\n \nc"), (3, "own"), (4, None), (None, ""), (5, run)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter(tuple(r) for r in line_dedup.dedup_lines(df).collect())
    assert got == collections.Counter([(1, "a\n" + run, 0), (2, "b\nc", 2), (2, "b\nc", 2), (3, "own", 0), (4, None, 0),
                                       (None, "", 0), (5, "", 1)])
