"""Query catalog of the corpus operators: thin ``opN_<name>`` queries that
apply an operator to its whole table with production parameters and derive the
columns of its contract, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import (
    bpe, decontam, hadamard_kmeans, langid, line_dedup, packing, pii, pq_dedup, pseudo_lm, quality, resample, simhash, suffix,
)
from tarmac.llm.common import read_table
from tarmac.llm.sampling_sql import OP11_SQL, OP12_SQL

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines removed and a digest of the remaining text."""
    out = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "lines_removed", F.octet_length("text").cast("long").alias("bytes_kept"),
                      F.sha2("text", 256).alias("text_sha256"))


def op2_pq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def vocabulary() -> dict[str, str]:
    """Paths of the public vocabulary used for packing, as operator parameters."""
    import public_tokenizers

    return {"json_path": public_tokenizers.path("byte_bpe_50k.json"),
            "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken")}


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), **vocabulary())


#: Stands in for the caller's secret in the registered query.
PSEUDONYM_KEY = "registered query"


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return out.select("doc_id", "n_replaced", "text")


def op5_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identify(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"),
                      F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.benchmark_hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return hits.select(
        F.col("__id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read_table(spark, sf_dir, "documents"))


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_lm.score_documents(read_table(spark, sf_dir, "documents"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark's distribution of words."""
    out = resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_hadamard_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hadamard_kmeans.cluster(read_table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                      hadamard_kmeans.digest(F.col("centroid")).alias("centroid_sha256"))


def op13_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text they decode to."""
    path = vocabulary()["json_path"]
    out = bpe.decode(bpe.encode(read_table(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def llm_queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_pq_near_dedup": op2_pq_near_dedup,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_pii_pseudonyms": op4_pii_pseudonyms,
        "op5_quality_cotraining": op5_quality_cotraining,
        "op6_language_id": op6_language_id,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_decontamination": op8_decontamination,
        "op9_simhash": op9_simhash,
        "op10_pseudo_likelihood": op10_pseudo_likelihood,
        "op11_resample": op11_resample,
        "op12_hadamard_kmeans": op12_hadamard_kmeans,
        "op13_bpe_automaton": op13_bpe_automaton,
    }


SQL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP8_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SQL_WORD}+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SQL_WORD}+') AS w
  FROM benchmark),
bl AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bi AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl),
bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM bi),
lens AS (SELECT DISTINCT n FROM bw),
di AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
dw AS (SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM di),
hit AS (SELECT rid, dw.n, i, item FROM dw JOIN bw ON dw.g = bw.g),
pos AS (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hit)),
cnt AS (SELECT rid, count(DISTINCT p) AS n_hit FROM pos GROUP BY rid),
its AS (SELECT rid, list_sort(list(DISTINCT item)) AS items FROM hit WHERE item IS NOT NULL GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cnt USING (rid) LEFT JOIN its USING (rid)
"""


OP2_SQL = """
WITH RECURSIVE e AS (
  SELECT row_number() OVER () AS rid, vec_id,
         CASE WHEN vec_id IS NULL THEN 'n' || row_number() OVER () ELSE 'v' || vec_id END AS nk,
         CASE WHEN len(embedding) > 0
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                   AND len(list_filter(embedding, lambda x: x <> 0)) > 0
              THEN CAST(embedding AS DOUBLE[]) END AS v
  FROM embeddings),
u AS (SELECT rid, nk, vec_id, v, len(v) AS n, sqrt(list_dot_product(v, v)) AS norm FROM e WHERE v IS NOT NULL),
p AS (SELECT a.rid, a.nk, b.nk AS other
      FROM u a JOIN u b ON a.rid <> b.rid AND a.n = b.n
      WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95),
n AS (SELECT rid, count(*) AS n_links FROM p GROUP BY rid),
r AS (SELECT DISTINCT nk AS s, nk AS t FROM u
      UNION SELECT r.s, p.other FROM r JOIN p ON r.t = p.nk),
c AS (SELECT s, min(vec_id) AS component_id FROM r JOIN (SELECT DISTINCT nk, vec_id FROM u) k ON k.nk = r.t GROUP BY s)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(component_id, e.vec_id) AS component_id,
       coalesce(coalesce(component_id, e.vec_id) = e.vec_id, false) AS kept
FROM e LEFT JOIN n USING (rid) LEFT JOIN c ON c.s = e.nk
"""


def llm_sql() -> dict[str, str]:
    return {"op2_pq_near_dedup": OP2_SQL, "op8_decontamination": OP8_SQL, "op11_resample": OP11_SQL,
            "op12_hadamard_kmeans": OP12_SQL}
