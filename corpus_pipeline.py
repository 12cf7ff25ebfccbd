"""The corpus pipeline: five stages over the ``documents`` table.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each result as Parquet into the shared checkpoint folder and reads it
again as the next stage's input. The first four keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.common import read_table, shared_table, shielded, unshielded
from tarmac.llm.decontam import drop_contaminated
from tarmac.llm.langid import UNKNOWN, identify
from tarmac.llm.line_dedup import dedup_lines
from tarmac.llm.packing import pack_documents
from tarmac.llm.queries import vocabulary
from tarmac.llm.simhash import drop_near_copies

#: A document of which no language holds this share of the words is rejected.
MIN_SHARE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents written in a language that could be recognised. Null texts,
    and texts without letters, have none and go; an empty table stays empty.
    Columns that clash with the operator's own names are kept."""
    plain, names = shielded(docs)
    known = identify(plain)
    kept = known.filter((F.col("__lang") != UNKNOWN) & (F.col("__score") >= MIN_SHARE)).select(*plain.columns)
    return unshielded(kept, names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later repeated runs of lines; documents that lose every word go.
    Null texts, and texts that were empty before, stay. ``n_chars`` follows the text."""
    plain, names = shielded(docs, "lines_removed")
    cut = dedup_lines(plain)
    emptied = (F.col("lines_removed") > 0) & (F.trim(F.translate("text", "\n\t\r", "   ")) == "")
    kept = cut.filter(~F.coalesce(emptied, F.lit(False))).withColumn(
        "n_chars", F.when(F.col("lines_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*plain.columns)
    return unshielded(kept, names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of SimHash links (3 words, 3 bits)."""
    return drop_near_copies(docs, shingle=3, max_bits=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth of the words stands in benchmark windows."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the remaining documents into sequences of 2048 tokens."""
    return pack_documents(docs, **vocabulary())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Fingerprints, the trained field and tokenisation are beyond SQL; the stages
#: are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to packed pieces."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return docs
