"""From raw documents to packed sequences: five stages, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize
from ledgerloom.llm.linededup import drop_boilerplate
from ledgerloom.llm.packing import pack
from ledgerloom.llm.pii import redact
from ledgerloom.llm.quality import keep_quality
from ledgerloom.llm.neardup import near_dedup


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars of the texts as they are now, and these columns."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep; null and empty texts are rejected."""
    return keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their sources' boilerplate lines."""
    return _recounted(drop_boilerplate(docs), docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies (five-word shingles,
    similarity of 0.8 or more)."""
    return near_dedup(docs, words=5, similarity=0.8)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return _recounted(redact(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, laid into sequences of 2,048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("pii_redaction", pii_redaction),
    ("packing", packing),
]

#: Suffix arrays, SimHash, boosted trees and tokenizers are beyond SQL; tests/llm checks run()
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        # Written as a caller of the stages writes them: Spark reads files in the order of their
        # sizes, and packing takes documents in the order in which they are read.
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", codec=None)
    return STAGES[-1][1](spark, docs, sf_dir)
