"""The corpus pipeline: documents in, token digests of what is kept out.

Each stage reads its predecessor's rows as a Parquet table and returns rows with the columns of documents, any others included;
the last returns the encoded documents. Nulls, empty texts, repeated rows and empty tables are dealt with as the operators state:
a null or empty text has no language and goes at once. Stages learn from, count over and compare only what their predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from municipia.llm import decontamination, jaccard_join, language_id, quality_rules, sentencepiece_codec
from municipia.llm.queries import PIECE_MODEL
from municipia.llm.shared import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identified_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a posterior of one half or more."""
    return language_id.keep_identified(docs, PIECE_MODEL)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose posterior quality is one half or more."""
    return quality_rules.keep_good(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of linked documents, and rows without doc_id."""
    return jaccard_join.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontamination.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return sentencepiece_codec.encode_digests(docs, PIECE_MODEL)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identified_language),
    ("quality_rules", good_quality),
    ("jaccard_join", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("sentencepiece", encoded),
]

#: SQL can express neither learning nor tokenizers. The tests hold run() against its stages one by one, and each stage against
#: its operator's report, which the operators' own tests hold against brute force or planted cases.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table in the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
