"""A corpus from documents: STAGES in order, each over all that the one before kept.

Every stage takes rows with nulls in any column, empty and very long texts, repeated rows, no rows at all, and further
columns of whatever name; what it does with them its function states. All but the last return the columns that they got."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kontaktor.llm import neardup, packing, quality, secrets, toxicity
from kontaktor.llm.common import discard, table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, trained on the labelled ones, rejects. Null and empty texts score as its prior and stay;
    repeated rows stay or go together."""
    return toxicity.without_toxic(docs, toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rules or the fertility bands reject: null and empty texts among them. Repeated rows stay or go
    together."""
    return quality.of_quality(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the smallest doc_id, and of a repeated doc_id one row. Documents without
    words are linked with nothing; rows without a doc_id stay."""
    return neardup.without_copies(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep every row; secrets in its text become a mark, and n_chars follows. Null texts stay null."""
    return secrets.redacted(docs)


def in_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack every document into training sequences. A null or empty text is its end token; repeated rows are documents of their own."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("quality_rules", of_quality),
    ("minhash_near_dedup", without_copies),
    ("secret_scan", without_secrets),
    ("best_fit_packing", in_sequences),
]

#: Trained classifiers and subword vocabularies are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if k:
            discard(before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)  # packing has read it
    return out
