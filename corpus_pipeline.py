"""A training-data pipeline over ``documents``: five stages, each an operator of ``quillmill.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm.common import table, written
from quillmill.llm.decontamination import clean
from quillmill.llm.ngram_join import keep_one
from quillmill.llm.packing import pack
from quillmill.llm.pii import redact
from quillmill.llm.toxicity import train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on ``labels``, scores below 0.5; null and empty texts stay."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return docs.where(model.column("text") < 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (Jaccard similarity of 5-word shingles of 0.8 or more): that of the least doc_id.

    Null and blank texts all stay, one of identical rows stays; a row without
    doc_id gives way to one with.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``; null and empty texts stay, and all do where there are no items."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind, n_chars counted anew."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; null and empty texts have the end token alone, repeated rows are packed each."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Trained models and latent retrieval have no SQL form; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
