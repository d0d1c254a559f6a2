"""Corpus pipeline: five stages over ``documents``, each one of the numbered operators.

Rows with a null doc_id, null text or repeated doc_id pass through the same rules as in the
operators; every stage but the last returns the columns of its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterlake.llm import decontam, lines_crf, packing, pii, simhash
from rasterlake.llm._common import materialise, table
from rasterlake.llm.queries import KEEP_QUALITY, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject."""
    return lines_crf.keep(docs, lines_crf.train(docs, table(spark, sf_dir, "labels")), KEEP_QUALITY)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of SimHash near-duplicates (five-word shingles, similarity 0.8)."""
    return simhash.keep_first(docs, width=5, plan=simhash.WIDE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked by its kind and n_chars brought up to date."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in the training sequences."""
    return packing.pack(docs.select("doc_id", "text"), vocabulary())


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("PII", redact),
    ("best-fit packing", pack),
]
#: SQL can express neither the trained classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name.replace(' ', '-')}")
    return docs
