"""Corpus preparation: each stage's kept documents are the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociform.llm import mixing, near_dedup, pii, quality, sentence_pieces
from lociform.llm.common import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores at least 0.3; fitted on labelled documents of the input."""
    field = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, field)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets are at least 0.8 similar."""
    return near_dedup.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the new text."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to the target weights; as many tokens as there are, at most two epochs."""
    return mixing.mix(docs).select(*docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document that the mix holds."""
    return sentence_pieces.encode(docs, sentence_pieces.read_model(sentence_pieces.MODEL)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("personal data", pii_stage),
    ("source mixing", mixing_stage),
    ("sentence pieces", pieces_stage),
]
#: The line field, the registers and the transducer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
