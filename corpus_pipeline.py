"""A training corpus from documents: judge, clean, de-duplicate, mix, encode.

Each stage takes ``(spark, docs, sf_dir)`` and returns documents with their own columns; the
last returns sampled segmentations. Stages are written and read again in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from listwright.llm import minhash, mixing, piece_sampling, quality, toxicity
from listwright.llm.frames import staged, table

LEAST_QUALITY = 0.3
MOST_TOXIC = 0.3


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of good quality reaches ``LEAST_QUALITY``."""
    stats = staged(quality.document_statistics(docs), "statistics")
    model = quality.train(stats, table(spark, sf_dir, "labels"))
    return quality.good(docs, model, LEAST_QUALITY)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of being toxic is below ``MOST_TOXIC``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model, MOST_TOXIC)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id.

    Rows that repeat that doc_id with the same text leave one; rows without a doc_id stay.
    """
    kept = minhash.near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    known = docs.filter(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi")
    # Of rows that differ in other columns only, the one that comes first as JSON, whatever their types.
    rest = [known[f"`{c}`"] for c in docs.columns if c not in ("doc_id", "text")]
    rows = known.select(
        "doc_id", F.xxhash64("text").alias("text"), F.to_json(F.struct(F.lit(0).alias("_"), *rest)).alias("rest"), F.struct("*").alias("row"))
    one = rows.groupBy("doc_id", "text").agg(F.min_by("row", "rest").alias("row")).select("row.*")
    return one.unionByName(docs.filter(F.col("doc_id").isNull()))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document of the mix."""
    return piece_sampling.sampled(docs)


STAGES = [
    ("quality", good_documents),
    ("toxicity", clean_documents),
    ("minhash", distinct_documents),
    ("mixing", mixed_documents),
    ("pieces", encoded_documents),
]

# Trained models and seeded sampling have no SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, f"stage-{name}")
    return docs
