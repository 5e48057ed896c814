"""From documents to packed token sequences: each stage is a Spark job over all that the one before it kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact, near, packing, pii, quality
from tessera.llm.common import drop_since, frugal, marked, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def lean(stage: Stage) -> Stage:
    """The stage, with Python workers that give freed memory back: they outlive a stage, and the next one needs it."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        frugal(spark)
        return stage(spark, docs, sf_dir)

    return run


@lean
def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier, learned from ``labels``, scores 0.3 or more; empty ones are scored as well."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, kept=docs.columns).where("score >= 0.3").select(docs.columns)


@lean
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside: the one with the most code points, then the smallest id."""
    return exact.without_copies(docs)


@lean
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that links of Jaccard 0.8 or more on shingles of five words reach."""
    return near.without_near_copies(docs, width=5, num=80, den=100)


@lean
def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what patterns and field find replaced by [EMAIL], [IP], [CARD], [PHONE]; n_chars follows, null stays null."""
    found = pii.find(docs, kept=docs.columns, redacted_col="redacted")
    n_chars = F.when(F.col("n_chars").isNotNull(), F.char_length("redacted").cast(docs.schema["n_chars"].dataType))
    return found.withColumn("n_chars", F.coalesce(n_chars, "n_chars")).withColumn("text", F.col("redacted")).select(docs.columns)


@lean
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, each with an end, in sequences of 2048; ids are little-endian unsigned 32-bit integers."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=1)


STAGES = [
    ("quality classifier", by_quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("PII", without_personal_data),
    ("packing", packed),
]

#: Neither the classifier's nor the field's scores can be had in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage wrote on its way is deleted when its result is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = marked()
        out = stage(spark, docs, sf_dir)
        on_the_way = marked()
        docs = written(out, name.replace(" ", "-"))
        drop_since(spark, before, on_the_way)
    return docs
