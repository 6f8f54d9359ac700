"""Corpus pipeline: five stages, each one corpus operator on all that the stage before kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the
shared folder and reads it back as the next stage's docs. The columns of documents go through unchanged,
extra ones too. The mixture's order is a column, mix_pos, since files have no order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridgework.llm import bpe, common, exact_dedup, mixing, near_dedup
from ridgework.llm import quality as quality_op


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects."""
    return quality_op.accepted(docs, common.read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies."""
    return near_dedup.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every document in the mixture of sources, by mix_pos."""
    return mixing.mix(docs).drop("mix_stream", "mix_slot")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each text by its ids."""
    return bpe.encode(docs, keep_cache=False)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("bpe", tokens)]

#: SQL can't express the classifier; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents: doc_id, lang, source, n_chars, mix_pos, ids."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
