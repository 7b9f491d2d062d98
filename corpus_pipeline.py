"""A training corpus from ``documents``, in five stages.

Each stage takes what its predecessor kept: toxic texts go, then exact copies
(the largest doc_id stays), then near copies (the least doc_id of a group
stays), sources are mixed to their target weights (a document comes as often
as the mix takes it), and the mix is encoded to token ids. All but the last
return the columns of ``documents``. A group's decision is by doc_id: where
rows repeat one, it stays if any of its rows would.

SQL can't express the toxicity model and the tokenizer; tests/llm compares the
stages with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import exact_dedup, mixing, ngram_join, sentencepiece, toxicity
from cairn.llm.queries import PIECES
from cairn.plans.durable import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.learn(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = ngram_join.ngram_components(docs)
    stays = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__stays")).distinct()
    return docs.join(stays, F.col("doc_id").eqNullSafe(F.col("__stays")), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(docs, PIECES)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes from one to the next is a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
