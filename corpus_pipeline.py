"""From documents to tokens: toxic texts out, exact and near copies out, sources mixed, texts encoded.

Each stage takes what its predecessor kept and returns the same columns, the last one token ids. Stages decide
by row, not by id: the three that compare rows first write them with a running number. So rows that repeat or
whose id is null are copies of each other like any other rows. Of copies the one with the smallest id stays, one
without an id only if no copy has one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymeter.llm import bpe, exact, mixing, near, queries, toxicity
from waymeter.session import pin

SHARE, EPOCHS = (9, 10), 1  # of the tokens that reach the mixing stage, each read once at most
ROW, ORDER = "__row", "__order"


def _numbered(docs: DataFrame) -> DataFrame:
    return pin(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _only(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return docs.join(rows.select(ROW), ROW, "left_semi").drop(ROW)


def _order() -> Column:
    """Rows by id, those without one last, ties by number."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _numbered(docs)
    kept = exact.exact_duplicates(docs.select(_order().alias(ORDER), "text"), id_col=ORDER).where("kept")
    return _only(docs, kept.select(F.col(f"{ORDER}.row").alias(ROW)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _numbered(docs)
    groups = near.near_duplicates(docs.select(ROW, "text"), id_col=ROW, words=5, percent=80).select(ROW, "component_id")
    first = groups.join(docs.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(F.min(_order()).alias("first"))
    return _only(docs, first.select(F.col("first.row").alias(ROW)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _numbered(docs)
    levels = {"domain": queries.domain_of(F.coalesce("source", F.lit(""))), "lang": F.col("lang"), "source": F.col("source")}
    mixed = mixing.mix(docs, levels, queries.WEIGHTS, SHARE, EPOCHS, queries.SEED, row_col=ROW)
    return _only(docs, mixed.where("copies > 0"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), also=("ids",))


STAGES = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode),
]
ORACLE_SQL = None  # a fitted model, a similarity join with components and a tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def entries() -> dict:
    return {"pipeline": (run, ORACLE_SQL)}
