"""Seeded shuffles, samples per group, ids and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymeter.functions.text import content_key
from waymeter.operators.layout import number_rows, top_per_group
from waymeter.sources.readers import first_by_key


def order_key(unique: str, seed: int) -> Column:
    """Shuffle key of a row: a digest of its unique id and the seed, repeatable anywhere."""
    return F.sha1(F.encode(F.concat(F.col(unique).cast("string"), F.lit(f"|{seed}")), "UTF-8"))


def shuffle(df: DataFrame, unique: str, seed: int, name: str = "place") -> DataFrame:
    """The rows in seeded order, with each row's place from 1 in ``name``; no task sorts more than a slab."""
    keyed = df.withColumn("_o", order_key(unique, seed))
    return number_rows(keyed, [], ["_o", unique], name).drop("_o")


def assign_ids(df: DataFrame, unique: str, seed: int, prefix: str, width: int = 4) -> DataFrame:
    """Zero-padded ids by position after a seeded shuffle, without a one-task sort."""
    placed = shuffle(df, unique, seed, "_at")
    digits = (F.col("_at") - 1).cast("string")
    padded = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return placed.withColumn("id", F.concat(F.lit(prefix), padded)).drop("_at")


def first_n(df: DataFrame, order: list[str | Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def balanced(df: DataFrame, label: str, n: int, seed: int, unique: str) -> DataFrame:
    """Equal numbers of each class: k = min(smallest class, n div 2) rows of every class."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    k = sizes.agg(F.min("_n")).scalar()
    top = top_per_group(df.withColumn("_o", order_key(unique, seed)), [label], ["_o", unique], n // 2, unique)
    return top.where(F.col("_rn") <= k).drop("_o", "_rn")


def stratified(df: DataFrame, label: str, n: int, seed: int, unique: str) -> DataFrame:
    """per = max(1, n div labels) rows of each label, then the first n of the shuffled union."""
    per = df.select(label).distinct().agg(
        F.greatest(F.lit(1), F.floor(F.lit(n) / F.count(F.lit(1)))).cast("long")
    ).scalar()
    top = top_per_group(df.withColumn("_o", order_key(unique, seed)), [label], ["_o", unique], n, unique)
    return top.where(F.col("_rn") <= per).orderBy("_o", unique).limit(n).drop("_o", "_rn")


def quota(df: DataFrame, source: str, k: int, n: int, order: list[str], unique: str, seed: int) -> DataFrame:
    """The first k rows of each source, then the first n of the shuffled union."""
    top = top_per_group(df, [source], order, k, unique).drop("_rn")
    return top.withColumn("_o", order_key(unique, seed)).orderBy("_o", unique).limit(n).drop("_o")


def dedup_first(df: DataFrame, text: str, order: str | Column) -> DataFrame:
    """Exact duplicates of ``text`` dropped, the first kept.

    Reduced per map task on a digest of the text, so a text that fills a third of the table
    reaches the shuffle once per task.
    """
    return first_by_key(df.withColumn("_key", content_key(text)), ["_key"], order).select(*df.columns)
