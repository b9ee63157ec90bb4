"""Set operations on keys. Both sides become sets before they meet, so repeats never multiply."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def intersect(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_semi")


def subtract(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``a`` (repeats kept) whose keys ``b`` lacks."""
    return a.join(b.select(*keys).distinct(), keys, "left_anti")
