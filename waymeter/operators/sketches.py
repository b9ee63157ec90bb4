"""Mergeable summaries: quantiles, distinct counts and set overlaps that are kept per run and added up for any grouping.

A run's summaries are one small row per group, appended to a table under the run's name. Later questions merge these rows
and never go back to the requests, so a new run costs one pass over itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUANTILE_K, LOG_REGISTERS, LOG_ENTRIES = 2000, 14, 14
#: What the sketches promise, three times over: KLL's rank error for its k, and the relative errors of HLL and theta, the latter against the union.
RANK_ERROR = 3 * 2.296 / QUANTILE_K**0.9021
DISTINCT_ERROR = 3 * 1.04 / math.sqrt(1 << LOG_REGISTERS)
OVERLAP_ERROR = 3 / math.sqrt(1 << LOG_ENTRIES)


def quantile_sketches(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``*keys, metric, n, sketch``: one KLL sketch per group and column, built in the map tasks. Nulls are left out."""
    long = rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, columns, "metric", "v").where("v is not null")
    return long.groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("v", F.lit(QUANTILE_K)).alias("sketch"))


def quantiles(sketches: DataFrame, keys: list[str], points: dict[str, float]) -> DataFrame:
    """``*keys, metric, n`` and a column per point; each value's rank is within ``RANK_ERROR`` of the point."""
    merged = sketches.groupBy(*keys, "metric").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(QUANTILE_K)).alias("_s"))
    return merged.select(*keys, "metric", "n", *[F.kll_sketch_get_quantile_double("_s", F.lit(p)).alias(name) for name, p in points.items()])


def distinct_sketches(rows: DataFrame, keys: list[str], value: Column | str) -> DataFrame:
    """``*keys, sketch``: one HLL sketch of a value per group."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(value, F.lit(LOG_REGISTERS)).alias("sketch"))


def distinct_counts(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, distinct``: distinct values over all runs of a group, within ``DISTINCT_ERROR`` of the number."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def set_sketches(rows: DataFrame, keys: list[str], value: Column | str) -> DataFrame:
    """``*keys, sketch``: one theta sketch of a value per group."""
    return rows.groupBy(*keys).agg(F.theta_sketch_agg(value, F.lit(LOG_ENTRIES)).alias("sketch"))


def overlap(sketches: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """One row ``both, either``: values common to two groups and in any of them, without a join of the values.

    Each is within ``OVERLAP_ERROR`` times the number in either. A group that is missing counts as empty.
    """

    def side(name: str) -> Column:
        return F.theta_union_agg(F.when(F.col(key) == name, F.col("sketch")), F.lit(LOG_ENTRIES)).alias(f"_{name}")

    sides = sketches.agg(side(a), side(b))
    x, y = F.col(f"_{a}"), F.col(f"_{b}")
    return sides.select(F.theta_sketch_estimate(F.theta_intersection(x, y)).alias("both"), F.theta_sketch_estimate(F.theta_union(x, y, F.lit(LOG_ENTRIES))).alias("either"))


def append(sketches: DataFrame, table: str, run: str) -> None:
    """Puts a run's summaries into a table; a run that is repeated replaces its own."""
    sketches.write.mode("overwrite").parquet(f"{table.rstrip('/')}/part={run}")


def read(spark: SparkSession, table: str) -> DataFrame:
    """The summaries of all runs, with the run in ``part``."""
    return spark.read.parquet(table)
