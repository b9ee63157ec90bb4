"""Paired statistics, latency, curves and frontiers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymeter.functions.binomial import binomial_tail
from waymeter.operators import resample
from waymeter.operators.layout import exact_percentiles, lay_out, number_rows, percentiles_wide

TAILS = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def pair_arms(rows: DataFrame, arms: list[str], item: str = "item", value: str = "correct") -> DataFrame:
    """One row per item, one column per arm."""
    return rows.groupBy(item).pivot("arm", arms).agg(F.max(value))


def seed_stats(rows: DataFrame, keys: list[str] = ("arm",), seed: str = "seed") -> DataFrame:
    """Mean and sample deviation over seeds of each arm's accuracy (in percent)."""
    per_seed = rows.groupBy(*keys, seed).agg((F.avg("correct") * 100).alias("acc"))
    return per_seed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("seeds"), F.avg("acc").alias("mean_acc"), F.stddev_samp("acc").alias("sd_acc")
    )


def latency(rows: DataFrame, columns: list[str], keys: list[str] = ("arm",), approx: bool = False) -> DataFrame:
    """p50, p95 and p99 of several columns per key, in long form over ``metric``."""
    keys = list(keys)
    long = rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    long = long.unpivot(keys, columns, "metric", "v").where("v is not null")
    if not approx:
        return percentiles_wide(long, [*keys, "metric"], "v", TAILS)
    cut = F.percentile_approx("v", list(TAILS.values()), 10000)
    out = long.groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("n"), cut.alias("_q"))
    return out.select(*keys, "metric", "n", *[F.col("_q")[i].alias(p) for i, p in enumerate(TAILS)])


def overhead(rows: DataFrame, direct: str, value: str = "e2e_ms", writes: int = 2) -> DataFrame:
    """Each arm's median, its distance from the direct arm's, and that distance per durable write."""
    mid = percentiles_wide(rows, ["arm"], value, {"p50": 0.5})
    base = mid.where(F.col("arm") == direct).select("p50").scalar()
    return mid.select("arm", "n", "p50", (F.col("p50") - base).alias("delta_ms")).withColumn(
        "per_write_ms", F.col("delta_ms") / writes
    )


def interval(replicates: DataFrame, value: str, keys: list[str] = (), level: float = 0.95) -> DataFrame:
    """Percentile interval over replicates: one number per replicate, so a group is small."""
    edge = (1 - level) / 2
    return replicates.groupBy(*keys).agg(
        F.percentile(value, edge).alias("lo"), F.percentile(value, 1 - edge).alias("hi"),
        F.count(value).alias("reps"),
    )


def paired_differences(rows: DataFrame, a: str, b: str, item: str = "item", value: str = "v") -> DataFrame:
    """``item, d``: arm ``a`` minus arm ``b`` for items both arms have."""

    def of(arm: str) -> Column:
        return F.avg(F.when(F.col("arm") == arm, F.col(value)))

    both = rows.where(F.col("arm").isin(a, b)).groupBy(item).agg(of(a).alias("x"), of(b).alias("y"))
    return both.where("x is not null and y is not null").select(item, (F.col("x") - F.col("y")).alias("d"))


def bootstrap_ci(
    rows: DataFrame, a: str, b: str, item: str = "item", value: str = "v", reps: int = 1000, seed: int = 0,
    level: float = 0.95,
) -> DataFrame:
    """Mean paired difference of two arms with its percentile interval; all null if they share no item."""
    diffs = paired_differences(rows, a, b, item, value)
    point = diffs.agg(F.avg("d")).scalar()
    return interval(resample.means(diffs, "d", reps, seed), "mean", level=level).select(point.alias("delta"), "lo", "hi", "reps")


def bootstrap_median_gap(
    rows: DataFrame, a: str, b: str, value: str = "v", reps: int = 1000, seed: int = 0, level: float = 0.95
) -> DataFrame:
    """Pooled difference of two arms' medians with its percentile interval; null with no replicates if an arm is missing."""
    kept = rows.where(F.col("arm").isin(a, b) & F.col(value).isNotNull()).select("arm", F.col(value).alias("v"))

    def gap(column: str) -> Column:
        return F.max(F.when(F.col("arm") == a, F.col(column))) - F.max(F.when(F.col("arm") == b, F.col(column)))

    gaps = resample.medians(kept, "v", reps, seed, ["arm"]).groupBy("rep").agg(gap("median").alias("gap"))
    point = percentiles_wide(kept, ["arm"], "v", {"p50": 0.5}).agg(gap("p50")).scalar()
    return interval(gaps, "gap", level=level).select(point.alias("delta"), "lo", "hi", "reps")


def speedup(runs: DataFrame, requests: int | Column, overhead_s: float = 0.0) -> DataFrame:
    """Per parallelism: median wall seconds of its repeats, records/s, speedup over the least p.

    ``runs`` has one row per run: ``p, repeat, wall_s``.
    """
    mid = percentiles_wide(runs, ["p"], "wall_s", {"wall_s": 0.5}).select("p", F.col("n").alias("repeats"), "wall_s")
    base = mid.agg(F.min_by("wall_s", "p")).scalar()
    n = requests if isinstance(requests, Column) else F.lit(float(requests))
    return mid.select(
        "p", "repeats", "wall_s",
        (n / F.col("wall_s")).alias("rec_per_s"),
        (base / F.col("wall_s")).alias("speedup"),
        ((base - overhead_s) / (F.col("wall_s") - overhead_s)).alias("net_speedup"),
    )


def batch_stats(rows: DataFrame, keys: list[str] = ("n", "rate"), big: str = "big") -> DataFrame:
    """Per setting, from rows that repeat their window's figures.

    A window's rows each carry its size, so windows = sum of 1/size and per-window means weight
    each row by 1/size.
    """
    keys = list(keys)
    part = F.lit(1.0) / F.col("batch")
    tokens = (F.col("judge_prompt_tokens") + F.col("judge_completion_tokens")) * part
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(part).alias("windows"),
        F.avg(tokens).alias("tokens_per_request"),
        (F.sum(F.col("judge_ms") * part) / F.sum(part) / 1000).alias("judge_s"),
        F.avg(F.col("parse_failed").cast("int")).alias("parse_failed_share"),
        F.avg((F.col("model") == big).cast("int")).alias("escalated_share"),
    )
    waits = percentiles_wide(rows, keys, "wait_ms", {"wait_p50": 0.5, "wait_p95": 0.95}, "_rows")
    return base.join(waits.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "wait_p50", "wait_p95"),
                     [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left").drop(*[f"_k_{k}" for k in keys])


def fill_model(measured: DataFrame, n: str = "n", rate: str = "rate", wait: str = "wait_s") -> DataFrame:
    """Measured window wait against the fill model N / (2 rate)."""
    model = F.col(n) / (F.lit(2.0) * F.col(rate))
    return measured.withColumn("model_wait_s", model).withColumn("gap_s", F.col(wait) - F.col("model_wait_s"))


def recall(rows: DataFrame, keys: list[str] = ("arm",)) -> DataFrame:
    """Share of each gold class that was predicted as itself."""
    return rows.groupBy(*keys, "gold").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("pred") == F.col("gold"), 1).otherwise(0)).alias("recall")
    )


def confusion(rows: DataFrame, keys: list[str] = ("arm",)) -> DataFrame:
    return rows.groupBy(*keys, "gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def majority(rows: DataFrame, keys: list[str] = ("arm",), item: str = "item") -> DataFrame:
    """Per item and arm: was it right in more than half of its seeds?"""
    return rows.groupBy(*keys, item).agg(
        (F.sum(F.col("correct").cast("int")) * 2 > F.count(F.lit(1))).cast("int").alias("correct")
    )


def mcnemar_p(b: int, c: int) -> float:
    """Exact two-sided binomial p-value of the discordant counts, for any size."""
    n = b + c
    if n == 0:
        return 1.0
    least = min(b, c)
    top = math.lgamma(n + 1) - math.lgamma(least + 1) - math.lgamma(n - least + 1) - n * math.log(2)
    total, term = 0.0, 1.0
    for k in range(least, -1, -1):  # from the largest term down, until one no longer counts
        if total + term == total:
            break
        total += term
        term *= k / (n - k + 1)
    return min(1.0, 2 * math.exp(top + math.log(total)))


def discordant(rows: DataFrame, a: str, b: str, item: str = "item") -> DataFrame:
    """One row: items only ``a`` got right (b), only ``b`` got right (c), and pairs."""
    both = pair_arms(rows.where(F.col("arm").isin(a, b)), [a, b], item)
    both = both.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    return both.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if((F.col("x") == 1) & (F.col("y") == 0)).alias("b"),
        F.count_if((F.col("x") == 0) & (F.col("y") == 1)).alias("c"),
    )


def chi_square(counts: DataFrame) -> DataFrame:
    """Continuity-corrected statistic next to the counts, for use inside a plan."""
    gap = F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0))
    return counts.withColumn("chi2", F.try_divide(gap * gap * F.lit(1.0), F.col("b") + F.col("c")))


def exact_p(counts: DataFrame) -> DataFrame:
    """The exact two-sided p-value next to the counts, inside a plan."""
    tail = binomial_tail(F.least("b", "c"), F.col("b") + F.col("c"), 0.5)
    return counts.withColumn("p_value", F.least(F.lit(1.0), 2 * tail))


def mcnemar(rows: DataFrame, a: str, b: str, item: str = "item") -> dict:
    """Discordant counts and the exact p-value; one aggregate row reaches the driver."""
    found = discordant(rows, a, b, item).first()
    return {**found.asDict(), "p_value": mcnemar_p(found["b"], found["c"])}


def oracle(rows: DataFrame, arms: list[str], small: str, item: str = "item") -> DataFrame:
    """One row: accuracy when the best arm is known per item, headroom, and escalation.

    ``escalation``: share of items sent on when ``small`` is kept exactly where it is right.
    """
    wide = pair_arms(rows.where(F.col("arm").isin(arms)), arms, item)
    best = F.greatest(*[F.coalesce(F.col(a), F.lit(0)) for a in arms])
    accs = [F.avg(a).alias(f"_acc_{i}") for i, a in enumerate(arms)]
    out = wide.agg(F.count(F.lit(1)).alias("items"), F.avg(best).alias("oracle_acc"),
                   F.avg(F.lit(1) - F.coalesce(F.col(small), F.lit(0))).alias("escalation"), *accs)
    top = F.greatest(*[F.col(f"_acc_{i}") for i in range(len(arms))])
    return out.select("items", "oracle_acc", top.alias("best_arm_acc"),
                      (F.col("oracle_acc") - top).alias("headroom"), "escalation")


def drift(rows: DataFrame, time: str, period: str = "week", model: str = "model") -> DataFrame:
    """Accuracy of one model name per calendar period and its change from the period before."""
    per = rows.groupBy(model, F.date_trunc(period, time).alias("epoch")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("correct").alias("acc")
    )
    # One row per model and period: the window is as long as the calendar.
    return per.withColumn("change", F.col("acc") - F.lag("acc").over(Window.partitionBy(model).orderBy("epoch")))


def mixture(points: DataFrame, a: str, b: str, key: str = "arm") -> DataFrame:
    """Accuracy of a random mix of two anchors at each arm's cost, and the arm's distance above it."""
    place = F.struct("usd", "acc")
    ends = points.agg(
        F.struct(
            F.max(F.when(F.col(key) == a, place)).alias("a"), F.max(F.when(F.col(key) == b, place)).alias("b")
        )
    ).scalar()
    out = points.withColumn("_e", ends)
    usd0, acc0, usd1, acc1 = (F.col(f"_e.{x}") for x in ("a.usd", "a.acc", "b.usd", "b.acc"))
    share = (F.col("usd") - usd0) / (usd1 - usd0)
    out = out.withColumn("share_b", share).withColumn("line_acc", acc0 + share * (acc1 - acc0))
    return out.withColumn("residual", F.col("acc") - F.col("line_acc")).drop("_e")


def pareto(points: DataFrame, usd: str = "usd", acc: str = "acc") -> DataFrame:
    """Points no other point beats (cost not higher and accuracy not lower, one of them strictly).

    Best accuracy per cost first; then the best accuracy at any lower cost, found with a sorted
    layout and one carried row per slab, so the number of points is not limited by one task.
    """
    best = points.groupBy(usd).agg(F.max(acc).alias("_best"))
    laid = lay_out(best, usd)
    before = Window.partitionBy("_slab").orderBy("_idx").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    tops = laid.groupBy("_slab").agg(F.max("_best").alias("_top"))
    tops = tops.select("_slab", F.max("_top").over(earlier).alias("_carry"))
    seen = laid.withColumn("_in", F.max("_best").over(before)).join(tops, "_slab")
    open_ = F.greatest(F.col("_in"), F.col("_carry"))  # greatest skips nulls
    front = seen.where(open_.isNull() | (F.col("_best") > open_)).select(
        F.col(usd).alias("_u"), F.col("_best").alias("_a")
    )
    return points.join(front, (F.col(usd) == F.col("_u")) & (F.col(acc) == F.col("_a")), "left_semi")


def sweep(axes: dict[str, list], measured: DataFrame) -> DataFrame:
    """Every cell of a settings grid with its measurement, null where none was taken.

    The grid is nested explodes of literal lists, so its size is the experiment's, not the data's.
    """
    grid = measured.sparkSession.range(1).select()
    for name, values in axes.items():
        kind = measured.schema[name].dataType
        cells = F.array(*[F.lit(v).cast(kind) for v in values])
        grid = grid.select("*", F.explode(cells).alias(name))
    return grid.join(measured, list(axes), "left")


def threshold_for_share(rows: DataFrame, score: str, share: float, approx: bool = False) -> DataFrame:
    """One row ``threshold``: the score that sends ``share`` of the rows to the big model."""
    if approx:
        return rows.agg(F.percentile_approx(F.col(score).cast("double"), 1 - share, 10000).alias("threshold"))
    return exact_percentiles(rows.select(F.col(score).cast("double").alias("s")), [], "s", [1 - share]).select(
        F.col("_q").alias("threshold")
    )
