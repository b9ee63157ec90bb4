"""Poisson bootstrap on counted values.

Equal values are counted before anything is drawn. A value that occurs c times gets one Poisson(c) weight per replicate, which has the
distribution of the sum of c single weights, so the rows are distinct values x replicates, however often values repeat. A weight comes
from a digest of (group, rank of the value, replicate, seed) and is found by the inverse distribution function in columns: repeatable under
retries and any partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymeter.operators.layout import number_rows

EXACT = 12  # counts up to this are inverted exactly, larger ones by a second-order normal expansion
DRAWS = 5  # of 32 bits each from one digest
RANKS = 1024  # values of a block in which the median is looked for
#: The rational approximation 26.2.23 of Abramowitz and Stegun to the inverse normal distribution.
ABOVE, BELOW = (2.515517, 0.802853, 0.010328), (1.0, 1.432788, 0.189269, 0.001308)


def poisson_cuts(c: int, bits: int = 32) -> list[int]:
    """A draw of so many bits weighs as many as there are cuts not above it."""
    cuts, total, k = [], 0.0, 0
    while round(total * 2**bits) < 2**bits and k < 20 * c + 40:
        total += math.exp(k * math.log(c) - c - math.lgamma(k + 1))
        cuts.append(min(round(total * 2**bits), 2**bits))
        k += 1
    return [x for x in cuts if x < 2**bits]


def tail(draw: Column) -> Column:
    """What the normal expansion needs of a draw: sqrt(-2 ln p) for the nearer end's probability p."""
    u = (draw + 0.5) / float(1 << 32)
    return F.sqrt(-2 * F.ln(F.least(u, 1 - u)))


def poisson(draw: Column, t: Column, c: Column) -> Column:
    """The Poisson(c) weight of a draw of 32 bits and its :func:`tail`."""
    side = t - (ABOVE[0] + t * (ABOVE[1] + t * ABOVE[2])) / (BELOW[0] + t * (BELOW[1] + t * (BELOW[2] + t * BELOW[3])))
    z = F.when(draw < 1 << 31, -side).otherwise(side)
    large = F.greatest(F.lit(0.0), F.floor(c + F.sqrt(c) * z + (z * z - 1) / 6 + 0.5).cast("double")).cast("long")
    exact = F.array(*[F.array(*map(F.lit, poisson_cuts(k))) for k in range(1, EXACT + 1)])  # a literal, once planned
    small = F.size(F.filter(F.element_at(exact, c.cast("int")), lambda x: x <= draw)).cast("long")
    return F.when(c <= EXACT, small).otherwise(large)


def counted(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``*keys, v, c, rank``: the distinct values of each group, how often they occur, and their places from 1. Null values are left out."""
    some = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    return number_rows(some.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c")), keys, ["v"], "rank")


def drawn(values: DataFrame, keys: list[str], reps: int, seed: int) -> DataFrame:
    """The rows of :func:`counted` with their weight in each replicate, ``rep, w``; made inside the task that holds the value."""
    spread = values.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // DRAWS))))
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.col("rank").cast("string"), F.col("_b").cast("string"), F.lit(str(seed)))
    spread = spread.withColumn("_h", F.sha1(F.encode(text, "UTF-8")))
    draws = [F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("long") for i in range(DRAWS)]
    # Exploded, so that a draw is worked out once and not wherever the weight's formula uses it.
    spread = spread.select(*values.columns, "_b", F.posexplode(F.array(*[F.struct(d.alias("draw"), tail(d).alias("t")) for d in draws])).alias("_i", "_d"))
    out = spread.select(*values.columns, (F.col("_b") * DRAWS + F.col("_i")).alias("rep"), poisson(F.col("_d.draw"), F.col("_d.t"), F.col("c")).alias("w"))
    return out.where(F.col("rep") < reps)


def means(rows: DataFrame, value: str, reps: int, seed: int, keys: list[str] = ()) -> DataFrame:
    """``*keys, rep, mean``: the weighted mean of each replicate, reduced in the tasks that draw."""
    keys = list(keys)
    draws = drawn(counted(rows, keys, value), keys, reps, seed)
    return draws.groupBy(*keys, "rep").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("mean"))


def medians(rows: DataFrame, value: str, reps: int, seed: int, keys: list[str]) -> DataFrame:
    """``*keys, rep, median``: the middle of each weighted replicate, between its two middle values if they are two.

    Weights are first added up by blocks of consecutive ranks, in the tasks that draw. Running sums over
    the blocks tell where a replicate's middle lies, and only that block's values are drawn again and summed one by one.
    """
    values = counted(rows, keys, value).withColumn("block", F.floor(F.col("rank") / RANKS))
    sums = drawn(values, keys, reps, seed).groupBy(*keys, "rep", "block").agg(F.sum("w").alias("w"))
    group = Window.partitionBy(*keys, "rep")
    upto = F.sum("w").over(group.orderBy("block"))
    placed = sums.withColumns({"upto": upto, "total": F.sum("w").over(group)})
    middle = placed.withColumns({"low": F.floor((F.col("total") + 1) / 2), "high": F.floor((F.col("total") + 2) / 2), "before": F.col("upto") - F.col("w")})
    hit = lambda at, a="before", b="upto": (F.col(a) < F.col(at)) & (F.col(at) <= F.col(b))
    wanted = middle.where(hit("low") | hit("high")).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("rep").alias("_rep"), F.col("block").alias("_block"), "before", "low", "high")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    found = drawn(values.join(wanted.select(*[f"_{k}" for k in keys], "_block").distinct(), [*same, F.col("block") == F.col("_block")], "left_semi"), keys, reps, seed)
    found = found.join(wanted, [*same, F.col("block") == F.col("_block"), F.col("rep") == F.col("_rep")])
    inside = F.sum("w").over(Window.partitionBy(*keys, "rep", "block").orderBy("rank"))  # at most RANKS rows
    summed = found.withColumn("to", F.col("before") + inside).withColumn("from", F.col("to") - F.col("w"))
    ends = {name: F.max(F.when(hit(name, "from", "to"), F.col("v"))) for name in ("low", "high")}
    return summed.groupBy(*keys, "rep").agg(((ends["low"] + ends["high"]) / 2).alias("median"))
