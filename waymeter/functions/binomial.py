"""Exact binomial tails as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1: Stirling's series ten steps up, and back by the recurrence."""
    y = x + 10
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    steps = F.log(x)
    for i in range(1, 10):
        steps = steps + F.log(x + i)
    return series - steps


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed from the largest term down; 1 where k is above the mean.

    Terms fall at least as fast as a normal density does, so those beyond 20 standard deviations
    change nothing in a double and are not visited, for any n.
    """
    k, n = k.cast("double"), n.cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.least(k, 20 * F.sqrt(n * p) + 200).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(0), steps), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda acc, i: F.struct((acc["term"] * (k - i) * (1 - p) / ((n - k + i + 1) * p)).alias("term"), (acc["sum"] + acc["term"]).alias("sum")),
    )
    return F.when(k > n * p, 1.0).otherwise(F.least(F.lit(1.0), F.exp(top) * total["sum"]))
