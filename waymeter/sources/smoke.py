"""Generated smoke prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymeter import fixed
from waymeter.functions.text import col


def smoke_prompt(number: Column | str) -> Column:
    """An easy prompt for even numbers, a hard one for odd numbers."""
    n = col(number)

    def around(parts: tuple[str, str]) -> Column:
        return F.concat(F.lit(parts[0]), n.cast("string"), F.lit(parts[1]))

    return F.when(n % 2 == 0, around(fixed.SMOKE_EASY)).otherwise(around(fixed.SMOKE_HARD))


def smoke(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select("id", smoke_prompt("id").alias("prompt"))
