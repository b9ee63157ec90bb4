"""Token prices and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymeter.functions.text import col
from waymeter.session import pin

DEFAULT = "default"


def token_cost(
    prompt: Column | str, completion: Column | str, rate_in: Column | str, rate_out: Column | str
) -> Column:
    """USD of one call; missing tokens count as zero."""
    n_in = F.coalesce(col(prompt).cast("double"), F.lit(0.0))
    n_out = F.coalesce(col(completion).cast("double"), F.lit(0.0))
    return n_in / F.lit(1e6) * col(rate_in) + n_out / F.lit(1e6) * col(rate_out)


def _by_name(prices: DataFrame) -> DataFrame:
    """``_name, _pair``: one row per price name.

    The last row of a repeated name wins: by ``pos`` where the table has it, else by its own values.
    """
    pair = F.struct(F.col("input").cast("double").alias("input"), F.col("output").cast("double").alias("output"))
    order = F.struct("pos", pair) if "pos" in prices.columns else pair
    return prices.where("model is not null").groupBy(F.col("model").alias("_name")).agg(F.max_by(pair, order).alias("_pair"))


def _or_default(found: Column, prices: DataFrame) -> Column:
    default = _by_name(prices).where(F.col("_name") == DEFAULT).agg(F.max("_pair")).scalar()
    return F.coalesce(found, default, F.raise_error(F.lit("the price table needs a 'default' row")))


def price_of(prices: DataFrame, model: str) -> Column:
    """The (input, output) price of one named model, from the price table alone."""
    fits = _by_name(prices).where((F.col("_name") != DEFAULT) & F.startswith(F.lit(model), F.col("_name")) & F.lit(bool(model)))
    return _or_default(fits.agg(F.max_by("_pair", F.length("_name"))).scalar(), prices)


def priced(df: DataFrame, prices: DataFrame, model: Column | str, name: str = "price") -> DataFrame:
    """Attach ``name`` (struct input, output): the longest price name that begins the model's name.

    A null or empty model, and one that no name begins, has the ``default`` row's price; an error is raised
    if there is none. Names are found once per distinct model, by equality on its beginnings, and
    written, so that Spark knows their size when it chooses how to join the rows to them.
    """
    models = df.select(F.coalesce(col(model), F.lit("")).alias("_m")).where("_m <> ''").distinct()
    begins = F.transform(F.sequence(F.lit(0), F.length("_m")), lambda i: F.substr("_m", F.lit(1), i))
    parts = models.select("_m", F.explode(begins).alias("_name"))
    hits = parts.join(_by_name(prices).where(F.col("_name") != DEFAULT), "_name")
    hits = pin(hits.groupBy("_m").agg(F.max_by("_pair", F.length("_name")).alias("_hit")), "prices")
    joined = df.withColumn("_m", F.coalesce(col(model), F.lit(""))).join(hits, "_m", "left")
    return joined.withColumn(name, _or_default(F.col("_hit"), prices)).drop("_m", "_hit")
