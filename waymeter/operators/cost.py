"""Cost and accuracy per arm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymeter import fixed
from waymeter.functions.money import price_of, priced, token_cost
from waymeter.session import pin


def model_column() -> Column:
    """The model a call is billed to: model_name, else final_model, else ''."""
    return F.coalesce(
        F.nullif(F.col("model_name"), F.lit("")), F.nullif(F.col("final_model"), F.lit("")), F.lit("")
    )


def with_usd(df: DataFrame, prices: DataFrame, judge_model: str = fixed.JUDGE_MODEL) -> DataFrame:
    """Add ``model, call_usd, judge_usd, usd``."""
    out = priced(df.withColumn("model", model_column()), prices, "model", "_call")
    out = out.withColumn("call_usd", token_cost("prompt_tokens", "completion_tokens", "_call.input", "_call.output"))
    out = judge_usd(out, prices, judge_model)
    return out.withColumn("usd", F.col("call_usd") + F.col("judge_usd")).drop("_call")


def judge_usd(df: DataFrame, prices: DataFrame, judge_model: str = fixed.JUDGE_MODEL) -> DataFrame:
    """Add ``judge_usd``: judge tokens at the judge model's rate, zero without tokens."""
    out = df.withColumn("_judge", price_of(prices, judge_model))
    usd = token_cost("judge_prompt_tokens", "judge_completion_tokens", "_judge.input", "_judge.output")
    return out.withColumn("judge_usd", usd).drop("_judge")


def arm_cost(
    rows: DataFrame, prices: DataFrame, judge_model: str = fixed.JUDGE_MODEL, key: str = "arm"
) -> DataFrame:
    """Per arm: requests, accuracy over graded rows, usd_total, usd_per_1k, by_model.

    Rows are reduced to token sums per (arm, model) before anything is shuffled or priced. ``by_model``
    holds one entry for each model of an arm, as the result it stands for does.
    """
    tokens = ["prompt_tokens", "completion_tokens", "judge_prompt_tokens", "judge_completion_tokens"]
    sums = rows.withColumn("model", model_column()).groupBy(key, "model").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("graded_correct").alias("graded"),
        F.sum(F.col("graded_correct").cast("long")).alias("correct"),
        *[F.sum(t).alias(t) for t in tokens],
    )
    per_model = judge_usd(priced(pin(sums, "sums"), prices, "model", "_call"), prices, judge_model)
    per_model = per_model.withColumn("usd", token_cost("prompt_tokens", "completion_tokens", "_call.input", "_call.output") + F.col("judge_usd"))
    acc = F.try_divide(F.sum("correct"), F.sum("graded"))
    by_model = F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "n"))))
    return per_model.groupBy(key).agg(
        F.sum("n").alias("requests"),
        F.round(acc, 4).alias("accuracy"),
        F.round(F.sum("usd"), 4).alias("usd_total"),
        F.round(F.sum("usd") / F.sum("n") * 1000, 4).alias("usd_per_1k"),
        by_model.alias("by_model"),
    )


def pct_of(costs: DataFrame, base: str, usd: str = "usd_per_1k", key: str = "arm") -> DataFrame:
    """Cost as a percentage of the baseline arm's."""
    baseline = costs.where(F.col(key) == base).agg(F.max(usd)).scalar()
    return costs.withColumn("pct_of_base", F.try_divide(F.lit(100.0) * F.col(usd), baseline))


def mix(rows: DataFrame, keys: list[str], model: str = "selected_model") -> DataFrame:
    """Rows and share per selected model within each key."""
    counted = rows.groupBy(*keys, model).agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("_all"))
    return counted.join(totals, keys).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def grade_counts(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """graded, correct, ungradable, acc (0 when nothing was graded)."""
    g = F.col("graded_correct")
    return rows.groupBy(*keys).agg(
        F.count(g).alias("graded"),
        F.coalesce(F.sum(g.cast("long")), F.lit(0)).alias("correct"),
        F.count_if(g.isNull()).alias("ungradable"),
    ).withColumn("acc", F.coalesce(F.try_divide(F.col("correct"), F.col("graded")), F.lit(0.0)))


def by_slice(rows: DataFrame) -> DataFrame:
    return rows.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))


def join_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Left lookup of the answer key; rows without one stay and are ungradable.

    ``answers`` has one row per id; Spark broadcasts it only when its size allows.
    """
    key = answers.select(
        F.col("id").alias("workload_id"), F.col("slice").alias("gold_slice"), F.col("answer").alias("gold"),
        F.lit(True).alias("has_gold"),
    )
    return rows.join(key, "workload_id", "left").withColumn("has_gold", F.coalesce("has_gold", F.lit(False)))
