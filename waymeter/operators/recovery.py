"""Audits across a restart: which decisions were replayed, which calls were re-issued."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymeter import fixed
from waymeter.functions.text import sha1_key


def replayed(pre: DataFrame, post: DataFrame, key: str = "workload_id") -> DataFrame:
    """Items decided on both sides, one row per item: ``key, pre_*, post_*``."""
    rest = [c for c in pre.columns if c != key and c in post.columns]
    a = pre.select(key, *[F.col(c).alias(f"pre_{c}") for c in rest])
    b = post.select(key, *[F.col(c).alias(f"post_{c}") for c in rest])
    return a.join(b, key)


def moved() -> Column:
    return ~F.col("pre_model").eqNullSafe(F.col("post_model"))


def diverged_items(both: DataFrame, key: str = "workload_id", n: int = 20) -> DataFrame:
    """The first ``n`` diverged keys in order."""
    return both.where(moved()).select(key).orderBy(key).limit(n)


def divergence(pre: DataFrame, post: DataFrame, key: str = "workload_id", examples: int = 20) -> DataFrame:
    """One row: sizes, replayed, diverged, rate to 4 places (null when nothing was replayed).

    One full join answers all counts; its shuffles are reused for the example list.
    """
    a = pre.select(key, F.col("model").alias("pre_model"), F.lit(True).alias("in_pre"))
    b = post.select(key, F.col("model").alias("post_model"), F.lit(True).alias("in_post"))
    both = a.join(b, key, "full")
    again = F.col("in_pre").isNotNull() & F.col("in_post").isNotNull()
    listed = diverged_items(both.where(again), key, examples).agg(F.array_sort(F.collect_list(key)))
    out = both.agg(
        F.count("in_pre").alias("decided_pre_kill"),
        F.count("in_post").alias("decided_post_restore"),
        F.count_if(again).alias("replayed_decisions"),
        F.count_if(again & moved()).alias("diverged"),
    )
    rate = F.round(F.try_divide(F.col("diverged"), F.col("replayed_decisions")), 4)
    return out.withColumn("divergence_rate", rate).withColumn("diverged_items", listed.scalar())


def divergence_by_head(pre: DataFrame, post: DataFrame) -> DataFrame:
    """Replayed, diverged and rate of two backend logs reduced to one model per prompt head."""
    both = replayed(pre, post, "prompt_head")
    return both.agg(
        F.count(F.lit(1)).alias("replayed"), F.count_if(moved()).alias("diverged")
    ).withColumn("rate", F.round(F.try_divide(F.col("diverged"), F.col("replayed")), 4))


def fingerprint(pre: DataFrame, post: DataFrame, key: str = "workload_id") -> DataFrame:
    """Replayed with the same model, and with the very same recorded decision time as well."""
    both = replayed(pre, post, key)
    same_time = F.col("pre_decision_ms").eqNullSafe(F.col("post_decision_ms"))
    return both.agg(
        F.count(F.lit(1)).alias("replayed"),
        F.count_if(~moved()).alias("same_model"),
        F.count_if(~moved() & same_time).alias("identical"),
    )


def determinism(trials: DataFrame) -> DataFrame:
    """Divergence share per policy class with and without a durable store.

    ``trials``: ``policy, store (durable | none), replayed, diverged``.
    """
    share = F.try_divide(F.sum("diverged"), F.sum("replayed"))
    return trials.groupBy("policy").pivot("store", ["durable", "none"]).agg(share)


def invocations(ledger: DataFrame, kill_ts: float) -> DataFrame:
    """One row per prompt key with every count the ledger questions need; one shuffle."""
    recv, resp, err = (F.col("phase") == p for p in ("recv", "resp", "resp_err"))
    early = F.col("ts") <= F.lit(kill_ts)
    return ledger.groupBy("prompt_sha1").agg(
        F.count_if(recv).alias("recv"),
        F.count_if(resp & early).alias("resp_before"),
        F.count_if(resp & ~early).alias("resp_after"),
        F.count_if(err).alias("broken"),
    )


def ledger_sets(ledger: DataFrame, kill_ts: float) -> DataFrame:
    """Per prompt key: membership in re-issued, completed-before-kill and in-flight.

    ``in_flight`` follows broken replies only; ``in_flight_wide`` adds replies that came after
    the kill, which a dead peer's socket may have accepted.
    """
    return invocations(ledger, kill_ts).select(
        "prompt_sha1",
        "recv",
        (F.col("recv") > 1).alias("reissued"),
        (F.col("resp_before") > 0).alias("completed"),
        (F.col("broken") > 0).alias("in_flight"),
        ((F.col("broken") > 0) | (F.col("resp_after") > 0)).alias("in_flight_wide"),
        "broken",
    )


def ledger_of_items(requests: DataFrame, sets: DataFrame) -> DataFrame:
    """Workload items with their ledger row, by SHA-1 of the prompt."""
    items = requests.select(F.col("id").alias("workload_id"), sha1_key("prompt").alias("prompt_sha1"))
    return items.join(sets, "prompt_sha1")


def reissue(
    ledger: DataFrame, pre: DataFrame, post: DataFrame, kill_ts: float, wid_sha: DataFrame | None = None,
    reply_tokens: int = fixed.FIXED_REPLY_TOKENS, examples: int = 10,
) -> DataFrame:
    """One row: the in-flight audit. ``pre``/``post`` carry ``prompt_sha1`` or are mapped by ``wid_sha``."""
    sets = ledger_sets(ledger, kill_ts)
    both = replayed(pre, post)
    if wid_sha is not None:
        both = both.join(wid_sha, "workload_id")
    else:
        both = both.withColumn("prompt_sha1", F.col("workload_id"))
    again = both.join(sets.where("reissued").select("prompt_sha1"), "prompt_sha1", "left_semi")
    kept = again.agg(F.struct(F.count_if(~moved()).alias("kept"), F.count_if(moved()).alias("moved"))).scalar()
    listed = diverged_items(again, n=examples).agg(F.array_sort(F.collect_list("workload_id")))
    got = F.col("recv") > 0
    return sets.agg(
        F.coalesce(F.sum("recv"), F.lit(0)).alias("ledger_recv_total"),
        F.count_if(got).alias("unique_prompts_invoked"),
        F.coalesce(F.sum("broken"), F.lit(0)).alias("in_flight_at_kill"),
        F.count_if("reissued").alias("reissued_prompts"),
        F.count_if(F.col("in_flight") & F.col("reissued")).alias("inflight_and_reissued"),
        F.count_if(F.col("in_flight_wide") & F.col("reissued")).alias("inflight_wide_and_reissued"),
        F.count_if(F.col("completed") & F.col("reissued")).alias("completed_prekill_reissued"),
        F.coalesce(F.max("recv"), F.lit(0)).alias("max_recv_per_prompt"),
        F.coalesce(F.lit(reply_tokens) * F.sum(F.greatest(F.col("recv") - 1, F.lit(0))), F.lit(0)).alias("double_billed_tokens"),
    ).select(
        "*",
        kept.getField("kept").alias("reissued_decision_kept"),
        kept.getField("moved").alias("reissued_decision_diverged"),
        listed.scalar().alias("diverged_items"),
    )


def invocations_hist(ledger: DataFrame) -> DataFrame:
    """How many prompts were invoked once, twice, …"""
    calls = ledger.where("phase = 'recv'").groupBy("prompt_sha1").agg(F.count(F.lit(1)).alias("invocations"))
    return calls.groupBy("invocations").agg(F.count(F.lit(1)).alias("prompts"))


def attribution(rows: DataFrame, aliases: list[str], keys: list[str]) -> DataFrame:
    """Models visible to accounting, decisions logged, rows whose model is only an alias.

    Distinct models are counted on (keys, model) groups, after the rows were reduced to them.
    """
    model = F.nullif(F.col("model_name"), F.lit(""))
    per_model = rows.groupBy(*keys, model.alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.count("decision_source").alias("logged")
    )
    real = F.col("model").isNotNull() & ~F.col("model").isin(aliases)
    return per_model.groupBy(*keys).agg(
        F.sum("n").alias("requests"),
        F.count_if(real).alias("models_visible"),
        F.sum("logged").alias("decisions_logged"),
        F.sum(F.when(F.col("model").isin(aliases), F.col("n")).otherwise(0)).alias("alias_rows"),
    )
