"""Merged summaries against exact answers, whatever the order of runs."""

import random

import pytest
from pyspark.sql import functions as F

from waymeter.functions import prompts
from waymeter.operators import sketches
from waymeter.session import scratch


def test_quantiles_of_merged_runs(spark):
    rng, table, values = random.Random(1), scratch(spark, "sketches"), []
    for run in range(3):
        part = [("a", rng.lognormvariate(run, 1)) for _ in range(4000)] + [("b", None), ("b", 5.0)]
        values += [v for arm, v in part if arm == "a"]
        frame = spark.createDataFrame(part, "arm string, ms double").repartition(4)
        for _ in range(2):  # a repeated run replaces itself
            sketches.append(sketches.quantile_sketches(frame, ["arm"], ["ms"]), table, f"r{run}")
    out = {r["arm"]: r for r in sketches.quantiles(sketches.read(spark, table), ["arm"], {"p50": 0.5, "p95": 0.95}).collect()}
    assert (out["a"]["n"], out["b"]["n"], out["b"]["p50"]) == (12000, 3, 5.0)
    for name, p in (("p50", 0.5), ("p95", 0.95)):
        assert sum(v < out["a"][name] for v in values) / 12000 == pytest.approx(p, abs=sketches.RANK_ERROR)


def test_distinct_counts_of_merged_runs(spark):
    rows = spark.range(60_000).select((F.col("id") % 5).cast("string").alias("run"), (F.col("id") % 40_000).alias("v"))
    kept = sketches.distinct_sketches(rows, ["run"], "v")
    assert sketches.distinct_counts(kept, []).first()[0] == pytest.approx(40_000, rel=sketches.DISTINCT_ERROR)
    assert {r["distinct"] for r in sketches.distinct_counts(kept.where("run = '1'"), ["run"]).collect()} <= set(range(7800, 8201))


def test_overlap_without_a_join(spark):
    rows = spark.range(90_000).select(F.when(F.col("id") < 50_000, "pre").otherwise("post").alias("side"), F.when(F.col("id") < 50_000, F.col("id")).otherwise(F.col("id") - 20_000).alias("v"))
    both, either = sketches.overlap(sketches.set_sketches(rows, ["side"], "v"), "side", "pre", "post").first()
    assert both == pytest.approx(20_000, abs=70_000 * sketches.OVERLAP_ERROR) and either == pytest.approx(70_000, rel=sketches.OVERLAP_ERROR)
    both, either = sketches.overlap(sketches.set_sketches(rows.where("side = 'pre'"), ["side"], "v"), "side", "pre", "post").first()
    assert both == 0 and either == pytest.approx(50_000, rel=sketches.OVERLAP_ERROR)


def test_blank_messages_get_no_prompt(spark):
    rows = spark.createDataFrame([(1, " hi ", "x"), (2, " \n\t", "y"), (3, None, "z"), (4, "", None)], "id int, msg string, label string")
    assert [r["id"] for r in prompts.moderation_prompts(rows, "msg").collect()] == [1]
    out = prompts.intent_prompts(rows, "msg", "label").collect()
    assert [r["id"] for r in out] == [1] and "- x\n- y\n- z" in out[0]["prompt"]
