"""Graders, policies, prices and statistics on edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymeter.functions import grading, money, text
from waymeter.operators import cost, policies, resample, stats, windows
from waymeter.sources import readers


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r["o"] for r in df.select("i", build(F.col("t")).alias("o")).orderBy("i").collect()]


def test_number(spark):
    cases = [("ANSWER: 1,234", "1234"), ("so ANSWER: 2 no ANSWER: 3", "3"), ("ANSWER: c but 7", "7"), ("costs 1,000.50 now", "1000.5"),
             (None, "1"), ("", "1"), ("ANSWER: 5", "x"), ("answer: -4", "-4.0"), ("ANSWER: 5.0000001", "5")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, g string")
    got = [r["ok"] for r in df.select("i", grading.grade_number("t", "g").alias("ok")).orderBy("i").collect()]
    assert got == [True, True, True, True, False, False, False, True, True]


def test_letter(spark):
    texts = ["ANSWER: b", "ANSWER: Apple", "I pick C. Or D", "ABC éA Aé", "ANSWER: 3, so B", "x" * 10 + "A " + "y" * 200, None]
    assert column(spark, texts, grading.answered_letter) == ["B", "A", "D", None, "B", None, None]


def test_binary_and_label(spark):
    assert column(spark, ["ANSWER: toxic", "all SAFE \n", "toxic.", "NOT TOXIC", "ANSWER: SAFE ANSWER: TOXIC"], grading.answered_binary) == [
        "TOXIC", "SAFE", None, "TOXIC", "TOXIC"]
    assert column(spark, ["ANSWER: Card Lost?\nx", "Answer: top/up-by_card", "none"], grading.answered_label) == ["card_lost", "top_up_by_card", None]


def test_code_block(spark):
    assert column(spark, ["a ```python\nx\n``` ```y```", "no fence", None, "``` open"], grading.code_block) == ["x\n", "no fence", "", "``` open"]


def test_signed_bucket(spark):
    import hashlib

    texts = [f"prompt {i} é" for i in range(200)]
    want = [int.from_bytes(hashlib.sha1(t.encode()).digest()[:2], "big", signed=True) % 100 for t in texts]
    assert column(spark, texts, text.bucket) == want


def test_ts(spark):
    got = column(spark, ["1970-01-01T00:00:01Z", "1970-01-01T01:00:00+01:00", "1970-01-02", "soon", "1700000000000", None], text.ts_ms)
    assert got == [1000.0, 0.0, 86400000.0, None, None, None]
    assert column(spark, ["1700000000000"], lambda c: text.ts_ms(c, True)) == [1700000000000.0]


def pick(spark, policy, texts):
    return column(spark, texts, lambda c: policy(c)["selected"])


def test_policies(spark):
    texts = ["write SQL now", "hello", "x" * 401, "", None]
    assert pick(spark, policies.keyword_length(), texts) == ["big", None, "big", None, None]
    assert pick(spark, policies.rules({"big": policies.fixed.RULES_PATTERN, "mid": "hello"}), texts) == ["big", "mid", None, None, None]
    assert pick(spark, policies.weighted({"other": 3.0}), texts[:2]) == ["small", "small"]
    with pytest.raises(ValueError):
        policies.weighted({})
    many = [f"t{i}" for i in range(2000)]
    assert pick(spark, policies.coin(0.8), many).count("big") == pytest.approx(1600, abs=80)
    three = pick(spark, policies.coin(0.8, candidates=["a", "b", "c"]), many)
    assert all(abs(three.count(n) - 667) < 90 for n in "abc")
    w = pick(spark, policies.weighted({"a": 1, "b": 3}, candidates=["a", "b", "c"]), many)
    assert w.count("c") == 0 and w.count("b") == pytest.approx(1500, abs=80)
    assert pick(spark, policies.weighted({"a": 1, "b": 3}, 1, ["a", "b"]), many) == pick(spark, policies.weighted({"a": 1, "b": 3}, 1, ["a", "b"]), many)


def test_window_verdicts(spark):
    rows = [(i, 0, [{"at": k, "id": f"{i}-{k}", "prompt": "p"} for k in range(3)], r) for i, r in enumerate(
        ['{"choices": ["big", "Big"]}', "{oops", '{"x": 1}', "", None, '{"choices": "big"}', '{"choices": ["big","small","big","big"]}'])]
    df = spark.createDataFrame(rows, "lane int, wid int, requests array<struct<at: int, id: string, prompt: string>>, reply string")
    out = windows.batch_verdicts(df, "reply").orderBy("lane", "at").collect()
    models = [[r["model"] for r in out if r["lane"] == i] for i in range(7)]
    assert models == [["big", "small", "small"]] + [["small"] * 3] * 5 + [["big", "small", "big"]]
    assert [r["parse_failed"] for r in out if r["at"] == 0] == [False, True, False, False, False, False, False]


def price_brute(rows, model):
    """The longest name that begins the model's; the last of equal names; else the default."""
    table = {}
    for name, *pair in rows:
        table[name] = tuple(pair)
    best = None
    for name in table:
        if name is not None and name != "default" and model and model.startswith(name) and (best is None or len(name) > len(best)):
            best = name
    return table["default" if best is None else best]


@pytest.mark.parametrize("size", [3, 5000])
def test_prices_against_brute_force(spark, size):
    rng = random.Random(size)
    rows = [("default", 1.0, 1.0), ("default", 0.5, 9.0), ("m", 2.0, 2.0), ("", 7.0, 7.0), ("m", 1.5, 3.0), (None, 8.0, 8.0)]
    rows += [("m" + "".join(rng.choice("ab-") for _ in range(rng.randrange(9))), float(i), 0.0) for i in range(size)]
    rng.shuffle(rows)
    models = ["z", None, "", "m", "default", "default-x", *["m" + "".join(rng.choice("ab-") for _ in range(rng.randrange(12))) for _ in range(300)]]
    prices = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "model string, input double, output double, pos long")
    got = money.priced(spark.createDataFrame([(m,) for m in models], "m string"), prices, "m").select("m", "price.input", "price.output").collect()
    assert len(got) == len(models)
    for r in got:
        assert (r.input, r.output) == price_brute(rows, r.m), r
    for m in ("z", "m-a", "default"):
        one = spark.range(1).select(money.price_of(prices, m).alias("p")).first().p
        assert tuple(one) == price_brute(rows, m)


def test_prices_need_a_default_only_when_used(spark):
    prices = spark.createDataFrame([("m", 2.0, 3.0)], "model string, input double, output double")
    one = spark.createDataFrame([("mx",)], "m string")
    assert money.priced(one, prices, "m").first().price.output == 3.0
    with pytest.raises(Exception, match="default"):
        money.priced(one.union(spark.createDataFrame([("z",)], "m string")), prices, "m").collect()
    pinned = readers.read_prices(spark)
    got = money.priced(spark.createDataFrame([("gpt-4o-mini-2024",), ("GPT-4o",)], "m string"), pinned, "m").collect()
    assert {(r.m, r.price.input, r.price.output) for r in got} == {("gpt-4o-mini-2024", 0.15, 0.6), ("GPT-4o", 0.0, 0.0)}


def test_arm_cost(spark):
    rows = [("a", "gpt-4o", None, 1000, 100, None, None, 1), ("a", "", "gpt-4o-mini", 1000, None, 10, 1, 0), ("a", None, None, None, None, None, None, None),
            ("b", "x", "y", 5, 5, None, None, None)]
    df = spark.createDataFrame(rows, "arm string, model_name string, final_model string, prompt_tokens long, completion_tokens long, judge_prompt_tokens long, judge_completion_tokens long, graded_correct int")
    out = {r["arm"]: r for r in cost.arm_cost(df, readers.read_prices(spark)).collect()}
    assert out["a"]["requests"] == 3 and out["a"]["accuracy"] == 0.5 and out["b"]["accuracy"] is None
    assert out["a"]["usd_total"] == pytest.approx(0.0037, abs=1e-4) and out["a"]["by_model"] == {"gpt-4o": 1, "gpt-4o-mini": 1, "": 1}


def test_mcnemar_p():
    assert stats.mcnemar_p(0, 0) == 1.0
    assert stats.mcnemar_p(5, 5) == 1.0
    assert stats.mcnemar_p(1, 9) == pytest.approx(2 * sum(math.comb(10, k) for k in range(2)) / 2**10)
    for b, c in ((600, 700), (60_000, 61_000), (5_000_000, 5_004_000)):
        z = (abs(b - c) - 1) / math.sqrt(b + c)
        assert stats.mcnemar_p(b, c) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=0.02)


def test_exact_p_in_a_plan(spark):
    cases = [(0, 0), (5, 5), (1, 9), (0, 60), (600, 700), (60_000, 61_000)]
    out = stats.exact_p(spark.createDataFrame(cases, "b long, c long")).collect()
    assert {(r.b, r.c): r.p_value for r in out} == {(b, c): pytest.approx(stats.mcnemar_p(b, c), rel=1e-8) for b, c in cases}


def test_settings_without_waits_stay(spark):
    rows = [(20, 1.0, 2, 5, 5, 10.0, False, "big", None), (20, 1.0, 2, 5, 5, 10.0, False, "big", None), (50, None, 1, 3, 3, 4.0, True, "small", 9.0)]
    df = spark.createDataFrame(rows, "n int, rate double, batch int, judge_prompt_tokens long, judge_completion_tokens long, judge_ms double, parse_failed boolean, model string, wait_ms double")
    out = {r.n: r for r in stats.batch_stats(df).collect()}
    assert set(out) == {20, 50} and out[20].wait_p50 is None and out[20].requests == 2 and out[50].wait_p95 == 9.0


def test_published_seed_spread(spark):
    rows = [("rules", s, 1 if i < a else 0) for s, a in ((1, 951), (2, 951), (3, 956)) for i in range(1000)]
    out = stats.seed_stats(spark.createDataFrame(rows, "arm string, seed int, correct int")).first()
    assert round(out["mean_acc"], 1) == 95.3 and round(out["sd_acc"], 1) == 0.3


def test_bootstrap_intervals(spark, narrow):
    rng = np.random.default_rng(3)
    x, y = rng.normal(100, 10, 900), rng.normal(90, 10, 900)
    data = [("a", i, float(v)) for i, v in enumerate(x)] + [("b", i, float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(data, "arm string, item long, v double")
    out = stats.bootstrap_ci(df, "a", "b", reps=200).first()
    boot = [(x - y)[rng.integers(0, 900, 900)].mean() for _ in range(2000)]
    assert out["delta"] == pytest.approx((x - y).mean())
    assert (out["lo"], out["hi"]) == pytest.approx(tuple(np.percentile(boot, [2.5, 97.5])), abs=0.35)
    mid = stats.bootstrap_median_gap(df, "a", "b", reps=300).first()
    gaps = [np.median(x[rng.integers(0, 900, 900)]) - np.median(y[rng.integers(0, 900, 900)]) for _ in range(2000)]
    assert mid["delta"] == pytest.approx(np.median(x) - np.median(y))
    assert (mid["lo"], mid["hi"]) == pytest.approx(tuple(np.percentile(gaps, [2.5, 97.5])), abs=0.4)


def test_bootstrap_of_repeated_values(spark, narrow):
    """Counts on both sides of the exact inversion; the spread is that of resampling the rows themselves."""
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 40, 3000), np.r_[rng.integers(0, 30, 2500), np.full(500, 7)]
    data = [("a", i, float(v)) for i, v in enumerate(x)] + [("b", i, float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(data, "arm string, item long, v double").repartition(5)
    out = stats.bootstrap_ci(df, "a", "b", reps=400).first()
    boot = [(x - y)[rng.integers(0, 3000, 3000)].mean() for _ in range(2000)]
    assert (out["lo"], out["hi"]) == pytest.approx(tuple(np.percentile(boot, [2.5, 97.5])), abs=0.12) and out["reps"] == 400
    assert resample.drawn(resample.counted(df, ["arm"], "v"), ["arm"], 400, 0).count() <= 400 * 70
    mid = stats.bootstrap_median_gap(df, "a", "b", reps=400).first()
    gaps = [np.median(x[rng.integers(0, 3000, 3000)]) - np.median(y[rng.integers(0, 3000, 3000)]) for _ in range(2000)]
    assert (mid["lo"], mid["hi"]) == pytest.approx(tuple(np.percentile(gaps, [2.5, 97.5])), abs=1.01)


def test_medians_over_many_blocks(spark, narrow, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(g, float(v)) for g in ("a", None) for v in rng.integers(0, 90, 400)], "arm string, v double")
    whole = {(r["arm"], r["rep"]): r["median"] for r in resample.medians(df, "v", 15, 3, ["arm"]).collect()}
    weights = {}
    for r in resample.drawn(resample.counted(df, ["arm"], "v"), ["arm"], 15, 3).collect():
        weights.setdefault((r["arm"], r["rep"]), []).extend([r["v"]] * r["w"])
    assert whole == {k: float(np.median(v)) for k, v in weights.items()} and len(whole) == 30
    monkeypatch.setattr(resample, "RANKS", 7)
    assert whole == {(r["arm"], r["rep"]): r["median"] for r in resample.medians(df, "v", 15, 3, ["arm"]).collect()}


def test_poisson_weights(spark):
    draws = spark.range(20000).select(F.conv(F.substr(F.sha1(F.col("id").cast("string")), F.lit(1), F.lit(8)), 16, 10).cast("long").alias("h"))
    for c in (1, 2, 12, 13, 50, 4000):
        got = draws.select(resample.poisson(F.col("h"), resample.tail(F.col("h")), F.lit(c).cast("long")).alias("w")).agg(F.avg("w"), F.var_samp("w"), F.min("w")).first()
        assert got[0] == pytest.approx(c, rel=0.03) and got[1] == pytest.approx(c, rel=0.06) and got[2] >= 0


def test_bootstrap_without_an_arm(spark, narrow):
    some = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), (None, 3, 1.0)], "arm string, item long, v double")
    for df in (some, some.limit(0)):
        assert tuple(stats.bootstrap_ci(df, "a", "b", reps=20).first()) == (None, None, None, 0)
        assert tuple(stats.bootstrap_median_gap(df, "a", "b", reps=20).first()) == (None, None, None, 0)


def test_a_random_mix_cannot_beat_its_better_anchor(spark):
    points = spark.createDataFrame([("nano", 0.09, 84.5), ("big", 1.078, 88.2), ("rand", 0.727, 86.9)], "arm string, usd double, acc double")
    out = {r["arm"]: r for r in stats.mixture(points, "nano", "big").collect()}
    assert out["rand"]["line_acc"] == pytest.approx(86.885, abs=0.01) and out["big"]["residual"] == pytest.approx(0)
    assert all(r["line_acc"] <= 88.2 + 1e-9 for r in out.values())


def test_agreement(spark):
    df = spark.createDataFrame([("sql",), ("hello",)], "t string")
    out = policies.agreement(df, "t", policies.rules({"big": "sql"}), policies.fixed_model("small")).first()
    assert tuple(out) == (2, 1, 0.5)
