"""Quality rules whose cutoffs come with a guarantee. DataFrame functions only.

A rule rejects a text whose measure lies above a cutoff. For every rule and stratum a fixed ladder
of cutoffs is tested, from the mildest down, on labelled texts that should be kept: the exact binomial
tail P(Bin(n, risk) <= false rejections) has to be at most ``error / (rules * strata)``, and the first
failure ends the ladder. So with a probability of 1 - error, no certified cutoff anywhere rejects more than
``risk`` of the good texts of its stratum: each ladder is a fixed sequence, and the ladders share the
error evenly. Of the certified cutoffs of a ladder, the one with the best balance of rejected bad texts and
``price`` times rejected good texts is used, the mildest of equals; without a gain the rule stays off there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymeter.functions.binomial import binomial_tail
from waymeter.session import pin

SPACES, WORD = "[\\x20\\x09-\\x0D]+", "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
LADDER = [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02, 0.01]
RISK, ERROR, PRICE = 0.005, 0.05, 20
RULES = ["symbols", "dup_lines", "repeats", "upper", "bangs"]


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: Column | None = None) -> DataFrame:
    """Counts over whole texts: ``id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and more.

    Everything is computed inside the row. Windows are compared by a 64-bit hash of their words; only texts
    in which one occurs twice are looked at further. A null text has no words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), (F.lit("") if stratum is None else F.coalesce(stratum.cast("string"), F.lit(""))).alias("stratum"), text.alias("t"))
    rows = rows.withColumn("words", F.filter(F.split("t", SPACES), lambda w: w != "")).withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)))
    without = lambda pattern: F.length("t") - F.length(F.regexp_replace("t", pattern, ""))
    rows = rows.select(
        "id", "stratum", "words", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        without("[A-Z]").cast("long").alias("n_upper"), without("!").cast("long").alias("n_bangs"),
    )
    starts = F.sequence(F.lit(1), F.col("n_words").cast("int") - (WINDOW - 1))
    hashes = F.when(F.col("n_words") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, F.lit(WINDOW)))))
    rows = rows.withColumn("hashes", hashes).drop("words")
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), placed)).drop("hashes")
    same = lambda s, k: s["h"] == F.get("placed", k)["h"]
    again = F.filter("placed", lambda s, k: F.coalesce(F.when(k > 0, same(s, k - 1)), F.lit(False)) | F.coalesce(same(s, k + 1), F.lit(False)))
    at = F.sort_array(F.transform(again, lambda s: s["i"]))
    covered = F.aggregate(
        at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda acc, p: F.struct((acc["n"] + (p + WINDOW) - F.greatest(p, acc["upto"])).alias("n"), (p + WINDOW).alias("upto")),
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered["n"], F.lit(0).cast("long"))).drop("placed")


def shares() -> dict[str, Column]:
    """Each rule's measure, 0 where there is nothing to divide by."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"),
        "upper": share("n_upper", "word_chars"), "bangs": share("n_bangs", "word_chars"),
    }


def cutoffs(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", risk: float = RISK, error: float = ERROR, price: int = PRICE) -> DataFrame:
    """``stratum, rule, cutoff, n, false_rejections, rejections``: one row for each rule in force.

    ``labels`` are the holdout; several labels of one id count as its smallest. Null labels are left out.
    """
    held = labels.where(F.col(good_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(good_col).alias("good"))
    ladder = F.array(*map(F.lit, LADDER))
    step = lambda share: F.size(ladder) - F.size(F.filter(ladder, lambda c: c < share)) + 1  # noqa: E731  the mildest step that rejects
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), step(share).alias("step")) for name, share in shares().items()]))
    labelled = measured.join(held, "id").select("stratum", "good", rules.alias("r")).select("stratum", "good", "r.rule", "r.step")
    counts = labelled.groupBy("stratum", "rule", "step").agg(F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("k"), F.sum(F.when(F.col("good") == 1, 0).otherwise(1)).alias("bad"))
    groups = counts.groupBy("stratum", "rule").agg(F.sum("k").alias("n"))
    tests = groups.agg(F.count(F.lit(1))).scalar()
    dense = groups.select("stratum", "rule", "n", F.explode(F.sequence(F.lit(1), F.lit(len(LADDER)))).alias("step"))
    down = Window.partitionBy("stratum", "rule").orderBy("step")
    tried = dense.join(counts, ["stratum", "rule", "step"], "left").select(
        "stratum", "rule", "n", "step", F.sum(F.coalesce("k", F.lit(0))).over(down).alias("false_rejections"), F.sum(F.coalesce("bad", F.lit(0))).over(down).alias("rejections")
    )
    passed = F.when(binomial_tail(F.col("false_rejections"), F.col("n"), risk) <= F.lit(error) / tests, 1).otherwise(0)
    certified = tried.withColumn("passed", passed).withColumn("so_far", F.min("passed").over(down)).where("so_far = 1")
    gain = F.col("rejections") - price * F.col("false_rejections")
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), "step")
    return certified.withColumn("gain", gain).where("gain > 0").withColumn("rn", F.row_number().over(best)).where("rn = 1").select(
        "stratum", "rule", F.element_at(ladder, F.col("step")).alias("cutoff"), "n", "false_rejections", "rejections"
    )


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: Column | None = None) -> DataFrame:
    """``id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules`` for each row.

    ``base_failed``: fewer than 20 words, or more than 30 % of them in windows of 8 words that occur twice. A row is
    kept unless the base rules or a rule in force in its stratum reject it. Without labels only the base rules act.
    """
    measured = pin(measures(df, id_col, text_col, stratum), "measures")
    rules = cutoffs(measured, labels, id_col).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(share > F.try_element_at("cuts", F.lit(name)), F.lit(name)) for name, share in shares().items()]))
    failed = F.coalesce(F.when(F.col("cuts").isNotNull(), failed), F.array().cast("array<string>"))
    return measured.join(rules, "stratum", "left").select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & (F.size(failed) == 0)).alias("kept"), failed.alias("failed_rules"),
    )
