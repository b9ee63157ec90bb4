"""Routing policies: a text column in, a decision struct out.

A policy is any callable ``policy(text: Column) -> Column`` whose result has the fields
``selected, abstain, reason, score, metadata``. All of them are projections: routing a
table adds no shuffle, and policies compose with whatever plan surrounds them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymeter import fixed
from waymeter.functions.text import bucket, col, draw

Policy = Callable[[Column], Column]
Candidates = Sequence[tuple[str, str]]

PAIR: Candidates = (("small", fixed.SMALL_DESCRIPTION), ("big", fixed.BIG_DESCRIPTION))


def names_of(candidates: Candidates | Sequence[str]) -> list[str]:
    return [c if isinstance(c, str) else c[0] for c in candidates]


def decision(
    selected: Column,
    reason: Column | None = None,
    score: Column | None = None,
    metadata: Mapping[str, Column] | None = None,
) -> Column:
    """Decision struct; a null ``selected`` is an abstain."""
    picked = selected.cast("string")
    pairs = [part for k, v in (metadata or {}).items() for part in (F.lit(k), v.cast("string"))]
    empty = F.create_map().cast("map<string,string>")
    return F.struct(
        picked.alias("selected"),
        picked.isNull().alias("abstain"),
        (F.lit(None).cast("string") if reason is None else reason).alias("reason"),
        (F.lit(None).cast("double") if score is None else score.cast("double")).alias("score"),
        (F.create_map(*pairs) if pairs else empty).alias("metadata"),
    )


def has_text(text: Column) -> Column:
    return F.coalesce(F.length(text) > 0, F.lit(False))


def fixed_model(name: str) -> Policy:
    return lambda text: decision(F.lit(name), F.lit("fixed"))


def rules(patterns: Mapping[str, str]) -> Policy:
    """First candidate whose pattern is found anywhere in the text, ignoring case; else abstain."""

    def policy(text: Column) -> Column:
        hit = F.lit(None).cast("string")
        for name, pattern in reversed(patterns.items()):
            hit = F.when(text.rlike(f"(?i){pattern}"), F.lit(name)).otherwise(hit)
        return decision(hit, F.when(hit.isNotNull(), F.lit("rule hit")))

    return policy


def keyword_length(
    pattern: str = fixed.KEYWORD_PATTERN, threshold: int = fixed.LENGTH_THRESHOLD, big: str = "big"
) -> Policy:
    """``big`` on a keyword hit or on more than ``threshold`` characters; else abstain."""

    def policy(text: Column) -> Column:
        keyword = has_text(text) & text.rlike(f"(?i){pattern}")
        lengthy = has_text(text) & (F.length(text) > threshold)
        reason = F.when(keyword, F.lit(fixed.KEYWORD_REASON)).when(
            lengthy, F.concat(F.lit(fixed.LENGTH_REASON[0]), F.length(text).cast("string"), F.lit(fixed.LENGTH_REASON[1]))
        )
        return decision(
            F.when(keyword | lengthy, F.lit(big)),
            reason,
            metadata={
                "keyword_hit": F.when(keyword | lengthy, keyword),
                "prompt_chars": F.when(keyword | lengthy, F.length(text)),
            },
        )

    return policy


def hash_split(percent: int = 50, candidates: Candidates | Sequence[str] = PAIR) -> Policy:
    """Sticky split on content: buckets below ``percent`` go to the second candidate."""
    first, second = names_of(candidates)[:2]

    def policy(text: Column) -> Column:
        b = bucket(text)
        reason = F.concat(F.lit("bucket "), b.cast("string"), F.lit(f" of {percent}"))
        return decision(F.when(b < percent, F.lit(second)).otherwise(F.lit(first)), reason)

    return policy


def coin(
    p: float = -1.0, seed: int | str = 0, candidates: Candidates | Sequence[str] = PAIR,
    replayable: bool = True,
) -> Policy:
    """Second of two candidates with probability ``p``; uniform when ``p`` is negative or n != 2.

    The default draw is a hash of the text, so a retried task repeats it. ``rand`` is not
    repeatable and belongs behind a durable decision.
    """
    names = names_of(candidates)

    def policy(text: Column) -> Column:
        u = draw(text, seed) if replayable else F.rand(seed if isinstance(seed, int) else None)
        if p >= 0 and len(names) == 2:
            pick = F.when(u < p, F.lit(names[1])).otherwise(F.lit(names[0]))
        else:
            at = (F.floor(u * len(names)) + 1).cast("int")
            pick = F.element_at(F.array(*[F.lit(n) for n in names]), at)
        return decision(pick, F.lit("random draw"))

    return policy


def weighted(
    weights: Mapping[str, float], seed: int | str = 0, candidates: Candidates | Sequence[str] = PAIR,
    replayable: bool = True,
) -> Policy:
    """Draw a candidate by weight. Unknown names are ignored, missing weights are zero."""
    if not weights:
        raise ValueError("weights must not be empty")
    share = [(n, float(weights.get(n, 0.0))) for n in names_of(candidates)]
    total = sum(w for _, w in share)

    def policy(text: Column) -> Column:
        u = draw(text, seed) if replayable else F.rand(seed if isinstance(seed, int) else None)
        left = u * F.lit(total)
        branches: Column | None = None
        for name, w in share:
            left = left - F.lit(w)
            branches = (
                F.when(left <= 0, F.lit(name)) if branches is None else branches.when(left <= 0, F.lit(name))
            )
        return decision(branches, F.lit("weighted draw"))

    return policy


def score_threshold(
    score: Column | str, threshold: float = fixed.CALIBRATED_THRESHOLD, small: str = "small", big: str = "big"
) -> Policy:
    """``big`` when the score reaches the threshold, else ``small``; an empty text abstains."""
    s = col(score)

    def policy(text: Column) -> Column:
        pick = F.when(s >= threshold, F.lit(big)).otherwise(F.lit(small))
        known = has_text(text) & s.isNotNull()
        return decision(
            F.when(known, pick),
            F.when(known, F.lit("score against threshold")),
            F.when(known, s),
            {"threshold": F.when(known, F.lit(float(threshold)))},
        )

    return policy


def judge_verdict(
    reply: Column | str, candidates: Candidates | Sequence[str] = PAIR, judge_model: str = fixed.JUDGE_MODEL,
    error: Column | str | None = None, prompt_tokens: Column | str | None = None,
    completion_tokens: Column | str | None = None,
) -> Policy:
    """Read a judge's reply text: think blocks off, ``choice`` of a JSON reply, name ignoring case."""
    r = col(reply)
    tokens = {
        "judge_prompt_tokens": prompt_tokens, "judge_completion_tokens": completion_tokens,
    }

    def policy(text: Column) -> Column:
        bare = F.regexp_replace(
            F.regexp_replace(r, fixed.THINK_PATTERN, ""), r"\A[\x00-\x20]+|[\x00-\x20]+\z", ""
        )
        verdict = F.coalesce(F.get_json_object(bare, "$.choice"), bare)
        match = F.lit(None).cast("string")
        for name in reversed(names_of(candidates)):
            match = F.when(F.lower(verdict) == name.lower(), F.lit(name)).otherwise(match)
        match = F.when(has_text(text), match)
        asked = has_text(text)
        missed = asked & r.isNotNull() & match.isNull()
        reason = (
            F.when(~asked, F.lit(None))
            .when(r.isNull(), F.lit("judge unavailable"))
            .when(match.isNull(), F.lit(fixed.UNMATCHED_REASON))
            .otherwise(F.lit("judge verdict"))
        )
        told = F.lit(None).cast("string") if error is None else col(error)
        meta = {
            "judge_model": F.when(match.isNotNull(), F.lit(judge_model)),
            "judge_verdict": F.when(match.isNotNull(), verdict),
            "judge_unmatched_verdict": F.when(missed, F.substring(verdict, 1, fixed.VERDICT_CHARS)),
            "judge_error": F.when(asked & r.isNull(), told),
        }
        meta |= {k: F.when(match.isNotNull(), col(v)) for k, v in tokens.items() if v is not None}
        return decision(match, reason, metadata=meta)

    return policy


def decide(df: DataFrame, text: str, policy: Policy, name: str = "decision") -> DataFrame:
    return df.withColumn(name, policy(F.col(text)))


def resolve(
    df: DataFrame, default: str = "small", candidates: Candidates | Sequence[str] = PAIR,
    failed: Column | str | None = None, name: str = "decision",
) -> DataFrame:
    """Add ``selected_model, decision_source, fallback_attempted, final_model``.

    An abstain takes the default; a failed call moves on to the next candidate in list order.
    """
    names = names_of(candidates)
    chosen = F.col(f"{name}.selected")
    out = df.withColumn("selected_model", F.coalesce(chosen, F.lit(default))).withColumn(
        "decision_source", F.when(chosen.isNull(), F.lit("default")).otherwise(F.lit("strategy"))
    )
    broke = F.lit(False) if failed is None else F.coalesce(col(failed), F.lit(False))
    following = F.lit(None).cast("string")
    for i, n in enumerate(names):
        following = F.when(F.col("selected_model") == n, F.lit(names[(i + 1) % len(names)])).otherwise(following)
    return out.withColumn("fallback_attempted", broke).withColumn(
        "final_model", F.when(broke, F.coalesce(following, F.lit(default))).otherwise(F.col("selected_model"))
    )


def backend(
    df: DataFrame, model: Column | str, temperature_override: float | None = None
) -> DataFrame:
    """Provider, bare model name, temperature and stub delay from a prefixed model string."""
    m = col(model)
    provider = F.lit("local")
    for p in ("openai", "anthropic", "proxy", "stub"):
        provider = F.when(F.startswith(m, F.lit(p + ":")), F.lit(p)).otherwise(provider)
    bare = F.when(F.col("provider") == "local", m).otherwise(F.regexp_replace(m, "^[a-z]+:", ""))
    override = F.lit(temperature_override).cast("double")
    temperature = (
        F.when(F.col("provider") == "proxy", F.lit(1.0))
        .when((F.col("provider") == "openai") & F.startswith("backend_model", F.lit("gpt-5")), F.lit(1.0))
        .when(F.col("provider") == "openai", override)
    )
    return (
        df.withColumn("provider", provider)
        .withColumn("backend_model", bare)
        .withColumn("temperature", temperature)
        .withColumn("delay_ms", F.when(F.col("provider") == "stub", F.col("backend_model").try_cast("long")))
    )


def compare(
    df: DataFrame, text: str, arms: Mapping[str, Policy], default: str = "small", keep: Sequence[str] = ()
) -> DataFrame:
    """Every arm's model for every row, from one pass: ``*keep, arm, selected_model``."""
    picks = [
        F.coalesce(p(F.col(text)).getField("selected"), F.lit(default)).alias(arm) for arm, p in arms.items()
    ]
    return df.select(*keep, *picks).unpivot(list(keep), list(arms), "arm", "selected_model")


def agreement(
    df: DataFrame, text: str, a: Policy, b: Policy, default: str = "small"
) -> DataFrame:
    """How often two policies choose the same model: ``n, same, share``."""
    left = F.coalesce(a(F.col(text)).getField("selected"), F.lit(default))
    right = F.coalesce(b(F.col(text)).getField("selected"), F.lit(default))
    both = df.select((left == right).alias("same"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("same")).withColumn(
        "share", F.try_divide(F.col("same"), F.col("n"))
    )
