"""Reply graders as column expressions: reply text and gold in, boolean out (never null)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymeter import fixed
from waymeter.functions.text import col, last_match, norm_label, tail

NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
LONE_LETTER = r"(?<![\p{L}\p{N}_])([A-D])(?![\p{L}\p{N}_])"


def to_number(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, ",", ""), r"^\s+|\s+$", "")
    return F.when(plain.rlike(NUMERIC), plain.try_cast("double"))


def answered_number(text: Column | str) -> Column:
    t = col(text)
    marked = to_number(last_match(t, fixed.ANSWER_PATTERN))
    return F.coalesce(marked, to_number(last_match(t, f"({fixed.NUMBER_PATTERN})")))


def answered_letter(text: Column | str) -> Column:
    t = col(text)
    marked = F.upper(last_match(t, fixed.ANSWER_PATTERN))
    loose = last_match(tail(t, fixed.REPLY_TAIL_CHARS), LONE_LETTER)
    return F.when(marked.isin("A", "B", "C", "D"), marked).otherwise(loose)


def answered_binary(text: Column | str) -> Column:
    t = col(text)
    marked = F.upper(last_match(t, fixed.TOXIC_PATTERN))
    end = F.regexp_replace(F.upper(tail(t, fixed.REPLY_TAIL_CHARS)), r"\s+\z", "")
    loose = F.when(F.endswith(end, F.lit("TOXIC")), "TOXIC").when(F.endswith(end, F.lit("SAFE")), "SAFE")
    return F.coalesce(marked, loose)


def answered_label(text: Column | str) -> Column:
    found = last_match(col(text), fixed.LABEL_PATTERN)
    return F.when(found.isNotNull(), norm_label(found))


def grade_number(text: Column | str, gold: Column | str) -> Column:
    gap = F.abs(answered_number(text) - to_number(col(gold)))
    return F.coalesce(gap < fixed.NUMBER_TOLERANCE, F.lit(False))


def grade_letter(text: Column | str, gold: Column | str) -> Column:
    return F.coalesce(answered_letter(text) == col(gold), F.lit(False))


def grade_binary(text: Column | str, gold: Column | str) -> Column:
    return F.coalesce(answered_binary(text) == col(gold), F.lit(False))


def grade_label(text: Column | str, gold: Column | str) -> Column:
    return F.coalesce(answered_label(text) == norm_label(gold), F.lit(False))


def code_block(text: Column | str) -> Column:
    """First fenced block, else the whole text."""
    t = F.coalesce(col(text), F.lit(""))
    return F.when(t.rlike(fixed.CODE_PATTERN), F.regexp_extract(t, fixed.CODE_PATTERN, 1)).otherwise(t)


def grade(
    kind: Column | str, text: Column | str, gold: Column | str, code_verdict: Column | str | None = None
) -> Column:
    """Choose the grader by slice. Slices without a text grader use the joined code verdict."""
    verdict = F.lit(None).cast("boolean") if code_verdict is None else col(code_verdict)
    k = col(kind)
    return (
        F.when(k == "gsm8k", grade_number(text, gold))
        .when(k == "mmlu", grade_letter(text, gold))
        .when(k == "toxicchat", grade_binary(text, gold))
        .when(k == "banking77", grade_label(text, gold))
        .otherwise(F.coalesce(verdict, F.lit(False)))
    )
