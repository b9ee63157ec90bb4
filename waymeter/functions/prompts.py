"""Workload and judge prompt texts, assembled in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymeter import fixed
from waymeter.functions.text import col

EDGES = r"^\s+|\s+$"


def strip(text: Column | str) -> Column:
    return F.regexp_replace(col(text), EDGES, "")


def number_prompt(question: Column | str) -> Column:
    return F.concat(strip(question), F.lit("\n\n" + fixed.NUMBER_TASK))


def choice_prompt(question: Column | str, choices: Column | str) -> Column:
    """Question, lettered choices, task line."""
    letters = F.lit("ABCD")
    lines = F.transform(
        col(choices), lambda c, i: F.concat(F.substr(letters, i + 1, F.lit(1)), F.lit(". "), c)
    )
    return F.concat(
        strip(question), F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\n\n" + fixed.LETTER_TASK)
    )


def code_prompt(stub: Column | str) -> Column:
    return F.concat(F.lit(fixed.CODE_TASK), col(stub))


def moderation_prompt(message: Column | str) -> Column:
    body = F.substring(strip(message), 1, fixed.MODERATION_CHARS)
    return F.concat(F.lit(fixed.MODERATION_HEAD), body, F.lit(fixed.MODERATION_TAIL))


def with_message(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose message is neither null nor blank; the others get no prompt."""
    return rows.where(F.length(strip(text)) > 0)


def moderation_prompts(rows: DataFrame, text: str, name: str = "prompt") -> DataFrame:
    """Rows with a message, each with its moderation prompt."""
    return with_message(rows, text).withColumn(name, moderation_prompt(text))


def intent_list(rows: DataFrame, label: str) -> DataFrame:
    """One row: the sorted distinct label names as ``- name`` lines."""
    names = rows.select(label).where(F.col(label).isNotNull()).distinct()
    names = names.agg(F.array_sort(F.collect_list(label)).alias("n"))
    lines = F.transform("n", lambda n: F.concat(F.lit("- "), n))
    return names.select(F.array_join(lines, "\n").alias("intents"))


def intent_prompts(rows: DataFrame, text: str, label: str, name: str = "prompt") -> DataFrame:
    """The message first, so that a truncated prefix stays unique, then the label list of all rows. Rows without a message are left out."""
    listing = intent_list(rows, label).scalar()
    return with_message(rows, text).withColumn(
        name,
        F.concat(
            F.lit(fixed.INTENT_HEAD), strip(text), F.lit(fixed.INTENT_LIST), listing, F.lit(fixed.INTENT_TAIL)
        ),
    )


def judge_prompt(request: Column | str, candidates: list[tuple[str, str]]) -> Column:
    """Instruction, one line per candidate, then the delimited request; null for an empty request."""
    lines = "".join(f"- {name}: {text}\n" if text else f"- {name}\n" for name, text in candidates)
    r = col(request)
    whole = F.concat(
        F.lit(fixed.JUDGE_HEAD + lines + fixed.JUDGE_REQUEST_OPEN), r, F.lit(fixed.JUDGE_REQUEST_CLOSE)
    )
    return F.when(F.length(r) > 0, whole)


def window_prompt(requests: Column | str) -> Column:
    """Numbered prompt for one window's ordered array of requests."""
    blocks = F.transform(
        col(requests),
        lambda r, i: F.concat(
            F.lit(fixed.WINDOW_REQUEST_OPEN),
            (i + 1).cast("string"),
            F.lit(fixed.WINDOW_REQUEST_CLOSE),
            F.substring(r, 1, fixed.WINDOW_REQUEST_CHARS),
            F.lit("\n"),
        ),
    )
    return F.concat(
        F.lit(fixed.WINDOW_HEAD), F.size(col(requests)).cast("string"), F.lit(fixed.WINDOW_TAIL),
        F.array_join(blocks, ""),
    )
