"""Event handlers of a routing job as streaming maps around the decision column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymeter.operators.policies import Policy, decide, resolve
from waymeter.sources.writers import output_record


def on_input(requests: DataFrame, policy: Policy, default: str = "small", text: str = "prompt") -> DataFrame:
    """Input event to chat request: the prompt with its resolved model."""
    return resolve(decide(requests, text, policy), default)


def on_response(responses: DataFrame, content: str = "answer") -> DataFrame:
    """Response event to the compact output record."""
    return output_record(responses, "request_id", content)


def model_policy(
    df: DataFrame, setup: Callable[[], Callable[[pd.Series], pd.Series]], text: str = "prompt", name: str = "score"
) -> DataFrame:
    """Score prompts with a Python model: loaded once per task, applied to Arrow batches."""
    schema = df.select("*", F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = setup()
        for pdf in batches:
            yield pdf.assign(**{name: score(pdf[text]).astype("float64")})

    return df.mapInPandas(run, schema)


def metered(df: DataFrame, tokens_in: str, tokens_out: str, ms: str, name: str = "decision") -> DataFrame:
    """Record what a decision cost next to the decision itself."""
    d = F.col(name)
    cost = F.struct(
        F.col(tokens_in).alias("judge_prompt_tokens"), F.col(tokens_out).alias("judge_completion_tokens"),
        F.col(ms).alias("decision_ms"),
    )
    return df.withColumn(name, d.withField("meter", cost))
