"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymeter import fixed
from waymeter.functions.text import col


def write_results(rows: DataFrame, path: str, run: str = "run_id") -> None:
    """Results in the fixed column order, one folder per run; extra columns are dropped.

    An empty result is an error. The check reads the written table's footers only.
    """
    graded = ["graded_correct"] if "graded_correct" in rows.columns else []
    table = rows.select(run, *fixed.RESULT_COLUMNS, *graded)
    # Rebalancing gives few files per run and still splits a run that holds most rows.
    table.hint("rebalance", run).write.partitionBy(run).parquet(path)
    if rows.sparkSession.read.schema(table.schema).parquet(path).isEmpty():
        raise ValueError(f"no requests parsed into {path}")


def output_record(
    df: DataFrame, request_id: str, content: Column | str, routing: Column | str | None = None,
    chars: int = fixed.OUTPUT_HEAD_CHARS,
) -> DataFrame:
    """Compact record per response: id, routing when there is one, first characters."""
    head = F.substring(F.coalesce(col(content), F.lit("")), 1, chars).alias("answer_head")
    fields = [F.col(request_id).alias("request_id")]
    if routing is not None:
        fields.append(col(routing).alias("model_routing"))
    return df.select(*fields, head)


def run_index(rows: DataFrame, run: str = "run_id", pos: Column | str = "pos") -> DataFrame:
    """One manifest per run; runs without rows have none.

    ``models_seen`` holds the distinct models of a run, so its size is the candidate set's.
    """
    name = F.nullif(F.col("model_name"), F.lit(""))
    return rows.groupBy(run).agg(
        F.min_by("arm", pos).alias("arm"),
        F.count(F.lit(1)).alias("requests"),
        F.array_sort(F.collect_set(name)).alias("models_seen"),
        F.count("graded_correct").alias("graded"),
    )


#: The columns of the index file, in order.
INDEX = "run_id string, arm string, requests long, graded long, models_seen string"


def write_index(index: DataFrame, path: str, run: str = "run_id") -> None:
    """The index as CSV with a header: one row per run, so few files."""
    index_lines(index, run).write.option("header", True).option("escape", '"').csv(path)


def write_workload(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Requests or answer keys as JSON lines with the given fields in order; null fields are left out of a line."""
    rows.select(*columns).write.json(path)


def index_lines(index: DataFrame, run: str = "run_id") -> DataFrame:
    """The index as flat text columns, models joined by semicolons."""
    return index.select(run, "arm", "requests", "graded", F.array_join("models_seen", ";").alias("models_seen"))
