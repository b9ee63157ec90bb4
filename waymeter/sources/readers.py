"""Scans. Schemas are declared; no scan infers by a second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymeter import fixed
from waymeter.functions.text import content_key, ts_ms
from waymeter.sources.quoted import read_quoted

REQUEST = "id string, conversation_id string, slice string, prompt string"
ANSWER = "id string, slice string, answer string, entry_point string, test string, he_prompt string"
LEDGER = "ts double, phase string, model string, prompt_sha1 string"
BACKEND_LOG = "prompt_head string, model string"
PRICE = "model string, input double, output double"
RAW_CHOICE = "question string, choices array<string>, answer int"
RAW_NUMBER = "question string, answer string"
RAW_CODE = "prompt string, entry_point string, test string"


def line_position() -> Column:
    """Order of lines over files in name order, from a file scan.

    A file may be split over tasks: the split's start orders the parts, and the row id rises
    within each task.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )


def json_lines(spark: SparkSession, path: str, schema: str, position: bool = False) -> DataFrame:
    """JSON lines (gzip included) with a declared schema; blank lines carry no row."""
    if not position:
        return spark.read.schema(schema).json(path)
    names = T.StructType.fromDDL(schema).fieldNames()
    return spark.read.schema(schema).json(path).select(*names, line_position().alias("pos"))


def read_requests(spark: SparkSession, path: str, position: bool = False) -> DataFrame:
    return json_lines(spark, path, REQUEST, position).withColumn(
        "prompt", F.coalesce("prompt", F.lit(""))
    )


def last_by_key(df: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """The whole last row of each key. Reduced before the shuffle, so a hot key stays cheap."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def first_by_key(df: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Answer key; the last row of an id wins."""
    return last_by_key(json_lines(spark, path, ANSWER, True), ["id"], "pos").drop("pos")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, LEDGER)


def read_backend_log(spark: SparkSession, path: str) -> DataFrame:
    """The last model of each prompt head."""
    return last_by_key(json_lines(spark, path, BACKEND_LOG, True), ["prompt_head"], "pos").drop("pos")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted CSV with header, doubled quotes and fields that run over many lines; large files are read by many tasks."""
    return read_quoted(spark, path, schema)


def read_prices(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Price rows from a JSON-lines or parquet table, or the pinned ones."""
    if path is None:
        rows = ", ".join(f"('{model}', {i}D, {o}D)" for model, i, o in fixed.PRICES)
        return spark.sql(f"select * from values {rows} as t(model, input, output)")
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(PRICE).parquet(path)
    return json_lines(spark, path, PRICE)


def parse_events(lines: DataFrame, line: str = "value", pos: str = "pos") -> DataFrame:
    """Log lines to ``type, raw_ts, event_id, attributes (variant), pos``.

    Blank and malformed lines are dropped. The record may wrap the event or be the event.
    """
    # Exploding a one-element array keeps filters on parsed fields above the parse, which would
    # otherwise be repeated inside every pushed-down condition.
    rec = lines.where(F.length(F.trim(line)) > 0).select(
        F.col(pos).alias("pos"), F.explode(F.array(F.try_parse_json(F.col(line)))).alias("rec")
    )
    ev = F.coalesce(F.try_variant_get("rec", "$.event", "variant"), F.col("rec"))
    rec = rec.where(F.col("rec").isNotNull()).withColumn("ev", ev)

    def text(source: str, path: str) -> Column:
        return F.nullif(F.try_variant_get(source, path, "string"), F.lit(""))

    return rec.select(
        F.coalesce(text("rec", "$.eventType"), text("ev", "$.type"), F.lit("")).alias("type"),
        F.coalesce(text("rec", "$.timestamp"), text("rec", "$.timeMillis")).alias("raw_ts"),
        F.try_variant_get("ev", "$.id", "string").alias("event_id"),
        F.try_variant_get("ev", "$.attributes", "variant").alias("attributes"),
        "pos",
    )


def read_eventlog(spark: SparkSession, path: str) -> DataFrame:
    """All ``*.log`` files under ``path``, in name order."""
    raw = spark.read.option("pathGlobFilter", "*.log").text(path)
    return parse_events(raw.select("value", line_position().alias("pos")))


def after(events: DataFrame, cutoff: str | None, epoch_millis: bool = False) -> DataFrame:
    """Drop events before an ISO instant. No timestamp: kept. An unreadable one: dropped."""
    if cutoff is None:
        return events
    at = ts_ms(F.lit(cutoff), epoch_millis)
    seen = F.coalesce(ts_ms("raw_ts", epoch_millis), F.lit(0.0))
    # A cutoff that cannot be read switches the filter off.
    return events.where(at.isNull() | (at == 0) | F.col("raw_ts").isNull() | (seen >= at))


def prompt_keyed(requests: DataFrame, pos: Column | str | None = None, texts: bool = False) -> DataFrame:
    """Workload items by prompt digest, ``_key, id, slice``; the last of equal prompts wins."""
    order = F.col("id") if pos is None else pos
    fields = ["id", "slice", *(["prompt"] if texts else [])]
    keyed = requests.select(content_key("prompt").alias("_key"), *fields, F.struct(order).alias("_o"))
    last = keyed.groupBy("_key").agg(F.max_by(F.struct(*fields), "_o").alias("_v"))
    return last.select("_key", *[f"_v.{f}" for f in fields])
