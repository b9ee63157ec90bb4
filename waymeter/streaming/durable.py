"""Decisions that are made once per content and replayed unchanged afterwards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from waymeter.functions.text import content_key
from waymeter.session import exists
from waymeter.streaming.replay import file_stream, start_table

STORED = "content string, model string, decision_ms double"
PROPOSAL = "content string, id string, model string, decision_ms double"
HELD = 50_000  # contents that a task holds while it reduces
SLOT_ROWS, SLOT_DIGITS = 50_000, 2  # contents of a folder of the decision table, and digits that name one at most


class FirstDecision(StatefulProcessor):
    """Stores the first decision seen for a content key, and passes it on once; later proposals are dropped."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("decision", "model string, decision_ms double", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            return
        first = pd.concat([pdf.sort_values("id").head(1) for pdf in rows]).sort_values("id").iloc[0]
        model, ms = first["model"], float(first["decision_ms"])
        self.state.update((model, ms))
        yield pd.DataFrame({"content": [key[0]], "model": [model], "decision_ms": [ms]})

    def close(self) -> None:
        pass


def _firsts(table: pa.Table) -> pa.Table:
    """Of each content the proposal with the smallest id."""
    rest = [c for c in table.column_names if c != "content"]
    found = table.sort_by("id").group_by("content", use_threads=False).aggregate([(c, "first") for c in rest])
    return found.rename_columns([c.removesuffix("_first") for c in found.column_names]).select(table.column_names)


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's proposals, reduced over its batches; what is held is passed on when it has too many contents."""
    held = None
    for batch in batches:
        firsts = _firsts(pa.Table.from_batches([batch]))
        held = firsts if held is None else _firsts(pa.concat_tables([held, firsts]))
        if len(held) > HELD:
            yield from held.to_batches()
            held = None
    if held is not None:
        yield from held.to_batches()


def first_proposals(rows: DataFrame) -> DataFrame:
    """The first level: ``content, id, model, decision_ms`` reduced in the map tasks, without a shuffle.

    A content that fills a third of the rows leaves each task once, or once for every ``HELD`` other contents.
    """
    return rows.select("content", "id", "model", F.col("decision_ms").cast("double").alias("decision_ms")).mapInArrow(_reduce, PROPOSAL)


def durable(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The second level: a stream of ``content, id, model, decision_ms`` (the proposed decision) to the decisions made, one row per content.

    A proposal may come from a random policy; it only counts the first time. Of those that arrive in one micro-batch the one
    with the smallest id counts. Without a TTL, state grows with distinct contents; with one, a content may be decided
    again. The session needs the RocksDB state store. The number of state partitions is fixed by the
    checkpoint: choose spark.sql.shuffle.partitions before the first start.
    """
    return first_proposals(stream).groupBy("content").transformWithStateInPandas(
        statefulProcessor=FirstDecision(ttl_ms), outputStructType=STORED, outputMode="Append",
        timeMode="None" if ttl_ms is None else "ProcessingTime",
    )


def keyed_answers(spark: SparkSession, folder: str, schema: str, path: str, checkpoint: str, files_per_trigger: int | None = None) -> DataFrame:
    """Decides what is new in a folder and answers all its rows: ``content, id, model, decision_ms``.

    Only reduced proposals go through keyed state. The decisions in ``path`` are joined back to the rows by an ordinary join with one
    row per content on one side, where adaptive execution splits a hot content of the other. A null content is one of its own.
    """
    start_table(durable(file_stream(spark, folder, schema, files_per_trigger)), path, checkpoint).awaitTermination()
    made = spark.read.schema(STORED).parquet(path).withColumnRenamed("content", "_content")
    rows = spark.read.schema(schema).parquet(folder).drop("model", "decision_ms")
    return rows.join(made, rows["content"].eqNullSafe(made["_content"])).drop("_content")


def durable_table(
    requests: DataFrame, store: str, batch: str, decide: Callable[[DataFrame], DataFrame], text: str = "prompt"
) -> DataFrame:
    """The table form: decide only what the store lacks, append, answer from the store. A null text is an empty one.

    ``decide`` adds ``model, decision_ms`` to distinct contents. The new decisions are written to
    their own ``batch=`` folder before they are used, so a lost executor re-reads them instead of
    deciding again, and a repeated batch finds its folder and adds nothing. There is no limit on
    changing the parallelism between runs.

    A batch's folder is cut by the first digits of the content's digest, none for a small batch and at most two, so that files
    are neither tiny nor many. A later batch reads only the parts of each depth that its own contents lie in; at most
    256 beginnings of digests reach the driver.
    """
    spark = requests.sparkSession
    kept = spark.read.schema(STORED + ", batch string, slot string")
    keyed = requests.withColumn("content", content_key(F.coalesce(text, F.lit(""))))
    beginning = F.substring("content", 1, SLOT_DIGITS)
    n, met = keyed.agg(F.approx_count_distinct("content"), F.collect_set(beginning)).first()
    digits = next((d for d in range(SLOT_DIGITS) if SLOT_ROWS * 16**d >= n), SLOT_DIGITS)
    slot = F.concat(F.lit("s"), F.substring("content", 1, digits))
    slots = sorted({"s" + m[:d] for m in met for d in range(SLOT_DIGITS + 1)})
    mine = f"{store.rstrip('/')}/batch={batch}"
    if not exists(spark, mine + "/_SUCCESS"):
        fresh = keyed.groupBy("content").agg(F.min(text).alias(text))
        if exists(spark, store):  # a half-written folder of this same batch does not count
            known = kept.parquet(store).where(F.col("slot").isin(slots) & (F.col("batch") != batch))
            fresh = fresh.join(known.select("content"), "content", "left_anti")
        new = decide(fresh).select("content", "model", "decision_ms", slot.alias("slot"))
        new.hint("rebalance", "slot").write.mode("overwrite").partitionBy("slot").parquet(mine)
    answers = kept.parquet(store).where(F.col("slot").isin(slots)).drop("slot")
    return keyed.join(answers, "content").withColumn("replayed", F.col("batch") != F.lit(batch)).drop("content")



def durable_batches(
    stream: DataFrame, store: str, path: str, checkpoint: str, decide: Callable[[DataFrame], DataFrame],
    text: str = "prompt",
) -> StreamingQuery:
    """The table form on a stream: each micro-batch is answered by :func:`durable_table`.

    Contents are reduced to one row before they are decided, and the answers are joined back, so
    a prompt that fills a third of the stream is split like any skewed join. Both writes are keyed
    by the micro-batch id: one that is repeated after a failure replaces its own output.
    """

    def answer(batch: DataFrame, number: int) -> None:
        out = durable_table(batch, store, f"s{number}", decide, text)
        out.drop("batch").write.mode("overwrite").parquet(f"{path.rstrip('/')}/part={number}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(answer).start()
