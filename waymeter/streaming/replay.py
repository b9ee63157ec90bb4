"""Tables replayed as streams, fan-out, pairing and draining."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from waymeter.operators.layout import number_rows
from waymeter.session import exists, pin, scratch


def replay(df: DataFrame, order: list[str], rate: int, partitions: int = 1) -> DataFrame:
    """A table as a stream of ``rate`` rows a second in ``order``, plus ``emitted_at``.

    The clock is the rate source; each tick is joined to the row at that position. The positions
    are written once, so a restart from a checkpoint resumes at the same row.
    """
    placed = pin(number_rows(df, [], order, "_seq").withColumn("_seq", F.col("_seq") - 1), "replay")
    ticks = (
        df.sparkSession.readStream.format("rate")
        .option("rowsPerSecond", rate)
        .option("numPartitions", partitions)
        .load()
        .select(F.col("timestamp").alias("emitted_at"), F.col("value").alias("_seq"))
    )
    return ticks.join(placed, "_seq").drop("_seq")


def file_stream(
    spark: SparkSession, folder: str, schema: str | StructType, files_per_trigger: int | None = None, form: str = "parquet"
) -> DataFrame:
    """Files of a folder as a stream; without a limit a micro-batch takes all files there are."""
    reader = spark.readStream.schema(schema).format(form)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_files(df: DataFrame, order: list[Column | str], files: int | None = None) -> str:
    """A table as range-ordered files for :func:`file_stream`: ``files`` ranges, or one per shuffle partition."""
    path = scratch(df.sparkSession, "stream")
    df.repartitionByRange(files or width(df.sparkSession), *order).sortWithinPartitions(*order).write.parquet(path)
    return path


def fanout(stream: DataFrame, n: int, key: str | None = None) -> DataFrame:
    """Spread a stream over n tasks, whatever the source's parallelism.

    Without a key rows are dealt out evenly. A key keeps equal contents together, which only
    keyed state needs, and a dominant content then makes its task the slowest.
    """
    return stream.repartition(n) if key is None else stream.repartition(n, F.xxhash64(key))


def pair_streams(requests: DataFrame, responses: DataFrame, within: str = "1 hour") -> DataFrame:
    """Join the two event streams by request id; ``t_request``/``t_response`` are timestamps.

    Watermarks bound the state: a response is matched while it is at most ``within`` late. Where events
    repeat, ``p_request``/``p_response`` give their places in the log and travel along for :func:`last_pairs`.
    """
    a = requests.withWatermark("t_request", within).alias("a")
    b = responses.withWatermark("t_response", within).alias("b")
    on = F.expr(
        "a.request_id = b.request_id and b.t_response >= a.t_request "
        f"and b.t_response <= a.t_request + interval {within}"
    )
    ms = (F.unix_micros("b.t_response") - F.unix_micros("a.t_request")) / 1000.0
    places = [F.col(f"{side}.{c}") for side, frame, c in (("a", a, "p_request"), ("b", b, "p_response")) if c in frame.columns]
    return a.join(b, on).select(F.col("a.request_id").alias("request_id"), ms.alias("e2e_ms"), *places)


def last_pairs(pairs: DataFrame) -> DataFrame:
    """One row per request from what :func:`pair_streams` wrote: its last request with its last response."""
    return pairs.groupBy("request_id").agg(F.max_by("e2e_ms", F.struct("p_request", "p_response")).alias("e2e_ms"))


def start_table(
    stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, partition_by: list[str] = (),
    state_partitions: int | None = None, no_data: bool = True,
) -> StreamingQuery:
    """Append a stream to a parquet table (each micro-batch lands exactly once).

    ``state_partitions`` caps the state store's partitions for this query: keys fewer than
    partitions, such as lanes, would only leave empty stores to commit. Without ``no_data`` no micro-batch runs
    for timers alone, so that a query with timers ends when its input does.
    """
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="0 seconds")
    conf, name, timers = stream.sparkSession.conf, "spark.sql.shuffle.partitions", "spark.sql.streaming.noDataMicroBatches.enabled"
    usual, usual_timers = conf.get(name), conf.get(timers)
    if not no_data:
        conf.set(timers, "false")
    if state_partitions is not None:
        conf.set(name, str(min(int(usual), state_partitions)))
    try:  # the query takes its own copy of the settings when it starts
        return writer.outputMode("append").start()
    finally:
        conf.set(name, usual)
        conf.set(timers, usual_timers)


def run_to_end(stream: DataFrame, timeout: float | None = None) -> DataFrame:
    """Run a bounded stream to its end and return what it wrote. There is no time limit unless one is given."""
    spark = stream.sparkSession
    path = scratch(spark, "sink")
    query = start_table(stream, path, scratch(spark, "state"))
    try:
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            raise TimeoutError("the stream did not end in time")
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(path)


def drain(query: StreamingQuery, path: str, rows: int, idle: float = 600.0) -> DataFrame:
    """Wait until ``rows`` rows are in the table the query writes, stop it and return the table.

    A query with timers or a clock for its source never ends by itself. However long it takes, it goes on
    while it makes progress; it is given up after ``idle`` seconds in which no micro-batch has ended.
    Counting Parquet rows reads footers only, and it is done once per finished micro-batch that had rows.
    """
    spark, last, seen = SparkSession.active(), time.monotonic(), -1
    try:
        while time.monotonic() < last + idle:
            if query.exception() is not None:
                raise query.exception()
            now = query.lastProgress
            if now is not None and now["batchId"] != seen:
                seen, last = now["batchId"], time.monotonic()
                if exists(spark, f"{path}/_spark_metadata") and spark.read.parquet(path).count() >= rows:
                    return spark.read.parquet(path)
            time.sleep(0.2)
        raise TimeoutError("the stream made no progress")
    finally:
        query.stop()
