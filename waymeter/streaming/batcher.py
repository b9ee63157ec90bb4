"""The count-or-time batcher: on keyed state by the clock, and as a step over ordered micro-batches."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from waymeter.functions.text import head
from waymeter.operators.windows import batch_prompt, batch_verdicts, gather, micro_batch_table
from waymeter.session import ROCKSDB, pin, scratch
from waymeter.streaming import ranges

OUTPUT = "lane long, id string, prompt string, seq long, wid long, at int, batch int, wait_ms long, closed_by string"
BUFFER = "id string, prompt string, seq long, arrived long"
LOG = ["prompt_head", "model", "batch", "judge_ms", "wait_ms", "judge_prompt_tokens", "judge_completion_tokens", "parse_failed"]


class Batcher(StatefulProcessor):
    """Buffers a lane's requests; flushes at n rows or ``timeout_ms`` after the window's first.

    State per lane: at most n - 1 buffered rows, the window counter and one timer. Rows of one micro-batch
    are taken in the order of ``seq``, since a shuffle keeps none, and a size flush cancels the timer.
    """

    def __init__(self, n: int, timeout_ms: int) -> None:
        self.n, self.timeout_ms = n, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", BUFFER)
        self.opened = handle.getValueState("opened", "at long, wid long")

    def _windows(self, lane: int, wid: int, rows: pd.DataFrame, now: int, by: str) -> pd.DataFrame:
        """Consecutive windows of ``n`` rows each, the last one maybe shorter, as one frame."""
        place = pd.Series(range(len(rows)))
        window = place // self.n
        return pd.DataFrame({
            "lane": lane, "id": rows["id"].to_numpy(), "prompt": rows["prompt"].to_numpy(), "seq": rows["seq"].to_numpy(), "wid": wid + window,
            "at": place % self.n, "batch": window.map(window.value_counts()), "wait_ms": now - rows["arrived"].to_numpy(), "closed_by": by,
        })

    def _clear_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def _held(self) -> pd.DataFrame:
        rows = list(self.buffer.get()) if self.buffer.exists() else []
        return pd.DataFrame(rows, columns=["id", "prompt", "seq", "arrived"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self._held()
        had_timer = len(held) > 0
        wid = self.opened.get()[1] if self.opened.exists() else 0
        new = pd.concat([pdf[["id", "prompt", "seq"]] for pdf in rows]).sort_values("seq").assign(arrived=now)
        rows = pd.concat([held, new]) if had_timer else new
        full = len(rows) // self.n * self.n
        if full:
            yield self._windows(key[0], wid, rows[:full], now, "size")
            if had_timer:
                self._clear_timers()
        if len(rows) > full and (full or not had_timer):
            self.handle.registerTimer(now + self.timeout_ms)
        self._keep(rows[full:], wid + full // self.n, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, now = self._held(), timerValues.getCurrentProcessingTimeInMs()
        if len(held):
            wid = self.opened.get()[1]
            self._keep(held[:0], wid + 1, now)
            yield self._windows(key[0], wid, held, now, "time")

    def _keep(self, held: pd.DataFrame, wid: int, now: int) -> None:
        if len(held):
            self.buffer.put([(i, p, int(s), int(a)) for i, p, s, a in zip(held["id"], held["prompt"], held["seq"], held["arrived"])])
        elif self.buffer.exists():
            self.buffer.clear()
        self.opened.update((now, wid))

    def close(self) -> None:
        pass


def micro_batch(stream: DataFrame, lane: str, n: int, timeout_ms: int) -> DataFrame:
    """Batch a stream of ``lane, id, prompt, seq``; one output row per request.

    The session needs the RocksDB state store, as :func:`waymeter.session.build_session` sets it. A lane is
    one task at a time, and a micro-batch of a lane is held in it: where lanes may be hot, use :class:`LaneWindows`.
    """
    if stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    return stream.groupBy(lane).transformWithStateInPandas(
        statefulProcessor=Batcher(n, timeout_ms), outputStructType=OUTPUT, outputMode="Append",
        timeMode="ProcessingTime",
    )


ROWS = "lane long, id string, prompt string, seq long, arrived long, wid long, at int, batch int, wait_ms long, closed_by string, open boolean"
COUNTERS = "lane long, wid long"
WHOLE = 1 << 62  # a timeout that never runs out


class LaneWindows:
    """The batcher as a step over micro-batches, in which a lane may be as hot as it likes.

    A micro-batch is sorted by (lane, ``seq``) and cut into chunks, which summarise themselves: from each row that a window
    may open at to the last opening behind it. Lanes are walked over these summaries alone, so the rows of one lane are
    worked on by many tasks. What a lane carries to the next micro-batch is the number of its open window
    and the at most n - 1 rows in it; they are put in front of its next rows.

    A window closes at its n-th row (``size``), when a row or the end of the micro-batch is ``timeout`` units of ``seq`` behind its first
    (``time``), or with the last micro-batch (``end``). Rows come in the order of ``seq`` from one micro-batch to the next, so
    the largest ``seq`` so far is the time of all lanes. Without ``timeout`` there is no closing by time. With ``timer_ms`` the last micro-batch
    does not cut windows off: once the input is read, their timers run, and ``timer_ms`` after the last arrival all have closed (``time``).

    Output and state of a micro-batch stand under its number and replace what a broken attempt left there. Its rows are written once,
    those of open windows apart from the others; besides them, state is a number per lane. Both are read and written once per micro-batch, so
    it should bring a lane several rows. A null lane is a lane of its own; ``seq`` is not null.
    """

    def __init__(self, path: str, store: str, n: int, timeout: int | None = None, chunk_rows: int = 1 << 15, timer_ms: int | None = None) -> None:
        self.path, self.store, self.n, self.timeout, self.chunk_rows, self.timer_ms = path.rstrip("/"), store.rstrip("/"), n, timeout, chunk_rows, timer_ms

    def _before(self, spark: SparkSession, number: int) -> tuple[DataFrame, DataFrame]:
        """The rows of open windows, and each lane's next window."""
        if not number:
            return spark.createDataFrame([], ROWS), spark.createDataFrame([], COUNTERS)
        rows = spark.read.schema(ROWS).parquet(f"{self.path}/part={number - 1}").where("open")
        return rows, spark.read.schema(COUNTERS).parquet(f"{self.store}/batch={number - 1}")

    def __call__(self, rows: DataFrame, number: int, last: bool) -> None:
        """Takes ``lane, id, prompt, seq``; appends the rows of the windows that closed, as ``OUTPUT`` has them."""
        spark, now = rows.sparkSession, int(time.time() * 1000)
        held, counters = self._before(spark, number)
        new = rows.select("lane", "id", "prompt", "seq", F.lit(now).cast("long").alias("arrived"))
        whole = held.select(*new.columns).union(new)
        placed = micro_batch_table(whole, "lane", "seq", "id", self.n, self.timeout or WHOLE, self.chunk_rows, ["prompt", "arrived"])
        placed = pin(placed.withColumnRenamed("ts", "seq"), "placed")
        newest = placed.groupBy("lane").agg(F.max("wid").alias("newest"))
        bases = counters.select("lane", F.lit(None).cast("long").alias("newest"), F.col("wid").alias("base"))
        lanes = newest.withColumn("base", F.lit(0).cast("long")).union(bases).groupBy("lane").agg(F.max("newest").alias("newest"), F.max("base").alias("base"))
        lanes = lanes.where("newest is not null").withColumnRenamed("lane", "_lane")
        window = Window.partitionBy("lane", "wid")  # at most n rows
        sized = placed.withColumns({"batch": F.count(F.lit(1)).over(window).cast("int"), "opened": F.min("seq").over(window)})
        late, closes = F.col("wid") < F.col("newest"), now
        if self.timeout is not None:
            late = late | (F.col("opened") + self.timeout <= placed.agg(F.max("seq")).scalar())
        why = F.when(F.col("batch") >= self.n, "size").when(late, "time")
        if last and self.timer_ms is None:
            why = why.otherwise("end")
        elif last:
            closes = now + self.timer_ms
            time.sleep(max(0.0, closes / 1000 - time.time()))
            why = why.otherwise("time")
        told = sized.join(lanes, sized["lane"].eqNullSafe(lanes["_lane"])).withColumn("closed_by", why)
        until = F.when(late | (F.col("batch") >= self.n), F.lit(now)).otherwise(F.lit(closes))
        told = told.select(
            "lane", "id", "prompt", "seq", "arrived", (F.col("base") + F.col("wid") - 1).alias("wid"), F.col("at").cast("int").alias("at"), "batch",
            (until - F.col("arrived")).alias("wait_ms"), "closed_by", F.col("closed_by").isNull().alias("open"),
        )
        told.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("open").parquet(f"{self.path}/part={number}")
        written = spark.read.schema(ROWS).parquet(f"{self.path}/part={number}")
        following = written.groupBy("lane").agg(F.max(F.col("wid") + F.when(F.col("open"), 0).otherwise(1)).alias("wid"))
        counters.union(following).groupBy("lane").agg(F.max("wid").alias("wid")).write.mode("overwrite").parquet(f"{self.store}/batch={number}")

    def result(self, spark: SparkSession) -> DataFrame:
        closed = spark.read.schema(ROWS).option("basePath", self.path).parquet(f"{self.path}/part=*").where("not open")
        return closed.select("lane", "id", "prompt", "seq", "wid", "at", "batch", "wait_ms", "closed_by")


def run_lanes(rows: DataFrame, n: int, step: int, timeout: int | None = None, checkpoint: str | None = None, timer_ms: int | None = None) -> DataFrame:
    """Windows of a whole table of ``lane, id, prompt, seq``, streamed in the order of ``seq`` with ``step`` rows a micro-batch, in one run."""
    spark = rows.sparkSession
    windows = LaneWindows(scratch(spark, "windows"), scratch(spark, "lanes"), n, timeout, timer_ms=timer_ms)
    folder, size = ranges.number(rows, ["seq", "id"])
    ranges.run(spark, folder, size, step, checkpoint or scratch(spark, "state"), windows)
    return windows.result(spark)


def batch_log(batched: DataFrame, replies: DataFrame, candidates: list[str] = ("small", "big"), default: str = "small") -> DataFrame:
    """The log of a windowed run from the batcher's rows and the judge's reply to each window.

    ``replies`` has one row per window: ``lane, wid, reply, judge_ms, judge_prompt_tokens, judge_completion_tokens``; a
    window without one gets the default. Rows carry the log's fields, ``LOG``, besides ``lane, wid, at, id`` and the window's
    ``judge_prompt``; the judge's figures repeat on each row of a window.
    """
    windows = batch_prompt(gather(batched, "prompt")).join(replies, ["lane", "wid"], "left")
    told = batch_verdicts(windows, "reply", candidates, default).drop("reply")
    waits = batched.select("lane", "wid", F.col("at").alias("at"), "wait_ms")
    return told.join(waits, ["lane", "wid", "at"]).withColumn("prompt_head", head("prompt"))
