"""Count-or-time windows over finished tables, and what a judge's reply does to them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymeter.functions.prompts import window_prompt
from waymeter.functions.text import col, draw
from waymeter.operators.layout import lay_out, number_rows

CHUNK_ROWS = 1 << 16  # rows that a task's Python holds at a time


def lanes(df: DataFrame, text: str, k: int, name: str = "lane") -> DataFrame:
    """Spread rows over k lanes by content; equal texts share a lane.

    Where one text may dominate, pass a unique column instead: lanes only need an even spread.
    """
    return df.withColumn(name, F.floor(draw(text, "lane") * k).cast("long"))


def count_window(df: DataFrame, lane: str, order: list[str], n: int, name: str = "wid") -> DataFrame:
    """Windows of n consecutive rows per lane, numbered from 0, with each row's place ``at``."""
    placed = number_rows(df, [lane], order, "_at")
    place = F.col("_at") - 1
    return placed.withColumn(name, F.floor(place / n).cast("long")).withColumn("at", place % n).drop("_at")


def _read(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A chunk in order, its instants, and for each row the end of its lane's rows in it."""
    table = table.sort_by("_idx")
    codes = table["lane"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    ends = np.append(np.flatnonzero(np.diff(codes)) + 1, len(codes))
    ts = pc.fill_null(table["ts"], np.iinfo("int64").min).to_numpy()
    return table, ts, np.repeat(ends, np.diff(ends, prepend=0))


def _chain(ts: np.ndarray, end: np.ndarray, n: int, timeout: int) -> np.ndarray:
    """For a window opening at each row, the row that opens the next one; at most the end of the lane's rows."""
    deadline, low = ts + timeout, np.arange(len(ts)) + 1
    high = np.minimum(low - 1 + n, end)
    while (low < high).any():  # all rows at once: a window has n rows at most, so that few steps find its deadline
        middle = (low + high) // 2
        early = (low < high) & (ts[np.minimum(middle, len(ts) - 1)] < deadline)
        low, high = np.where(early, middle + 1, low), np.where(early, high, np.minimum(middle, high))
    return low


def _summarise(n: int, timeout: int):
    """One row each for the first and the last lane of a chunk: for each row a window may open at first, the last opening it leads to.

    Lanes between these two begin and end in the chunk, and the last one begins in it: nothing before it matters to it.
    """

    def run(table: pa.Table) -> pa.Table:
        table, ts, end = _read(table)
        size = len(ts)
        nxt, here = _chain(ts, end, n, timeout), np.arange(size)
        jump = np.where(nxt < end, nxt, here)
        opened = (nxt < end).astype("int64")
        while True:  # pointer doubling: every row's last opening in log steps
            further = jump[jump]
            if np.array_equal(further, jump):
                break
            opened = opened + opened[jump]
            jump = further
        last_begin = int(np.searchsorted(end, size, side="left"))
        parts = [(0, int(end[0]), min(n, int(end[0])))] + ([(last_begin, size, 1)] if last_begin else [])
        found = []
        for begin, upto, entries in parts:
            last = jump[begin:begin + entries]
            found.append({
                "size": upto - begin, "first": begin == 0, "head": ts[begin:begin + entries].tolist(), "tail": (upto - last).tolist(),
                "tail_ts": ts[last].tolist(), "opened": (opened[begin:begin + entries] + 1).tolist(),
            })
        keys = table.select(["lane", "_slab", "_chunk"]).take([begin for begin, _, _ in parts])
        facts = pa.Table.from_pylist(found, pa.schema(
            [("size", pa.int64()), ("first", pa.bool_())] + [(c, pa.list_(pa.int64())) for c in ("head", "tail", "tail_ts", "opened")]
        ))
        for name in facts.column_names:
            keys = keys.append_column(name, facts[name])
        return keys

    return run


def _compose(n: int, timeout: int):
    """Walk one lane's chunk summaries in order and fix where the first window opens in each chunk that the lane comes first in."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, held, since, windows = [], n, 0, 0  # held = n: the previous window is full
        for c in pdf.sort_values(["_slab", "_chunk"]).itertuples(index=False, name=None):
            slab, chunk, size, first, head, tail, tail_ts, opened = c
            space = n - held
            timed_out = np.searchsorted(np.asarray(head[:space], "int64"), since + timeout, side="left")
            entry = min(space, int(timed_out), size)
            if first:
                rows.append((slab, chunk, entry, held, windows))
            if entry >= size:
                held += size
            else:
                held, since = int(tail[entry]), int(tail_ts[entry])
                windows += int(opened[entry])
        return pd.DataFrame(rows, columns=["_slab", "_chunk", "entry", "held", "base"])

    return run


def _assign(n: int, timeout: int, keep: list[str]):
    """Window number and position of each row of a chunk, given where the first window of its first lane opens."""

    def run(table: pa.Table) -> pa.Table:
        table, ts, end = _read(table)
        entry, held, base = (table[c][0].as_py() for c in ("entry", "held", "base"))
        nxt = _chain(ts, end, n, timeout).tolist()
        starts = np.zeros(len(ts), dtype="int64")
        at = entry
        while at < len(nxt):  # a lane's end is the next one's first opening
            starts[at] = 1
            at = nxt[at]
        rows, count = np.arange(len(ts)), np.cumsum(starts)
        opening = np.maximum.accumulate(np.where(starts == 1, rows, -1))
        begin = np.append(0, end[:-1])  # of a lane's first row: where it begins
        begin = np.maximum.accumulate(np.where(begin == rows, rows, 0))
        wid = np.where(begin == 0, base + count, count - count[begin] + 1)
        return pa.table({
            "lane": table["lane"], "id": table["id"], "ts": ts, "wid": wid,
            "at": np.where(opening < 0, held + rows, rows - opening), **{c: table[c] for c in keep},
        })

    return run


def micro_batch_table(
    df: DataFrame, lane: str, ts: str, unique: str, n: int, timeout: int, chunk_rows: int = CHUNK_ROWS, keep: list[str] = ()
) -> DataFrame:
    """Windows that close at their n-th row or ``timeout`` after their first row's arrival.

    Returns ``lane, id, ts, wid (from 1), at (position in the window)`` and the columns of ``keep``; ``ts`` and ``timeout``
    are whole numbers of one unit. A row arriving exactly at the deadline opens the next window.

    Each boundary depends on the one before, yet a lane is not walked by one task: the sorted rows are cut
    into chunks, and since a window spans at most n rows, a chunk can only be entered
    at one of its first n rows. Every chunk summarises all those entries by itself; the walk over
    a lane then reads n entries per chunk and not the rows. Chunks go by rows, not by lanes: a hot lane is in many,
    and many small ones are in one, so that Python runs once a chunk and holds no more than that.
    """
    narrow = df.select(F.col(lane).alias("lane"), F.col(unique).alias("id"), F.col(ts).cast("long").alias("ts"), *keep)
    laid = lay_out(narrow, "lane", "ts", "id").withColumn("_chunk", F.floor(F.col("_idx") / chunk_rows))
    of_lane, chunk = T.StructField("lane", df.schema[lane].dataType), ["_slab", "_chunk"]
    summary = T.StructType([of_lane]).add("_slab", "long").add("_chunk", "long").add("size", "long").add("first", "boolean")
    for name in ("head", "tail", "tail_ts", "opened"):
        summary = summary.add(name, T.ArrayType(T.LongType()))
    entries = "_slab long, _chunk long, entry long, held long, base long"
    assigned = T.StructType([of_lane, T.StructField("id", df.schema[unique].dataType)])
    assigned = assigned.add("ts", "long").add("wid", "long").add("at", "long")
    for name in keep:
        assigned = assigned.add(df.schema[name])
    summaries = laid.select("lane", *chunk, "_idx", "ts").groupBy(*chunk).applyInArrow(_summarise(n, timeout), summary)
    opened = summaries.groupBy("lane").applyInPandas(lambda pdf: _compose(n, timeout)(pdf.drop(columns="lane")), entries)
    return laid.join(opened, chunk).groupBy(*chunk).applyInArrow(_assign(n, timeout, list(keep)), assigned)


def window_facts(batched: DataFrame, n: int, timeout: int) -> DataFrame:
    """Add each row's window size, opening, closing instant and wait (same unit as ``ts``).

    A full window closes at its last row, any other at its deadline. Windows hold at most n rows.
    """
    w = Window.partitionBy("lane", "wid")
    out = batched.withColumns({"batch": F.count(F.lit(1)).over(w), "opened": F.min("ts").over(w), "_last": F.max("ts").over(w)})
    closed = F.when(F.col("batch") >= n, F.col("_last")).otherwise(F.col("opened") + F.lit(timeout))
    return out.withColumn("closed", closed).withColumn("wait", F.col("closed") - F.col("ts")).drop("_last")


def gather(rows: DataFrame, prompt: str, keys: list[str] = ("lane", "wid"), order: str = "at") -> DataFrame:
    """One row per window with its requests in order: ``requests array<struct(at, id, prompt)>``."""
    one = F.struct(F.col(order).alias("at"), F.col("id").alias("id"), F.col(prompt).alias("prompt"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("requests"))


def batch_prompt(windows: DataFrame, name: str = "judge_prompt") -> DataFrame:
    texts = F.transform("requests", lambda r: F.coalesce(r["prompt"], F.lit("")))
    return windows.withColumn(name, window_prompt(texts))


def batch_verdicts(
    windows: DataFrame, reply: Column | str, candidates: list[str] = ("small", "big"), default: str = "small"
) -> DataFrame:
    """One row per request with ``model`` and ``parse_failed``, by position in the reply's choices.

    Names are matched case-sensitively. A missing or unknown verdict is the default; a reply that
    is not JSON gives the default to the whole window and says so.
    """
    text = F.coalesce(col(reply), F.lit(""))
    parsed = F.try_parse_json(text)
    failed = (F.length(F.trim(text)) > 0) & parsed.isNull()
    choices = F.try_variant_get(parsed, "$.choices", "array<string>")
    rest = [c for c in windows.columns if c != "requests"]
    out = windows.withColumn("_choices", choices).withColumn("parse_failed", failed)
    out = out.withColumn("batch", F.size("requests"))
    out = out.select(*rest, "_choices", "parse_failed", "batch", F.posexplode("requests").alias("_i", "_r"))
    said = F.get("_choices", F.col("_i"))
    return out.select(
        *rest, F.col("_r.at").alias("at"), F.col("_r.id").alias("id"), F.col("_r.prompt").alias("prompt"),
        F.when(said.isin(list(candidates)), said).otherwise(F.lit(default)).alias("model"),
        "parse_failed", "batch",
    )


def amortise(rows: DataFrame) -> DataFrame:
    """Each request's share of its window's judge call."""
    tokens = F.col("judge_prompt_tokens") + F.col("judge_completion_tokens")
    return rows.withColumn("judge_ms_share", F.col("judge_ms") / F.col("batch")).withColumn(
        "judge_tokens_share", tokens / F.col("batch")
    )
