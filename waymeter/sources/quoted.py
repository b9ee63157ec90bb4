"""Quoted CSV whose fields run over many lines, read in as many tasks as the files have splits.

A line break ends a record only outside quotes, and whether a split begins inside them depends on all that
stands before it. But a quote only switches between inside and outside, so a split needs no more than one bit: whether it has an odd
number of quotes. These bits are counted in one scan, summed along each file over one row per split, and give
every split its true beginning. A second scan cuts each split into records on its own. What a border cuts
apart, at most one record a border, is put together again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymeter.session import pin

WHOLE, REST, OPEN = 0, 1, 2  # a record; the end of one that began before the split; one that goes on behind it
PIECES = "file long, block long, at long, kind int, text string"
BROADCAST = 4_000_000  # splits that begin inside quotes, of 16 bytes each: those of about a petabyte


class Cutter:
    """Lines of one split after another to pieces of records."""

    def __init__(self) -> None:
        self.split, self.held, self.inside, self.kind, self.at = None, [], False, WHOLE, 0

    def end(self) -> Iterator[tuple]:
        """What the split so far leaves open."""
        if self.held:
            yield *self.split, self.at, OPEN if self.kind == WHOLE else self.kind, "\n".join(self.held)
        self.held = []

    def begin(self, split: tuple[int, int], inside: bool) -> None:
        self.split, self.inside, self.kind, self.at = split, inside, REST if inside else WHOLE, 0

    def lines(self, lines: pa.Array) -> tuple[list[int], pa.Array, list[int]]:
        """``at``, text and kind of the records that these lines end; the rest is held."""
        odd = np.cumsum(pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)) + self.inside
        ends = np.flatnonzero(odd % 2 == 0) + 1
        self.inside = bool(odd[-1] % 2)
        if not len(ends):
            self.held += lines.to_pylist()
            return [], lines[:0], []
        first = "\n".join([*self.held, *lines[: int(ends[0])].to_pylist()])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines)
        texts = pa.concat_arrays([pa.array([first], lines.type), pc.binary_join(lists, "\n")])
        kinds, places = [WHOLE] * len(texts), list(range(self.at, self.at + len(texts)))
        kinds[0], self.kind = self.kind, WHOLE
        self.at += len(texts)
        self.held = lines[int(ends[-1]) :].to_pylist()
        return places, texts, kinds


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, block, inside, value`` in the order of the lines."""
    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("at", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])
    cutter = Cutter()

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t.type) for i, t in enumerate(schema)], schema=schema)

    for batch in batches:
        files, blocks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        edges = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(files)]):
            split = (int(files[a]), int(blocks[a]))
            if split != cutter.split:
                yield rows(list(cutter.end()))
                cutter.begin(split, bool(batch.column(2)[a].as_py()))
            at, texts, kinds = cutter.lines(batch.column(3).slice(a, b - a))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(at), split[0]), pa.int64()), pa.array(np.full(len(at), split[1]), pa.int64()), pa.array(at, pa.int64()), pa.array(kinds, pa.int32()), texts,
            ], schema=schema)
    yield rows(list(cutter.end()))


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, line, value``: lines end at ``\\n`` alone, and ``line`` rises within a split."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")


def starts_inside(lines: DataFrame) -> DataFrame:
    """``file, block`` of the splits that begin inside quotes. One row per split is shuffled, from each task that has read it."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return odd.withColumn("inside", F.sum("odd").over(before) % 2 == 1).where("inside").select("file", "block", "inside")


def records(spark: SparkSession, path: str) -> DataFrame:
    """``text, head``: every record as it stands, without its line end, and whether it is the first of its file. Empty lines are none."""
    lines, inside = split_lines(spark, path), pin(starts_inside(split_lines(spark, path)), "splits")
    few = inside.count() <= BROADCAST
    told = lines.join(F.broadcast(inside) if few else inside, ["file", "block"], "left")
    if not few:
        told = told.sortWithinPartitions("file", "block", "line")
    pieces = told.select("file", "block", "inside", "value").mapInArrow(_cut, PIECES)
    begun = F.sum((F.col("kind") == OPEN).cast("int")).over(Window.partitionBy("file").orderBy("block", "kind"))  # at most two rows a split
    first = (F.col("block") == 0) & (F.col("at") == 0)
    part = F.struct("block", "kind", "text")
    joined = (
        pieces.where(F.col("kind") != WHOLE).withColumn("number", begun).groupBy("file", "number")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "\n").alias("text"), F.bool_or(first).alias("head"))
    )
    whole = pieces.where(F.col("kind") == WHOLE).select("text", first.alias("head")).union(joined.select("text", "head"))
    return whole.withColumn("text", F.regexp_replace("text", "\r$", "")).where("text <> ''")


def read_quoted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all files below a path, each with a header. Quotes inside fields are doubled; a quote in a field that is not quoted is not CSV.

    Fields are parsed by Spark's own parser, record by record, so nulls, empty fields and short rows are as its reader has them. The order of rows is not kept.
    """
    options = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
    rows = records(spark, path).where(~F.col("head"))
    return rows.select(F.from_csv("text", schema, options).alias("r")).select("r.*")
