"""A finished table as a bounded, ordered stream with an end.

The source hands out row ranges, not rows: its offsets are positions in a numbered table, and each micro-batch is one
range, which the handler gets as a frame read by Spark's own reader from any store. Behind the last row stands an end marker, an offset of its own, so the handler knows
the last micro-batch and can flush what it holds; then the query has nothing more to do and ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from waymeter.operators.layout import number_rows
from waymeter.session import exists, scratch

POSITION = "_position"
Handler = Callable[[DataFrame, int, bool], None]


class RowRange(InputPartition):
    def __init__(self, begin: int, upto: int) -> None:
        self.begin, self.upto = begin, upto


class RangeReader(DataSourceStreamReader):
    """Offsets run from 0 to ``rows + 1``, the last one being the end marker; a micro-batch takes ``step`` of them."""

    def __init__(self, rows: int, step: int, begin: int) -> None:
        self.rows, self.step, self.at = rows, step, begin

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        upto = self.at + self.step
        return {"row": min(upto if upto < self.rows else upto + 1, self.rows + 1)}  # the marker goes with the last rows

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["row"])  # also when a micro-batch is repeated after a restart
        return [RowRange(start["row"], end["row"])] if end["row"] > start["row"] else []

    def read(self, partition: RowRange) -> Iterator[tuple]:
        yield partition.begin, min(partition.upto, self.rows), partition.upto > self.rows


class RangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "row_ranges"

    def schema(self) -> str:
        return "begin long, upto long, last boolean"

    def streamReader(self, schema) -> RangeReader:
        return RangeReader(*(int(self.options[k]) for k in ("rows", "step", "begin")))


def number(df: DataFrame, order: list[Column | str]) -> tuple[str, int]:
    """Writes a table in ``order``, with positions from 0, for :func:`run`; returns its folder and its number of rows.

    Files and row groups hold ranges of positions, so that a micro-batch reads no more than those it needs.
    """
    path = scratch(df.sparkSession, "ordered")
    numbered = number_rows(df, [], order, POSITION).withColumn(POSITION, F.col(POSITION) - 1)
    numbered.repartitionByRange(POSITION).sortWithinPartitions(POSITION).write.parquet(path)
    return path, df.sparkSession.read.parquet(path).count()


def _reached(spark: SparkSession, checkpoint: str) -> int:
    """The offset that a stopped query's log ends with; 0 for a new one."""
    if not exists(spark, f"{checkpoint}/offsets"):
        return 0
    rows = F.get_json_object("value", "$.row").cast("long")
    return spark.read.text(f"{checkpoint}/offsets").where("value like '{\"row\"%'").agg(F.max(rows)).first()[0] or 0


def run(spark: SparkSession, folder: str, rows: int, step: int, checkpoint: str, handle: Handler) -> None:
    """Runs ``handle(frame, number, last)`` on each ``step`` rows in order, and returns when the last has ended.

    An empty table gives one empty, last micro-batch. Started again with the same checkpoint, the run goes on with the micro-batch it
    was broken off in: the same rows under the same number, so a handler that overwrites what it wrote
    under a number takes each row once.
    """
    spark.dataSource.register(RangeSource)
    table = spark.read.parquet(folder)

    def step_over(ranges: DataFrame, number: int) -> None:
        for begin, upto, last in ranges.collect():  # one row
            handle(table.where((F.col(POSITION) >= begin) & (F.col(POSITION) < upto)).drop(POSITION), number, last)

    stream = spark.readStream.format(RangeSource.name()).option("rows", rows).option("step", step).option("begin", _reached(spark, checkpoint)).load()
    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step_over).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
