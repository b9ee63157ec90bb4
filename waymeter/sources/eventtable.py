"""Event logs taken in as they grow: a manifest of consumed files, parsed events, and fold states per run.

A run lists the folder, leaves out the files that the manifest has with the same length, parses the others into a
Parquet table with shredded variants, and reduces them to one state per request. Rows are folded from the states of
all runs, so a run costs its own files alone. The manifest is written last: a run that is broken off has no entry and is done again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymeter.operators import events as E
from waymeter.session import exists
from waymeter.sources.readers import line_position, parse_events

#: Lets Spark store the fields that many events share as Parquet columns of their own, so that reading a few fields reads little.
SHREDDED = {"spark.sql.variant.writeShredding.enabled": "true", "spark.sql.variant.inferShreddingSchema": "true"}
MANIFEST = "path string, length long, run long"


class EventTable:
    """The log files of a folder under one table path. One writer at a time.

    Files may be added and may grow at their ends; a file that has grown is read again whole, and what it now says takes the
    place of what it said. Of repeated events the last counts, by file name and then by place in the file, also across runs.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _manifest(self) -> DataFrame:
        if not exists(self.spark, f"{self.path}/manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")

    def runs(self) -> int:
        """Runs that are complete."""
        return (self._manifest().agg(F.max("run")).first()[0] or 0) if exists(self.spark, f"{self.path}/manifest") else 0

    def add(self, folder: str, epoch_millis: bool = False) -> list[str]:
        """Takes in what is new and returns the names of the files it has read. The names of the new files pass through the driver, which lists them anyway."""
        run = self.runs() + 1
        listed = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(folder).select("path", "length")
        fresh = [(r["path"], r["length"]) for r in listed.join(self._manifest(), ["path", "length"], "left_anti").collect()]
        if not fresh:
            return []
        lines = self.spark.read.text([p for p, _ in fresh]).select("value", line_position().alias("p"))
        place = F.struct("p.file", F.lit(run).cast("long").alias("run"), "p.block", "p.line")
        self._write(parse_events(lines.withColumn("pos", place)), f"events/run={run}")
        typed = E.typed_events(self.spark.read.parquet(f"{self.path}/events/run={run}"), epoch_millis)
        self._write(E.states(E.with_texts(typed)), f"states/run={run}")
        self._write(self.spark.createDataFrame(fresh, "path string, length long").coalesce(1), f"manifest/run={run}")
        return sorted(p for p, _ in fresh)

    def _write(self, frame: DataFrame, name: str) -> None:
        """A half-written folder of the same run is replaced."""
        conf, usual = self.spark.conf, {k: self.spark.conf.get(k, None) for k in SHREDDED}
        for k, v in SHREDDED.items():
            conf.set(k, v)
        try:
            frame.write.mode("overwrite").parquet(f"{self.path}/{name}")
        finally:
            for k, v in usual.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def events(self) -> DataFrame:
        """The parsed events of the complete runs; of a file that was read again, those of its last reading."""
        table = self.spark.read.parquet(f"{self.path}/events").where(F.col("run") <= self.runs())
        last = self._manifest().groupBy("path").agg(F.max("run").alias("_run"))
        file = F.col("pos.file")
        return table.join(last, (file == F.col("path")) & (F.col("run") == F.col("_run"))).drop("path", "_run", "run")

    def fold(self, arm: Column | str) -> DataFrame:
        """One row per request, as :func:`~waymeter.operators.events.fold_events` has them, from the states of all runs."""
        return E.finish(E.merged(self.spark.read.parquet(f"{self.path}/states").where(F.col("run") <= self.runs())), arm)
