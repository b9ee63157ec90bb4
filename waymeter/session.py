"""Session settings and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(
    app: str = "waymeter", master: str | None = None, shuffle_partitions: int | None = None, shared: str | None = None
) -> SparkSession:
    """A session with the engine's settings; ``shared`` is the folder for intermediate tables."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shared is not None:
        builder = builder.config("spark.checkpoint.dir", shared)
    if master is not None:
        builder = builder.master(master)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Gives a session made elsewhere the two settings that results depend on, where it lacks them."""
    for name, value in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.streaming.stateStore.providerClass", ROCKSDB)):
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    A cluster must set it. A local session, whose driver and executors are one process, falls back to its warehouse.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/waymeter-scratch"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; nothing is ever overwritten."""
    return f"{shared_dir(spark).rstrip('/')}/waymeter-{label}-{uuid.uuid4().hex}"


def pin(df: DataFrame, label: str = "pin") -> DataFrame:
    """Write a frame once and continue from the written table.

    This cuts the lineage with files that outlive executors, and it freezes values
    such as partition numbers that a recomputation could change.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the session's file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
