"""Where intermediate tables go, and what importing needs."""

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from waymeter import session


def fake(**settings):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, default=None: settings.get(k.replace(".", "_"), default)))


def test_configured_folder_is_used():
    spark = fake(spark_checkpoint_dir="hdfs:///shared/", spark_master="yarn")
    assert session.shared_dir(spark) == "hdfs:///shared/"
    assert session.scratch(spark, "x").startswith("hdfs:///shared/waymeter-x-")
    assert session.scratch(spark, "x") != session.scratch(spark, "x")


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError):
        session.shared_dir(fake(spark_master="yarn"))


def test_catalog_needs_no_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    root = Path(__file__).resolve().parents[1]
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=60).returncode == 0


def test_pinned_frames_keep_their_schema(spark):
    df = spark.range(5).selectExpr("id", "named_struct('a', id, 'b', cast(null as string)) as s")
    pinned = session.pin(df)
    assert pinned.dtypes == df.dtypes and pinned.count() == 5
