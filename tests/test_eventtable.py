"""Logs that grow between runs."""

import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_events import chat, reply, route

from waymeter.operators import events as E
from waymeter.session import scratch
from waymeter.sources.eventtable import EventTable
from waymeter.sources.readers import read_eventlog


def write(folder, name, records):
    (folder / name).write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records))


def whole(spark, folder):
    return sorted((tuple(r) for r in E.fold_events(read_eventlog(spark, str(folder)), "x").collect()), key=repr)


def kept_rows(table):
    return sorted((tuple(r) for r in table.fold("x").collect()), key=repr)


def test_a_second_run_reads_new_files_only(spark, narrow, tmp_path):
    folder, table = tmp_path / "logs", EventTable(spark, scratch(spark, "events"))
    folder.mkdir()
    write(folder, "b.log", [chat("r1", "hi"), route("r1", "big"), reply("r1", "old", promptTokens=1), "", "{broken"])
    write(folder, "c.log", [reply("r1", "last"), chat("r2", "two")])
    (folder / "note.txt").write_text("no log")
    assert [p.rsplit("/", 1)[1] for p in table.add(str(folder))] == ["b.log", "c.log"] and kept_rows(table) == whole(spark, folder)
    assert table.add(str(folder)) == [] and table.runs() == 1
    write(folder, "a.log", [reply("r1", "earlier by name"), reply("r2", "first"), route("r2", "small", "fallback")])
    assert [p.rsplit("/", 1)[1] for p in table.add(str(folder))] == ["a.log"]
    rows = kept_rows(table)
    assert rows == whole(spark, folder) and {r[0]: r[-2] for r in rows} == {"r1": "last", "r2": "first"}
    read = spark.read.parquet(f"{table.path}/events/run=2").select("pos.file").distinct().collect()
    assert [r[0].rsplit("/", 1)[1] for r in read] == ["a.log"]
    plan = table.fold("x")._jdf.queryExecution().optimizedPlan().toString()
    assert "variant" not in plan.lower()  # rows come from states, not from events


def test_a_file_that_has_grown_is_read_again(spark, narrow, tmp_path):
    folder, table = tmp_path / "logs", EventTable(spark, scratch(spark, "events"))
    folder.mkdir()
    write(folder, "a.log", [chat("r1", "hi"), reply("r1", "one")])
    write(folder, "b.log", [chat("r2", "hi")])
    table.add(str(folder))
    write(folder, "a.log", [chat("r1", "hi"), reply("r1", "one"), reply("r1", "two"), chat("r3", "new")])
    assert len(table.add(str(folder))) == 1
    assert kept_rows(table) == whole(spark, folder) and table.events().count() == 5


def test_a_run_that_is_broken_off_is_done_again(spark, narrow, tmp_path, monkeypatch):
    folder, table = tmp_path / "logs", EventTable(spark, scratch(spark, "events"))
    folder.mkdir()
    write(folder, "a.log", [chat("r1", "hi"), reply("r1", "one")])
    table.add(str(folder))
    write(folder, "b.log", [reply("r1", "two")])
    real = EventTable._write

    def broken(self, frame, name):
        if name.startswith("manifest"):
            raise OSError("lost")
        real(self, frame, name)

    monkeypatch.setattr(EventTable, "_write", broken)
    with pytest.raises(OSError):
        table.add(str(folder))
    monkeypatch.setattr(EventTable, "_write", real)
    assert table.events().count() == 2 and {r[-2] for r in kept_rows(table)} == {"one"}
    assert len(table.add(str(folder))) == 1 and kept_rows(table) == whole(spark, folder) and table.events().count() == 3


def test_events_are_shredded(spark, narrow, tmp_path):
    folder, table = tmp_path / "logs", EventTable(spark, scratch(spark, "events"))
    folder.mkdir()
    write(folder, "a.log", [route(f"r{i}", "big", metadata={"judge_prompt_tokens": i}) for i in range(300)])
    table.add(str(folder))
    files = [p for p in spark.read.parquet(f"{table.path}/events").select(F.input_file_name()).distinct().toPandas().iloc[:, 0]]
    names = str(pq.ParquetFile(files[0].removeprefix("file://")).schema)
    assert "typed_value" in names and "selected_model" in names
