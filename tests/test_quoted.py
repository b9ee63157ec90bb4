"""Quoted CSV over many splits against the standard library's reader."""

import csv
import random

import pytest

from waymeter.sources import quoted
from waymeter.sources.readers import read_csv

SCHEMA = "id string, text string, more string"


def some_rows(n, seed=1):
    rng = random.Random(seed)
    bits = ["a", " b", '"', '""', ",", "\n", "\r\n", "\n\n", "é😀", "x" * 40, '",\n"']
    return [(str(i), "".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) + "end", rng.choice(["m", "two words", 'q"q'])) for i in range(n)]


@pytest.mark.parametrize(("ending", "size"), [("\n", 97), ("\r\n", 997), ("\n", 1 << 20)])
def test_borders_anywhere(spark, tmp_path, ending, size):
    """Splits of a few lines, so that quotes, doubled quotes and line ends stand across borders, and records over many splits."""
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    rows = some_rows(400) + [("long", "line\n" * 500 + '"', "m")]
    for k, part in enumerate((rows[:150], rows[150:])):
        with open(tmp_path / f"{k}.csv", "w", newline="") as file:
            writer = csv.writer(file, lineterminator=ending)
            writer.writerow(["id", "te\nxt", "more"])
            writer.writerows(part)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = quoted.split_lines(spark, str(tmp_path))
        splits = lines.select("file", "block").distinct().count()
        assert (splits > 60) == (size < 500)
        got = sorted(map(tuple, read_csv(spark, str(tmp_path), SCHEMA).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(rows)


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    with open(tmp_path / "one.csv", "w", newline="") as file:
        csv.writer(file).writerows([["id", "text", "more"], *some_rows(3000, 2)])
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        frame = read_csv(spark, str(tmp_path), SCHEMA)
        assert frame.rdd.getNumPartitions() >= 5 and frame.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)


def test_odd_files(spark, tmp_path):
    files = {"a.csv": "", "b.csv": "id,text,more\n", "c.csv": "id,text,more", "d.csv": "id,text,more\n\n1,,x\n2\n\r\n3,\"\",\"last \"\"\n\"\"\""}
    for name, text in files.items():
        (tmp_path / name).write_text(text, newline="")
    got = sorted(map(tuple, read_csv(spark, str(tmp_path), SCHEMA).collect()))
    theirs = spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    # A line with nothing but a carriage return is an empty line here and a row there.
    assert got == sorted((tuple(r) for r in theirs.collect() if r[0] != "\r"), key=lambda r: r[0]) and len(got) == 3


def test_more_splits_than_may_be_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quoted, "BROADCAST", 0)
    test_borders_anywhere(spark, tmp_path, "\n", 997)
