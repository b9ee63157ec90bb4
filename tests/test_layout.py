"""Distributed ordering against brute force, with many slabs and a hot key."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymeter.operators import layout, sampling, stats, windows


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    # Key a holds most rows; values repeat; one key has a single row.
    data = [("a", rng.randint(0, 40), i) for i in range(700)]
    data += [("b", rng.randint(0, 40), 1000 + i) for i in range(120)] + [("c", 3, 5000), (None, 7, 6000), (None, 1, 6001)]
    rng.shuffle(data)
    return data


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, v int, id long").repartition(5)


def test_slabs_are_many(frame):
    laid = layout.lay_out(frame, "k", "v", "id")
    assert laid.select("_slab").distinct().count() > 3


def test_number_rows(frame, rows):
    want = {}
    for key in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        want |= {r[2]: i + 1 for i, r in enumerate(ordered)}
    got = {r["id"]: r["rn"] for r in layout.number_rows(frame, ["k"], ["v", "id"], "rn").collect()}
    assert got == want
    overall = layout.number_rows(frame, [], ["v", "id"], "rn").orderBy("rn").collect()
    assert [r["id"] for r in overall] == [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))]
    assert [r["rn"] for r in overall] == list(range(1, len(rows) + 1))


def test_running_sum(frame, rows):
    got = {r["id"]: r["s"] for r in layout.running_sum(frame, ["k"], ["v", "id"], "v", "s").collect()}
    for key in {r[0] for r in rows}:
        total = 0
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            total += r[1]
            assert got[r[2]] == total


def test_percentiles(frame, rows):
    got = {r["k"]: r for r in layout.percentiles_wide(frame, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    for key in {r[0] for r in rows}:
        values = [r[1] for r in rows if r[0] == key]
        assert got[key]["n"] == len(values)
        for name, p in (("p10", 10), ("p50", 50), ("p99", 99)):
            assert got[key][name] == pytest.approx(np.percentile(values, p))


def test_top_per_group(frame, rows):
    got = layout.top_per_group(frame, ["k"], ["v", "id"], 9, "id").collect()
    for key in {r[0] for r in rows}:
        want = [r[2] for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))][:9]
        assert [r["id"] for r in sorted((r for r in got if r["k"] == key), key=lambda r: r["_rn"])] == want


def test_pareto(spark):
    rng = random.Random(2)
    points = [(i, rng.randint(0, 300), rng.randint(0, 300)) for i in range(400)] + [(900, 0, 5), (901, 0, 5)]
    got = {r["i"] for r in stats.pareto(spark.createDataFrame(points, "i int, usd int, acc int")).collect()}
    want = {
        i for i, u, a in points
        if not any(x <= u and y >= a and (x < u or y > a) for _, x, y in points)
    }
    assert got == want


def walk(rows, n, timeout):
    """Plain sequential batching of one lane."""
    out, wid, held, since = {}, 0, n, None
    for ts, ident in sorted(rows):
        if held >= n or ts >= since + timeout:
            wid, held, since = wid + 1, 0, ts
        out[ident] = (wid, held)
        held += 1
    return out


@pytest.mark.parametrize("n,timeout,chunk", [(20, 50, 7), (5, 8, 3), (3, 10**9, 4), (50, 400, 11), (1, 5, 6), (20, 50, 10**6)])
def test_micro_batch_table(spark, n, timeout, chunk):
    rng = random.Random(n * 31 + chunk)
    rows, at = [], 0
    for i in range(600):
        at += rng.choice([0, 0, 1, 2, 3, 40])
        rows.append(("hot" if rng.random() < 0.7 else rng.choice("xy"), at, i))
    df = spark.createDataFrame(rows, "lane string, ts long, id long").repartition(4)
    got = windows.micro_batch_table(df, "lane", "ts", "id", n, timeout, chunk_rows=chunk).collect()
    want = {}
    for lane in ("hot", "x", "y"):
        want |= walk([(t, i) for name, t, i in rows if name == lane], n, timeout)
    assert {r["id"]: (r["wid"], r["at"]) for r in got} == want
    facts = windows.window_facts(spark.createDataFrame(got), n, timeout).collect()
    assert all(r["wait"] >= 0 and r["batch"] <= n for r in facts)


def watched_chunks(monkeypatch, folder):
    """Notes the rows of every call of the last step in a file."""
    real = windows._assign

    def noted(*args):
        run = real(*args)

        def noting(table):
            with open(f"{folder}/calls", "a") as f:
                f.write(f"{len(table)}\n")
            return run(table)

        return noting

    monkeypatch.setattr(windows, "_assign", noted)


def test_many_lanes_share_a_chunk(spark, monkeypatch, tmp_path):
    """Python runs once for so many rows, not for each lane; lanes are large numbers or null."""
    watched_chunks(monkeypatch, tmp_path)
    rng = random.Random(5)
    rows = [(rng.choice([None, (1 << 60) + rng.randrange(900)]) if i % 20 == 0 else (1 << 60) + rng.randrange(900), rng.randrange(400), i) for i in range(6000)]
    got = windows.micro_batch_table(spark.createDataFrame(rows, "lane long, ts long, id long"), "lane", "ts", "id", 4, 60, chunk_rows=500).collect()
    want = {}
    for lane in {r[0] for r in rows}:
        want |= walk([(t, i) for name, t, i in rows if name == lane], 4, 60)
    assert {r["id"]: (r["wid"], r["at"]) for r in got} == want
    assert {r["id"]: r["lane"] for r in got} == {i: lane for lane, _, i in rows}
    calls = [int(x) for x in (tmp_path / "calls").read_text().split()]
    assert len(calls) <= 6000 // 500 + 8 and max(calls) <= 500


def test_a_chunk_of_usual_size_is_small(spark, monkeypatch, tmp_path):
    """All rows in one slab and lane: a task's Python never holds many of them."""
    watched_chunks(monkeypatch, tmp_path)
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        df = spark.range(200_000).select(F.lit(1).alias("lane"), F.col("id").alias("ts"), "id")
        out = windows.micro_batch_table(df, "lane", "ts", "id", 20, 10**9)
        assert out.where("wid <> ts div 20 + 1 or at <> ts % 20").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    calls = [int(x) for x in (tmp_path / "calls").read_text().split()]
    assert sum(calls) >= 200_000 and max(calls) <= 1 << 16


def test_balanced_and_stratified_are_exact(frame):
    labelled = frame.where("k is not null")
    assert {r["k"]: r["count"] for r in sampling.balanced(labelled, "k", 1000, 1, "id").groupBy("k").count().collect()} == {"a": 1, "b": 1, "c": 1}
    strat = sampling.stratified(labelled, "k", 30, 1, "id").groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in strat} == {"a": 10, "b": 10, "c": 1}


def test_dedup_keeps_first(spark):
    df = spark.createDataFrame([("x", 3), ("x", 1), ("y", 2), ("x", 2)], "t string, id int")
    assert sorted(map(tuple, sampling.dedup_first(df, "t", "id").collect())) == [("x", 1), ("y", 2)]


def test_ids_are_padded_and_unique(spark):
    out = sampling.assign_ids(spark.range(10, 1212).select("id").withColumnRenamed("id", "doc"), "doc", 3, "w").collect()
    ids = sorted(r["id"] for r in out)
    assert ids[0] == "w0000" and len(set(ids)) == 1202 and "w1201" in ids


def test_approximate_latency_is_close(frame):
    exact = {(r["k"]): r["p50"] for r in stats.latency(frame, ["v"], ["k"]).collect()}
    near = {(r["k"]): r["p50"] for r in stats.latency(frame, ["v"], ["k"], approx=True).collect()}
    assert all(abs(exact[k] - near[k]) <= 1 for k in "ab")  # a tiny key may sit between two values


def test_lanes_keep_equal_texts_together(spark):
    df = spark.createDataFrame([(f"t{i % 50}",) for i in range(400)], "t string")
    out = windows.lanes(df, "t", 8)
    assert out.groupBy("t").agg(F.count_distinct("lane").alias("n")).where("n > 1").isEmpty()
    assert out.agg(F.min("lane"), F.max("lane")).first() == (0, 7)


@pytest.mark.parametrize("k", [3, 1500])
def test_top_per_group_below_and_above_the_limit(spark, k):
    rows = spark.range(6000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('g', id % 7)) as g", "(id * 7919) % 6007 as o")
    got = {(r.g, r._rn, r.id) for r in layout.top_per_group(rows, ["g"], ["o", "id"], k, "id").collect()}
    want, groups = set(), {}
    for r in rows.collect():
        groups.setdefault(r.g, []).append((r.o, r.id))
    for g, own in groups.items():
        want |= {(g, i + 1, ident) for i, (_, ident) in enumerate(sorted(own)[:k])}
    assert got == want
