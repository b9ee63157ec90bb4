"""Streams drained to tables, and a restart from a checkpoint."""

import random

import pytest
from oracle import mismatch
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from waymeter.catalog import streams
from waymeter.operators import policies
from waymeter.operators.windows import micro_batch_table
from waymeter.session import scratch
from waymeter.streaming import batcher, durable, ranges, replay


def test_batcher_flushes_the_tail(spark):
    rows = spark.range(45).select(F.lit(0).cast("long").alias("lane"), F.col("id").cast("string").alias("id"), F.lit("p").alias("prompt"), F.col("id").alias("seq"))
    stream = replay.file_stream(spark, replay.as_files(rows.repartition(1), ["id"]), "lane long, id string, prompt string, seq long")
    path = scratch(spark, "sink")
    query = replay.start_table(batcher.micro_batch(stream, "lane", 20, 1500), path, scratch(spark, "state"), available_now=False)
    out = replay.drain(query, path, 45).collect()
    sizes = {(r["wid"], r["batch"], r["closed_by"]) for r in out}
    assert sizes == {(0, 20, "size"), (1, 20, "size"), (2, 5, "time")}
    assert len({r["id"] for r in out}) == 45 and all(r["wait_ms"] >= 0 for r in out)
    assert sorted(r["at"] for r in out if r["wid"] == 2) == list(range(5))


def lane_rows(spark, n, seed=2):
    """Half of all rows are lane 7's, some have no lane; seconds have gaps and ties."""
    rng, at, rows = random.Random(seed), 0, []
    for i in range(n):
        at += rng.choice([0, 1, 1, 2, 9])
        rows.append((rng.choice([7, 7, 7, 1, 2, None]), f"r{i:05}", f"p{i}", at))
    return rows, spark.createDataFrame(rows, "lane long, id string, prompt string, seq long").repartition(3)


def windows_brute(rows, n, timeout=None):
    """(lane, wid, at, id, batch, why) of each row, lane by lane and row by row; the last instant closes by time too."""
    out, last = [], max((r[3] for r in rows), default=0)
    for lane in {r[0] for r in rows}:
        mine, windows = sorted((r for r in rows if r[0] == lane), key=lambda r: (r[3], r[1])), []
        for row in mine:
            if not windows or len(windows[-1]) == n or timeout is not None and row[3] >= windows[-1][0][3] + timeout:
                windows.append([])
            windows[-1].append(row)
        for wid, held in enumerate(windows):
            expired = timeout is not None and (wid < len(windows) - 1 or last >= held[0][3] + timeout)
            why = "size" if len(held) == n else "time" if expired else "end"
            out += [(lane, wid, at, r[1], len(held), why) for at, r in enumerate(held)]
    return sorted(out, key=repr)


def told(df):
    return sorted((tuple(r) for r in df.select("lane", "wid", "at", "id", "batch", "closed_by").collect()), key=repr)


@pytest.mark.parametrize(("n", "step", "timeout", "size"), [(20, 400, 25, 1000), (7, 97, 10, 290), (50, 10_000, None, 1000), (20, 19, None, 70)])
def test_lane_windows_over_micro_batches(spark, narrow, n, step, timeout, size):
    rows, df = lane_rows(spark, size)
    out = batcher.run_lanes(df, n, step, timeout)
    assert told(out) == windows_brute(rows, n, timeout)
    assert out.where("wait_ms < 0 or wait_ms is null").count() == 0


def test_lane_windows_without_rows(spark, narrow):
    _, df = lane_rows(spark, 10)
    assert told(batcher.run_lanes(df.limit(0), 20, 5)) == []


def test_a_hot_lane_is_worked_on_by_many_tasks(spark, monkeypatch):
    rows = spark.range(6000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 9).cast("long").alias("lane"), F.col("id").cast("string").alias("id"), F.lit("p").alias("prompt"), F.col("id").alias("seq"))
    chunks, real = [], batcher.micro_batch_table

    def watched(df, *args):
        out = real(df, *args)
        chunks.append(out.where("lane = 0").groupBy(F.spark_partition_id().alias("task")).count().collect())
        return out

    monkeypatch.setattr(batcher, "micro_batch_table", watched)
    folder, size = ranges.number(rows, ["seq"])
    windows = batcher.LaneWindows(scratch(spark, "windows"), scratch(spark, "lanes"), 20, chunk_rows=100)
    ranges.run(spark, folder, size, 6000, scratch(spark, "state"), windows)
    hot = [r["count"] for r in chunks[0]]
    assert len(hot) >= 5 and max(hot) < 0.6 * sum(hot) and sum(hot) > 3000
    plain = micro_batch_table(rows, "lane", "seq", "id", 20, batcher.WHOLE).select("lane", F.col("wid") - 1, "at", "id")
    assert sorted(map(tuple, plain.collect())) == sorted(r[:4] for r in told(windows.result(spark)))


def test_the_batcher_goes_on_after_a_restart(spark, narrow):
    """Broken off in the middle, before and after a micro-batch's output is written, and started again with the same checkpoint."""
    rows, df = lane_rows(spark, 500)
    folder, size = ranges.number(df, ["seq", "id"])
    windows, checkpoint, seen = batcher.LaneWindows(scratch(spark, "windows"), scratch(spark, "lanes"), 20), scratch(spark, "state"), []

    class Broken(Exception):
        pass

    def broken(frame, number, last):
        seen.append(number)
        if seen == [0, 1, 2]:
            raise Broken
        windows(frame, number, last)
        if seen == [0, 1, 2, 2, 3]:
            raise Broken

    for _ in range(2):
        with pytest.raises(StreamingQueryException):
            ranges.run(spark, folder, size, 100, checkpoint, broken)
    ranges.run(spark, folder, size, 100, checkpoint, broken)
    assert seen == [0, 1, 2, 2, 3, 3, 4]
    assert told(windows.result(spark)) == windows_brute(rows, 20)
    ranges.run(spark, folder, size, 100, checkpoint, broken)  # nothing is left
    assert len(seen) == 7


def test_ranges_come_in_order_with_an_end(spark, narrow):
    rows = spark.range(1000).select((F.lit(999) - F.col("id")).alias("seq"), F.lit("x").alias("_kept"))
    folder, size = ranges.number(rows, ["seq"])
    seen = []
    ranges.run(spark, folder, size, 300, scratch(spark, "state"), lambda df, k, last: seen.append((k, last, sorted(r[0] for r in df.select("seq").collect()), df.columns)))
    assert [s[:2] for s in seen] == [(0, False), (1, False), (2, False), (3, True)]
    assert sum((s[2] for s in seen), []) == list(range(1000)) and seen[0][3] == ["seq", "_kept"]
    for n, step in ((0, 10), (20, 10), (1, 1)):
        seen.clear()
        folder, size = ranges.number(rows.where(F.col("seq") < n), ["seq"])
        ranges.run(spark, folder, size, step, scratch(spark, "state"), lambda df, k, last: seen.append((last, df.count())))
        assert [s[0] for s in seen] == [False] * (len(seen) - 1) + [True] and sum(s[1] for s in seen) == n and len(seen) == max(1, -(-n // step))


def test_the_batcher_queries_in_several_micro_batches(spark, narrow, monkeypatch):
    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(streams, "STEP", 300)
    run, text = streams.ENTRIES["st_batcher"]
    assert not mismatch(run(spark, folder), folder, text)


def test_tails_wait_for_their_timers(spark, narrow):
    rows, df = lane_rows(spark, 130)
    out = batcher.run_lanes(df, 20, 70, timer_ms=700)
    assert told(out) == sorted(((*r[:5], "time" if r[5] == "end" else r[5]) for r in windows_brute(rows, 20)), key=repr)
    waits = {r["closed_by"]: r["w"] for r in out.groupBy("closed_by").agg(F.min("wait_ms").alias("w")).collect()}
    assert waits["time"] >= 700 and waits["size"] >= 0


def test_the_batcher_query_keeps_lanes_longer_than_a_few_windows(spark, narrow, tmp_path):
    """Lanes do not get more numerous with the table, so that a lane's rows grow with it."""
    events = spark.range(11_000).select(F.col("id").alias("event_id"), (F.col("id") % 66).alias("user_id"), F.lit("view").alias("event_type"), F.lit("{}").alias("props"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    run, _ = streams.ENTRIES["st_batcher"]
    lanes = run(spark, str(tmp_path)).groupBy("lane").agg(F.count(F.lit(1)).alias("n"), F.max("wid").alias("wid"), F.collect_set("closed_by").alias("why")).collect()
    assert len(lanes) == 64 and sum(r["n"] for r in lanes) == 11_000 and max(r["wid"] for r in lanes) == 16
    assert all(set(r["why"]) == {"size", "time"} for r in lanes)


def test_micro_batches_bring_each_lane_several_rows(spark, narrow, monkeypatch, tmp_path):
    """Else what lanes carry on, which grows with the table, would be written again with each of ever more micro-batches."""
    events = spark.range(3200).select(F.col("id").alias("event_id"), (F.col("id") % 97).alias("user_id"), F.lit("view").alias("event_type"), F.lit("{}").alias("props"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    steps = []
    monkeypatch.setattr(streams, "STEP", 10)
    monkeypatch.setattr(streams.B, "run_lanes", lambda rows, n, step, **more: steps.append(step))
    streams._batched(spark, str(tmp_path))
    assert steps == [20 * streams.ROUND]


KIND = "content string, id string, model string, decision_ms double"


def test_decisions_survive_a_restart(spark, narrow):
    rng = random.Random(1)

    def coins(run):
        return spark.createDataFrame([(f"c{i}", f"{run}-{i}", rng.choice(["small", "big"]), rng.random()) for i in range(60)], KIND)

    folder, state, path = scratch(spark, "in"), scratch(spark, "state"), scratch(spark, "sink")
    found = []
    for run in ("first", "second"):
        coins(run).write.mode("append").parquet(folder)
        found.append(durable.keyed_answers(spark, folder, KIND, path, state).collect())
    kept, again = ({r["content"]: (r["model"], r["decision_ms"]) for r in out if r["id"].startswith("first")} for out in found)
    second = {r["content"]: (r["model"], r["decision_ms"]) for r in found[1] if r["id"].startswith("second")}
    assert len(found[0]) == 60 and len(found[1]) == 120 and kept == again == second
    assert spark.read.parquet(path).count() == 60


def test_of_proposals_in_one_micro_batch_the_smallest_id_counts(spark, narrow):
    rows = [(f"c{i % 3}" if i % 5 else None, f"{(i * 37) % 100:03}", f"m{i}", float(i)) for i in range(100)]
    folder = scratch(spark, "in")
    spark.createDataFrame(rows, KIND).repartition(7).write.parquet(folder)
    want = {}
    for content, i, model, ms in sorted(rows, key=lambda r: r[1]):
        want.setdefault(content, (model, ms))
    got = durable.keyed_answers(spark, folder, KIND, scratch(spark, "sink"), scratch(spark, "state")).collect()
    assert sorted((str(r["content"]), r["id"], r["model"], r["decision_ms"]) for r in got) == sorted((str(c), i, *want[c]) for c, i, *_ in rows)


def test_a_dominant_content_reaches_its_key_once_a_task(spark):
    """A third of the rows share a content. Few of them get to keyed state, and the answers' join may split the others."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id").cast("string"))).alias("content"), F.col("id").cast("string").alias("id"), F.lit("m").alias("model"), F.lit(1.0).alias("decision_ms")
    ).repartition(4)
    folder, path = scratch(spark, "in"), scratch(spark, "sink")
    rows.write.parquet(folder)
    reduced = durable.first_proposals(spark.read.schema(KIND).parquet(folder))
    assert reduced.where("content = 'hot'").count() <= reduced.rdd.getNumPartitions() and reduced.count() == 2000 + reduced.where("content = 'hot'").count()
    out = durable.keyed_answers(spark, folder, KIND, path, scratch(spark, "state"))
    assert out.count() == 3000 and "Join" in out._jdf.queryExecution().optimizedPlan().toString() and "FlatMap" not in out._jdf.queryExecution().executedPlan().toString()


def test_decision_table_form(spark, narrow):
    store = scratch(spark, "store")
    reqs = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "a")], "id string, prompt string")

    def decide(seed):
        def run(df):
            return df.withColumn("model", F.lit(f"m{seed}")).withColumn("decision_ms", F.rand())

        return run

    first = {r["id"]: r for r in durable.durable_table(reqs, store, "1", decide(1)).collect()}
    more = reqs.union(spark.createDataFrame([("4", "c")], reqs.schema)).repartition(7)
    second = {r["id"]: r for r in durable.durable_table(more, store, "2", decide(2)).collect()}
    assert all(second[i]["decision_ms"] == first[i]["decision_ms"] and second[i]["replayed"] for i in first)
    assert second["4"]["model"] == "m2" and first["1"]["decision_ms"] == first["3"]["decision_ms"]
    rerun = {r["id"]: r for r in durable.durable_table(more, store, "2", decide(3)).collect()}
    assert {i: r["decision_ms"] for i, r in rerun.items()} == {i: r["decision_ms"] for i, r in second.items()}


def test_stream_pairs_requests_with_replies(spark):
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id"))
    asked = spark.range(30).select(F.col("id").cast("string").alias("request_id"), at.alias("t_request"))
    said = spark.range(25).select(F.col("id").cast("string").alias("request_id"), (at + F.expr("interval 250 milliseconds")).alias("t_response"))
    a, b = scratch(spark, "a"), scratch(spark, "b")
    asked.write.parquet(a)
    said.write.parquet(b)
    paired = replay.pair_streams(
        replay.file_stream(spark, a, "request_id string, t_request timestamp"),
        replay.file_stream(spark, b, "request_id string, t_response timestamp"),
    )
    out = replay.run_to_end(paired).collect()
    assert len(out) == 25 and {r["e2e_ms"] for r in out} == {250.0}


def test_policies_run_on_a_stream(spark):
    rows = spark.range(50).select(F.concat(F.lit("prompt "), F.col("id").cast("string")).alias("prompt"))
    stream = replay.file_stream(spark, replay.as_files(rows, ["prompt"]), "prompt string", 2)
    policy = policies.hash_split(50)
    got = replay.run_to_end(policies.decide(stream, "prompt", policy).select("prompt", "decision.selected"))
    want = policies.decide(rows, "prompt", policy).select("prompt", "decision.selected")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_batched_decisions_with_a_dominant_prompt(spark, narrow):
    rows = [(str(i), "hi" if i % 3 else f"p{i % 10}") for i in range(90)]
    df = spark.createDataFrame(rows, "id string, prompt string")
    stream = replay.file_stream(spark, replay.as_files(df, ["id"]), "id string, prompt string", 2)
    path, store = scratch(spark, "out"), scratch(spark, "store")

    def decide(new):
        return new.withColumn("model", F.concat(F.lit("m"), F.floor(F.rand() * 1e6).cast("string"))).withColumn("decision_ms", F.rand())

    query = durable.durable_batches(stream, store, path, scratch(spark, "state"), decide)
    assert query.awaitTermination(200)
    out = spark.read.parquet(path).collect()
    assert sorted(r["id"] for r in out) == sorted(i for i, _ in rows)
    kept = {}
    for r in out:
        kept.setdefault(r["prompt"], set()).add((r["model"], r["decision_ms"]))
    assert all(len(v) == 1 for v in kept.values()) and len({r["part"] for r in out}) > 1


def test_no_request_is_lost_in_the_decision_store(spark):
    store = scratch(spark, "store")
    reqs = spark.createDataFrame([(str(i), None if i % 3 == 0 else f"p{i % 5}") for i in range(30)] + [("x", "")], "id string, prompt string")
    decide = lambda df: df.withColumn("model", F.lit("m")).withColumn("decision_ms", F.lit(1.0))
    first = durable.durable_table(reqs, store, "1", decide)
    assert first.count() == 31 and first.where("model is null").count() == 0
    second = durable.durable_table(reqs.where("prompt = 'p1'"), store, "2", decide)
    assert {r["replayed"] for r in second.collect()} == {True}
    empty = durable.durable_table(reqs.limit(0), store, "3", decide)
    assert empty.count() == 0


def test_decision_store_is_cut_as_finely_as_it_is_large(spark, narrow, monkeypatch):
    """Batches of different sizes have folders of different depth, and later batches find them all."""
    store = scratch(spark, "store")
    decide = lambda df: df.withColumn("model", F.lit("m")).withColumn("decision_ms", F.lit(1.0))
    reqs = [spark.range(a, b).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt")) for a, b in ((0, 40), (20, 120), (0, 200))]
    depths = []
    for k, (frame, least) in enumerate(zip(reqs, (1000, 20, 2))):
        monkeypatch.setattr(durable, "SLOT_ROWS", least)
        out = durable.durable_table(frame, store, str(k), decide).collect()
        assert len(out) == frame.count() and {r["id"] for r in out if r["replayed"]} == {str(i) for i in range((0, 20, 0)[k], (0, 40, 120)[k])}
        depths.append({len(r[0] or "") for r in spark.read.schema(durable.STORED + ", batch string, slot string").parquet(store).where(F.col("batch") == str(k)).select("slot").collect()})
    assert depths == [{1}, {2}, {3}]


def test_batch_log(spark):
    rows = [(0, f"r{i}", f"text {i}" * 20, i, i // 3, i % 3, 3 if i < 6 else 1, 5, "size") for i in range(7)]
    batched = spark.createDataFrame(rows, batcher.OUTPUT)
    replies = spark.createDataFrame(
        [(0, 0, '{"choices": ["big", "small", "big"]}', 3.5, 30, 12), (0, 1, "{", 4.5, 30, 12)],
        "lane long, wid long, reply string, judge_ms double, judge_prompt_tokens long, judge_completion_tokens long",
    )
    out = batcher.batch_log(batched, replies).orderBy("wid", "at").collect()
    assert [r["model"] for r in out] == ["big", "small", "big"] + ["small"] * 4
    assert [r["parse_failed"] for r in out] == [False] * 3 + [True] * 3 + [False]
    assert out[0]["prompt_head"] == ("text 0" * 20)[:60] and out[6]["judge_ms"] is None and {r["wait_ms"] for r in out} == {5}
    assert set(batcher.LOG) <= set(out[0].asDict())
