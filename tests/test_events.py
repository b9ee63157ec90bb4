"""Log folding and prompt matching on written-out cases."""

import json
import random

import pytest

from waymeter.operators import events as E
from waymeter.operators import recovery
from waymeter.session import scratch
from waymeter.sources import readers as R
from waymeter.sources import writers

REQUESTS = [("w1", "c", "gsm8k", "one plus one"), ("w2", "c", "mmlu", "one plus two"), ("w3", "c", "mmlu", "long text about routes"),
            ("w4", "c", "mmlu", "dup"), ("w5", "c", "gsm8k", "dup")]


def chat(rid, content, ts="2024-01-01T00:00:00Z", role="user", **more):
    return {"eventType": "_chat_request_event", "timestamp": ts, "event": {"id": rid, "attributes": {"messages": [{"role": role, "content": content}]}}, **more}


def route(rid, model, source="strategy", ms=1.5, **more):
    return {"eventType": "_model_routing_event", "timestamp": "2024-01-01T00:00:01Z",
            "event": {"attributes": {"request_id": rid, "selected_model": model, "decision_source": source, "decision_ms": ms, **more}}}


def reply(rid, content, ts="2024-01-01T00:00:02.250Z", **extra):
    return {"eventType": "_chat_response_event", "timestamp": ts,
            "event": {"attributes": {"request_id": rid, "response": {"content": content, "extra_args": extra}}}}


@pytest.fixture(scope="module")
def workload(spark):
    return spark.createDataFrame(REQUESTS, R.REQUEST)


def parse(spark, records):
    lines = [(r if isinstance(r, str) else json.dumps(r), i) for i, r in enumerate(records)]
    return R.parse_events(spark.createDataFrame(lines, "value string, pos long"))


def fold(spark, workload, records):
    return {r["request_id"]: r for r in E.results(parse(spark, records), workload, "arm").collect()}


def test_whole_life_of_a_request(spark, workload):
    out = fold(spark, workload, [
        "", "  ", "{broken", '"text"',
        chat("r1", "one plus one"), route("r1", "stale"), route("r1", "big", score=0.7, metadata={"judge_prompt_tokens": 9}),
        reply("r1", "hi", promptTokens=3, completionTokens=4, model_name="m-1"),
    ])["r1"]
    assert (out["workload_id"], out["slice"]) == ("w1", "gsm8k")
    assert (out["selected_model"], out["final_model"], out["win_rate"], out["judge_prompt_tokens"]) == ("big", "big", 0.7, 9)
    assert out["e2e_ms"] == 2250.0 and out["fallback_attempted"] is None and out["answer"] == "hi"


def test_last_routing_event_overwrites_with_nulls(spark, workload):
    out = fold(spark, workload, [route("r", "a", score=0.5), route("r", "b")])["r"]
    assert out["selected_model"] == "b" and out["win_rate"] is None and out["workload_id"] is None


def test_fallback_and_final_model_order(spark, workload):
    a = fold(spark, workload, [route("r", "a"), route("r", "b", "fallback"), reply("r", "x")])["r"]
    assert a["final_model"] == "b" and a["selected_model"] == "a" and a["fallback_attempted"] is True
    b = fold(spark, workload, [route("r", "a"), route("r", "b", "fallback"), reply("r", "x", model_routing={"final_model": "c"})])["r"]
    assert b["final_model"] == "c"
    c = fold(spark, workload, [reply("r", "x", model_routing={"final_model": "c"}), route("r", "b", "fallback")])["r"]
    assert c["final_model"] == "b"
    d = fold(spark, workload, [reply("r", "x", model_name="m")])["r"]
    assert d["final_model"] == "m"
    e = fold(spark, workload, [route("r", None, "fallback"), route("r", "a")])["r"]
    assert e["final_model"] is None  # set to null by the fallback, so the default does not apply


def test_content_kinds(spark, workload):
    cut = {"truncatedString": "long text...", "omittedChars": 9}
    out = fold(spark, workload, [
        chat("a", cut), chat("b", {"truncatedString": "one plus...", "omittedChars": 4}), chat("c", "dup"),
        chat("d", "unknown"), chat("e", "one plus one", role="system"), chat("f", '{"truncatedString": "one plus one"}'),
        reply("a", None), reply("b", {"k": 1}), reply("c", "y" * 5000),
    ])
    assert out["a"]["workload_id"] == "w3" and out["b"]["workload_id"] == ""
    assert out["c"]["workload_id"] == "w5" and out["d"]["workload_id"] == ""
    assert out["e"]["workload_id"] is None and out["f"]["workload_id"] == ""
    assert out["a"]["answer"] == "" and json.loads(out["b"]["answer"]) == {"k": 1} and len(out["c"]["answer"]) == 4000


def test_times(spark, workload):
    out = fold(spark, workload, [chat("r", "dup", ts=1704067200000), reply("r", "x"), chat("s", "dup", ts="bad"), reply("s", "x")])
    assert out["r"]["e2e_ms"] is None and out["s"]["e2e_ms"] is None
    events = parse(spark, [chat("a", "x", ts=None), chat("b", "x", ts="bad"), chat("c", "x", ts="2024-01-02T00:00:00+01:00"), chat("d", "x", ts="2024-01-01")])
    kept = {r["event_id"] for r in R.after(events, "2024-01-01T12:00:00Z").collect()}
    assert kept == {"a", "c"}


def test_record_may_be_the_event(spark, workload):
    rec = {"type": "_chat_request_event", "id": "r", "timestamp": "2024-01-01T00:00:00Z", "attributes": {"messages": [{"role": "USER", "content": "dup"}]}}
    assert fold(spark, workload, [rec])["r"]["workload_id"] == "w5"


def test_prefixes_match_brute_force(spark):
    rng = random.Random(8)
    prompts = list({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(300)})
    items = spark.createDataFrame([(p, f"w{i}", "s") for i, p in enumerate(prompts)], "prompt string, id string, slice string")
    probes = list({"".join(rng.choice("abc") for _ in range(rng.randint(1, 10))) for _ in range(300)} | set(prompts[:20]) | {""})
    got = {r["prefix"]: r["id"] for r in E.match_prefixes(spark.createDataFrame([(p,) for p in probes * 3], "prefix string"), items).collect()}
    want = {}
    for p in probes:
        hits = [i for i, q in enumerate(prompts) if q.startswith(p)]
        if len(hits) == 1:
            want[p] = f"w{hits[0]}"
    assert got == want


def test_decisions_forms(spark, workload):
    log = [
        {"eventType": "_chat_request_event", "event": {"id": "r", "attributes": {"messages": [
            {"role": "user", "content": "one plus one"}, {"role": "assistant", "content": "one plus two"}]}}},
        route("r", "a"), route("r", "b"), route("r", "z", "fallback"), route("lost", "q"),
    ]
    ev = parse(spark, log)
    assert [tuple(r) for r in E.decisions(ev, workload).select("workload_id", "model").collect()] == [("w1", "b")]
    assert [tuple(r) for r in E.decisions(ev, workload, any_role=True).select("workload_id", "model").collect()] == [("w2", "b")]


def test_divergence_of_nothing(spark):
    kind = "workload_id string, model string, decision_ms double"
    one = spark.createDataFrame([("a", "m", 1.0)], kind)
    none = spark.createDataFrame([("b", "m", 1.0)], kind)
    out = recovery.divergence(one, none).first()
    assert (out["decided_pre_kill"], out["replayed_decisions"], out["divergence_rate"], out["diverged_items"]) == (1, 0, None, [])
    moved = spark.createDataFrame([("a", "n", 1.0)], kind)
    out = recovery.divergence(one, moved).first()
    assert (out["diverged"], out["divergence_rate"], out["diverged_items"]) == (1, 1.0, ["a"])
    assert tuple(recovery.fingerprint(one, one).first()) == (1, 1, 1)


def test_files_in_name_order(spark, tmp_path):
    (tmp_path / "b.log").write_text(json.dumps(route("r", "late")) + "\n")
    (tmp_path / "a.log").write_text(json.dumps(route("r", "early")) + "\n\n{oops\n" + json.dumps(route("r", "mid")) + "\n")
    (tmp_path / "c.txt").write_text(json.dumps(route("r", "other")) + "\n")
    rows = E.fold_events(R.read_eventlog(spark, str(tmp_path)), "x").collect()
    assert [(r["request_id"], r["selected_model"]) for r in rows] == [("r", "late")]


def test_empty_results_are_an_error(spark, workload):
    rows = E.results(parse(spark, []), workload, "arm").selectExpr("'run' as run_id", "*")
    with pytest.raises(ValueError):
        writers.write_results(rows, scratch(spark, "empty"))


def test_request_and_answer_files(spark, tmp_path):
    reqs = tmp_path / "r.jsonl"
    reqs.write_text('{"id": "a", "slice": "s", "prompt": "x"}\n\n   \n{"id": "b", "slice": "s"}\n')
    assert sorted((r["id"], r["prompt"]) for r in R.read_requests(spark, str(reqs)).collect()) == [("a", "x"), ("b", "")]
    answers = tmp_path / "a.jsonl"
    answers.write_text('{"id": "a", "answer": "1"}\n{"id": "b", "answer": "2"}\n{"id": "a", "answer": "3"}\n')
    assert sorted((r["id"], r["answer"]) for r in R.read_answers(spark, str(answers)).collect()) == [("a", "3"), ("b", "2")]
    table = tmp_path / "t.csv"
    table.write_text('user_input,toxicity\n"line one\nsays ""hi"", twice",1\nplain,0\n')
    got = R.read_csv(spark, str(table), "user_input string, toxicity int").collect()
    assert sorted(map(tuple, got)) == [('line one\nsays "hi", twice', 1), ("plain", 0)]


def test_texts_are_fetched_after_the_fold(spark, workload):
    """Only numbers and digests are folded; of many replies the winner's answer is found, and rows without one stay."""
    rows = [chat("hot", "one plus one")] + [reply("hot", f"a{i}", promptTokens=i) for i in range(200)] + [chat(f"r{i}", "dup") for i in range(50)] + [reply("lone", "x" * 5000), chat("c", {"truncatedString": "long...", "omittedChars": 9})]
    log = E.FoldedLog(parse(spark, rows), "arm")
    assert not {"answer", "prompt_text"} & set(log.rows.columns)
    plan = log.answers(log.rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # texts meet written rows, and no fold carries them
    got = {r["request_id"]: r for r in E.results(parse(spark, rows), workload, "arm").collect()}
    assert len(got) == 53 and (got["hot"]["answer"], got["hot"]["prompt_tokens"], got["hot"]["workload_id"]) == ("a199", 199, "w1")
    assert len(got["lone"]["answer"]) == 4000 and got["lone"]["workload_id"] is None and got["r7"]["answer"] is None and got["c"]["workload_id"] == "w3"
    folded = {r["request_id"]: r["answer"] for r in E.fold_events(parse(spark, rows), "arm").collect()}
    assert folded == {k: r["answer"] for k, r in got.items()}
