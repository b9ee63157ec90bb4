"""Sources, sinks and event folding."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymeter import fixed
from waymeter.functions import text as X
from waymeter.operators import cost as C
from waymeter.operators import events as E
from waymeter.plans import eventlog as L
from waymeter.plans import views as V
from waymeter.plans.views import sql
from waymeter.session import scratch
from waymeter.sources import readers as R
from waymeter.sources import writers as W
from waymeter.sources.eventtable import EventTable


def _parsed(spark, d):
    return R.parse_events(L.log_lines(spark, d))


def _write_log(lines, path):
    """More ``*.log`` files for a folder. The CSV writer can name its files so; with quoting off it writes lines as they are."""
    ordered = lines.repartitionByRange("pos").sortWithinPartitions("pos").select("value")
    plain = {"extension": "log", "sep": "\x01", "quote": "\x00", "escape": "\x00", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    ordered.write.mode("append").options(**plain).csv(path)


def src_requests(spark, d):
    path = scratch(spark, "requests")
    rows = V.requests(spark, d).select("id", "conversation_id", "slice", F.when(F.col("turn") != 2, F.col("prompt")).alias("prompt"))
    rows.write.json(path)
    return R.read_requests(spark, path)


def src_eventlog(spark, d):
    """The log taken in twice: the second run, after more files have come, reads these alone."""
    folder, lines = scratch(spark, "log"), L.log_lines(spark, d)
    kept = EventTable(spark, scratch(spark, "events"))
    early = F.crc32("value") % 2 == 0
    for part in (early, ~early):
        _write_log(lines.where(part), folder)
        kept.add(folder)
    ev = kept.events()
    rid = F.coalesce("event_id", F.try_variant_get("attributes", "$.request_id", "string"))
    return ev.select("type", "raw_ts", rid.alias("request_id"))


_ISO = "strftime(make_timestamp(({}) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_EVENTS = f"""select '_chat_request_event' as type, {_ISO.format("t0")} as raw_ts, rid as request_id from v_facts
    union all select '_model_routing_event', {_ISO.format("t0")}, rid from v_facts
    union all select '_model_routing_event', {_ISO.format("t0")}, rid from v_facts where conv_id % 6 = 0
    union all select '_model_routing_event', {_ISO.format("t0")}, rid from v_facts where conv_id % 4 = 0
    union all select '_chat_response_event', {_ISO.format("t0 + e2e")}, rid from v_facts where answer is not null"""

CUTOFF = "2024-01-01T01:00:00Z"


def src_cutoff(spark, d):
    ev = R.after(_parsed(spark, d), CUTOFF)
    return ev.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def src_answers(spark, d):
    path = scratch(spark, "answers")
    rows = V.requests(spark, d).select("id", "slice", F.explode(F.array(F.lit("old"), F.length("prompt").cast("string"))).alias("answer"), "conv_id")
    rows = rows.withColumn("rank", (F.col("answer") != "old").cast("int"))
    rows.repartitionByRange("rank", "id").sortWithinPartitions("rank", "id").select("id", "slice", "answer").write.option("compression", "gzip").json(path)
    return R.read_answers(spark, path).select("id", "slice", "answer")


def src_prices(spark, d):
    """The price row of every model billed in the calls table."""
    models = V.calls(spark, d).select(C.model_column().alias("model")).distinct()
    from waymeter.functions.money import priced

    return priced(models, R.read_prices(spark), "model").select("model", "price.input", "price.output")


def src_ledger(spark, d):
    path = scratch(spark, "ledger")
    V.ledger(spark, d).write.json(path)
    return R.read_ledger(spark, path).groupBy("phase", "model").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("ts"), 3).alias("last_ts")
    )


def src_backend_log(spark, d):
    path = scratch(spark, "backend")
    ev = V.table(spark, d, "events")
    rows = ev.select(
        "event_id", F.concat(F.lit("head "), F.col("user_id").cast("string")).alias("prompt_head"),
        F.when(F.col("value") < 35, "small").otherwise("big").alias("model"),
    )
    rows.repartitionByRange("event_id").sortWithinPartitions("event_id").select("prompt_head", "model").write.json(path)
    return R.read_backend_log(spark, path)


def src_csv(spark, d):
    path = scratch(spark, "csv")
    docs = V.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit('said "x",\n'), F.regexp_replace("text", "\r", "")).alias("user_input")
    )
    docs.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    back = R.read_csv(spark, path, "doc_id string, user_input string")
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.encode("user_input", "UTF-8")).alias("digest"))


def src_nested_json(spark, d):
    path = scratch(spark, "nested")
    b = V.table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")
    b = b.select(
        F.col("text").alias("question"),
        F.array("lang", F.lit("b"), F.col("n_chars").cast("string"), F.lit("d")).alias("choices"),
        (F.col("doc_id") % 4).cast("int").alias("answer"),
    )
    b.write.option("compression", "gzip").json(path)
    rows = R.json_lines(spark, path, R.RAW_CHOICE)
    return rows.select(F.md5(F.encode("question", "UTF-8")).alias("digest"), F.array_join("choices", "|").alias("choices"), F.get("choices", F.col("answer")).alias("gold"))


def src_smoke(spark, d):
    """Easy and hard prompts by turns, numbered by event."""
    from waymeter.sources.smoke import smoke_prompt

    return V.table(spark, d, "events").select("event_id", smoke_prompt("event_id").alias("prompt"))


def _graded(spark, d):
    return V.calls(spark, d).withColumns({
        "workload_id": F.col("request_id"), "fallback_attempted": F.lit(None).cast("boolean"),
        "win_rate": F.lit(None).cast("double"), "answer": F.lit(""), "extra": F.lit(1),
    })


def sink_results(spark, d):
    path = scratch(spark, "results")
    W.write_results(_graded(spark, d), path)
    back = spark.read.parquet(path)
    return back.groupBy("run_id", "arm").agg(
        F.count(F.lit(1)).alias("n"), F.sum("prompt_tokens").alias("tokens"), F.count("graded_correct").alias("graded")
    )


def sink_output(spark, d):
    rows = V.turns(spark, d)
    routing = F.when(F.col("conv_id") % 2 == 0, F.lit("big"))
    return W.output_record(rows, "id", "answer", routing)


def sink_index(spark, d):
    path = scratch(spark, "index")
    W.write_index(W.run_index(_graded(spark, d), pos=F.struct("l_orderkey", "l_linenumber")), path)
    return R.read_csv(spark, path, W.INDEX)


def join_events(spark, d):
    rows = E.fold_events(_parsed(spark, d), "log")
    return rows.select(*[c for c in fixed.RESULT_COLUMNS if c not in ("workload_id", "slice")])


def join_workload(spark, d):
    return E.results(_parsed(spark, d), V.requests(spark, d), "log")


def join_prefix(spark, d):
    """Prefixes of many lengths, among prompts with whole copies and shared beginnings."""
    reqs = V.requests(spark, d)
    n = F.col("conv_id") % 40 + 3
    probes = reqs.select(F.col("id").alias("probe"), F.substr("prompt", F.lit(1), n.cast("int")).alias("prompt_text"))
    return E.join_prefix(probes, reqs).select("probe", "workload_id", "slice")


def join_decisions(spark, d):
    return E.decisions(_parsed(spark, d), V.requests(spark, d), any_role=True)


def st_pair(spark, d):
    """Two streams; each request is sent twice and each response three times, and the last of each counts."""
    from waymeter.streaming import replay as S

    f = L.facts(spark, d).select("rid", "t0", "e2e", "turn", "answer")
    at = lambda ms: F.timestamp_millis(ms.cast("long"))
    sent = f.select("rid", "t0", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"))
    sent = sent.select(F.col("rid").alias("request_id"), at(F.col("t0") - 5 * (1 - F.col("pos"))).alias("t_request"), F.col("pos").cast("long").alias("p_request"))
    came = f.where("answer is not null and turn <> 2").select("rid", "t0", "e2e", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("pos"))
    late = F.col("t0") + F.col("e2e") + 7 * (2 - F.col("pos"))  # the last is not the latest
    came = came.select(F.col("rid").alias("request_id"), at(late).alias("t_response"), F.col("pos").cast("long").alias("p_response"))
    a = S.file_stream(spark, S.as_files(sent, ["request_id", "p_request"]), sent.schema)
    b = S.file_stream(spark, S.as_files(came, ["request_id", "p_response"]), came.schema)
    return S.last_pairs(S.run_to_end(S.pair_streams(a, b))).select("request_id", "e2e_ms")


def join_exact_dedup(spark, d):
    from waymeter.operators.sampling import dedup_first

    return dedup_first(V.table(spark, d, "documents"), "text", "doc_id").select("doc_id", "source")


def fn_untruncate(spark, d):
    return V.requests(spark, d).select("id", X.untruncate(F.concat("prompt", F.when(F.col("turn") % 4 == 0, "......").otherwise("..."))).alias("text"))


def fn_ts_ms(spark, d):
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    case = F.col("event_id") % 4
    raw = F.when(case == 0, F.concat(at, F.lit("Z"))).when(case == 1, F.concat(at, F.lit("+02:00"))).when(case == 2, at).otherwise("soon")
    return V.table(spark, d, "events").select("event_id", X.ts_ms(raw).alias("ms"))


def fn_answer_cut(spark, d):
    reply = F.when(F.col("doc_id") % 5 != 0, F.col("text"))
    return V.table(spark, d, "documents").select("doc_id", F.md5(F.encode(X.answer_cut(reply), "UTF-8")).alias("digest"))


_FOLD_COLS = ", ".join(c for c in fixed.RESULT_COLUMNS if c not in ("workload_id", "slice"))

ENTRIES = {
    "src_requests": (src_requests, sql(
        "select id, conversation_id, slice, case when turn <> 2 then prompt else '' end as prompt from v_requests", "v_requests")),
    "src_eventlog": (src_eventlog, sql(_EVENTS, "v_facts")),
    "src_cutoff": (src_cutoff, sql(
        f"select type, count(*) as n from ({_EVENTS}) where raw_ts >= '2024-01-01T01:00:00.000Z' group by 1", "v_facts")),
    "src_prices": (src_prices, sql("select distinct model, rate_in as input, rate_out as output from v_priced", "v_priced")),
    "src_answers": (src_answers, sql("select id, slice, cast(length(prompt) as varchar) as answer from v_requests", "v_requests")),
    "src_ledger": (src_ledger, sql("select phase, model, count(*) as n, round(max(ts), 3) as last_ts from v_ledger group by 1, 2", "v_ledger")),
    "src_backend_log": (src_backend_log, """select 'head ' || user_id as prompt_head,
        case when arg_max(value, event_id) < 35 then 'small' else 'big' end as model from events group by user_id"""),
    "src_csv": (src_csv, "select doc_id, md5('said \"x\",' || chr(10) || replace(text, chr(13), '')) as digest from documents"),
    "src_nested_json": (src_nested_json, """select md5(text) as digest, lang || '|b|' || n_chars || '|d' as choices,
        case doc_id % 4 when 0 then lang when 1 then 'b' when 2 then cast(n_chars as varchar) else 'd' end as gold from documents"""),
    "src_smoke": (src_smoke, """select event_id, case when event_id % 2 = 0 then 'Say hello in five words or fewer. (request ' || event_id || ')'
        else 'Write SQL to count rows in table t' || event_id || '.' end as prompt from events"""),
    "sink_results": (sink_results, sql("""select run_id, arm, count(*) as n, cast(sum(prompt_tokens) as bigint) as tokens,
        count(graded_correct) as graded from v_calls group by 1, 2""", "v_calls")),
    "sink_output": (sink_output, sql("""select id as request_id, case when conv_id % 2 = 0 then 'big' end as model_routing,
        left(coalesce(answer, ''), 80) as answer_head from v_turns""", "v_turns")),
    "sink_index": (sink_index, sql("""select run_id, arg_min(arm, (l_orderkey, l_linenumber)) as arm, count(*) as requests,
        count(graded_correct) as graded, string_agg(distinct nullif(model_name, ''), ';' order by nullif(model_name, '')) as models_seen
        from v_calls group by 1""", "v_calls")),
    "join_events": (join_events, sql(f"select {_FOLD_COLS} from v_folded", "v_folded")),
    "join_workload": (join_workload, sql("select * from v_folded", "v_folded")),
    "join_prefix": (join_prefix, sql("""select p.id as probe, coalesce(max(case when n = 1 then hit end), '') as workload_id,
        coalesce(max(case when n = 1 then sl end), '') as slice from v_requests p left join lateral (
          select count(*) as n, max(q.id) as hit, max(q.slice) as sl from v_requests q
          where starts_with(q.prompt, left(p.prompt, cast(p.conv_id % 40 + 3 as int)))) on true group by 1""", "v_requests")),
    "join_decisions": (join_decisions, sql(f"""select id as workload_id, sel as model, ms as decision_ms from v_facts
        where not cut or length(prompt) <= {V.PREFIX}""", "v_facts")),
    "st_pair": (st_pair, sql("""select rid as request_id, cast(e2e as double) as e2e_ms from v_facts
        where answer is not null and turn <> 2""", "v_facts")),
    "join_exact_dedup": (join_exact_dedup, "select min(doc_id) as doc_id, arg_min(source, doc_id) as source from documents group by text"),
    "fn_untruncate": (fn_untruncate, sql(
        "select id, prompt || case when turn % 4 = 0 then '...' else '' end as text from v_requests", "v_requests")),
    "fn_ts_ms": (fn_ts_ms, """select event_id, case event_id % 4 when 0 then floor(epoch_us(ts) / 1000) when 1 then floor(epoch_us(ts) / 1000) - 7200000.0::double
        when 2 then floor(epoch_us(ts) / 1000) end as ms from events"""),
    "fn_answer_cut": (fn_answer_cut, "select doc_id, md5(left(case when doc_id % 5 <> 0 then text else '' end, 4000)) as digest from documents"),
}
