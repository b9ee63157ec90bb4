"""Count-or-time windows over events and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymeter import fixed
from waymeter.operators import stats as S
from waymeter.operators import windows as W
from waymeter.plans import views as V
from waymeter.plans.views import sql, windowed

REPLIES = ['{"choices": ["big", "big", "small", "big", "big"]}', '{"choices": ["big", "small"]}', '{"choices": ["big"',
           '{"other": 1}', '{"choices": ["BIG", 3, "big"]}']
WINDOW = 5


def _batched(spark, d):
    a = V.arrivals(spark, d)
    return W.window_facts(W.micro_batch_table(a, "lane", "us", "event_id", V.N, V.TIMEOUT_US), V.N, V.TIMEOUT_US)


_CLOSED = f"(case when batch >= {V.N} then last_us else opened + {V.TIMEOUT_US} end)"


def batcher_table(spark, d):
    return _batched(spark, d).select(F.col("id").alias("event_id"), "lane", "wid", "at", "batch", F.col("wait").alias("wait_us"))


def count_window(spark, d):
    out = W.count_window(V.arrivals(spark, d), "lane", ["us", "event_id"], V.N)
    return out.select("event_id", "lane", "wid", "at")


def lanes(spark, d):
    return W.lanes(V.requests(spark, d), "prompt", 8).select("id", "lane")


def _windows(spark, d):
    rows = V.requests(spark, d).withColumn("lane", F.col("conv_id") % V.LANES)
    return W.gather(W.count_window(rows, "lane", ["conv_id", "turn"], WINDOW), "prompt")


_PLACED = f"""(select *, (rn - 1) // {WINDOW} as wid, (rn - 1) % {WINDOW} as "at" from (select *, conv_id % {V.LANES} as lane,
    row_number() over (partition by conv_id % {V.LANES} order by conv_id, turn) as rn from v_requests))"""


def batch_prompt(spark, d):
    out = W.batch_prompt(_windows(spark, d))
    return out.select("lane", "wid", F.md5(F.encode("judge_prompt", "UTF-8")).alias("digest"))


def batch_verdicts(spark, d):
    reply = F.element_at(F.array(*[F.lit(r) for r in REPLIES]), (F.col("wid") % len(REPLIES) + 1).cast("int"))
    return W.batch_verdicts(_windows(spark, d), reply).select("id", "lane", "wid", "at", "model", "parse_failed", "batch")


def _judged(spark, d):
    """Window rows with made judge figures that repeat on each row of a window."""
    return _batched(spark, d).select(
        "id", "lane", "batch", (F.lit(100.0) + F.col("batch") * 10).alias("judge_ms"), F.col("wait").alias("wait_ms"),
        (F.col("batch") * 50).alias("judge_prompt_tokens"), (F.col("wid") % 7).alias("judge_completion_tokens"),
        (F.col("wid") % 10 == 0).alias("parse_failed"), F.when(F.col("id") % 3 == 0, "big").otherwise("small").alias("model"),
        F.lit(V.N).alias("n"), (F.col("lane") + 1).alias("rate"),
    )


_JUDGED = f"""(select event_id as id, lane, batch, 100.0 + batch * 10 as judge_ms, {_CLOSED} - us as wait_ms, batch * 50 as tin, wid % 7 as tout,
    wid % 10 = 0 as failed, event_id % 3 = 0 as big, {V.N} as n, lane + 1 as rate from batched)"""


def amortise(spark, d):
    out = W.amortise(_judged(spark, d))
    return out.select("id", F.round("judge_ms_share", 6).alias("judge_ms_share"), F.round("judge_tokens_share", 6).alias("judge_tokens_share"))


def batch_stats(spark, d):
    out = S.batch_stats(_judged(spark, d))
    return out.select("n", "rate", "requests", *[
        F.round(c, 6).alias(c) for c in ("windows", "tokens_per_request", "judge_s", "parse_failed_share", "escalated_share", "wait_p50", "wait_p95")
    ])


def fill_model(spark, d):
    measured = _judged(spark, d).groupBy("n", "rate").agg((F.avg("wait_ms") / 1e6).alias("wait_s"))
    return S.fill_model(measured).select("n", "rate", *[F.round(c, 6).alias(c) for c in ("wait_s", "model_wait_s", "gap_s")])


_HEAD = "'" + fixed.WINDOW_HEAD.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
_TAIL = "'" + fixed.WINDOW_TAIL.replace("\n", "' || chr(10) || '") + "'"
_REPLY = "case wid % 5 " + " ".join(f"when {i} then '{r}'" for i, r in enumerate(REPLIES)) + " end"

ENTRIES = {
    "st_batcher_table": (batcher_table, windowed(f"""select event_id, lane, cast(wid as bigint) as wid, "at", batch, {_CLOSED} - us as wait_us from batched""")),
    "st_count_window": (count_window, f"""select event_id, lane, (rn - 1) // {V.N} as wid, (rn - 1) % {V.N} as "at" from (select event_id, user_id % {V.LANES} as lane,
        row_number() over (partition by user_id % {V.LANES} order by ts, event_id) as rn from events)"""),
    "st_lanes": (lanes, sql(f"select id, cast(floor({V.sql_draw('prompt', 'lane')} * 8) as bigint) as lane from v_requests", "v_requests")),
    "st_batch_prompt": (batch_prompt, sql(f"""select lane, wid, md5({_HEAD} || count(*) || {_TAIL} || string_agg('--- request ' || ("at" + 1) || ' ---' || chr(10)
        || left(prompt, 500) || chr(10), '' order by "at")) as digest from {_PLACED} group by 1, 2""", "v_requests")),
    "st_batch_verdicts": (batch_verdicts, sql(f"""select id, lane, wid, "at", case when json_valid(reply) and
          json_extract_string(reply, '$.choices[' || "at" || ']') in ('small', 'big') then json_extract_string(reply, '$.choices[' || "at" || ']') else 'small' end as model,
        not json_valid(reply) as parse_failed, cast(batch as int) as batch from (select *, {_REPLY} as reply,
          count(*) over (partition by lane, wid) as batch from {_PLACED})""", "v_requests")),
    "st_amortise": (amortise, windowed(f"""select id, round(judge_ms / batch, 6)::double as judge_ms_share, round((tin + tout) / batch, 6) as judge_tokens_share from {_JUDGED}""")),
    "agg_batch_stats": (batch_stats, windowed(f"""select n, rate, count(*) as requests, round(sum(1.0::double / batch), 6) as windows,
        round(avg((tin + tout) / batch), 6) as tokens_per_request, round(sum(judge_ms::double / batch) / sum(1.0::double / batch) / 1000, 6) as judge_s,
        round(avg(cast(failed as int)), 6) as parse_failed_share, round(avg(cast(big as int)), 6) as escalated_share,
        round(quantile_cont(wait_ms::double, 0.5), 6) as wait_p50, round(quantile_cont(wait_ms::double, 0.95), 6) as wait_p95 from {_JUDGED} group by 1, 2""")),
    "agg_fill_model": (fill_model, windowed(f"""select n, rate, round(w, 6) as wait_s, round(n / (2.0::double * rate), 6) as model_wait_s,
        round(w - n / (2.0::double * rate), 6) as gap_s from (select n, rate, avg(wait_ms) / 1e6 as w from {_JUDGED} group by 1, 2)""")),
}
