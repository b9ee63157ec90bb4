"""Streaming operators, each run to its end over a whole table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymeter import fixed
from waymeter.functions.text import content_key, draw
from waymeter.operators import policies as P
from waymeter.plans import views as V
from waymeter.plans.views import sql
from waymeter.session import scratch
from waymeter.streaming import batcher as B
from waymeter.streaming import durable as D
from waymeter.streaming import handlers as H
from waymeter.streaming import replay as R

LANES, N, TIMEOUT_MS = 64, 20, 3000
LANE_ROWS = 160  # events for which there is a lane where lanes grow with the table
STEP = 1 << 19  # rows of a micro-batch, or more where there are many lanes
ROUND = 16  # rows that a micro-batch brings a lane, at least: what lanes carry on is written again with each


def _finish(stream, rows):
    """Run a stream without an end of its own until all input is out."""
    spark = stream.sparkSession
    path = scratch(spark, "sink")
    query = R.start_table(stream, path, scratch(spark, "state"), available_now=False)
    return R.drain(query, path, rows)


def src_replay(spark, d):
    rows = V.requests(spark, d).select("id", "slice", "prompt", "conv_id", "turn")
    stream = R.replay(rows, ["conv_id", "turn"], rate=100_000)
    return _finish(stream, rows.count()).select("id", "slice", "prompt")


def _request_files(spark, d):
    rows = V.requests(spark, d).select("id", "slice", "prompt")
    return R.file_stream(spark, R.as_files(rows, ["id"]), "id string, slice string, prompt string")


def st_fanout(spark, d):
    """Both forms: dealt evenly nothing is lost, and with a key all rows of a key meet in one task."""
    even = R.run_to_end(R.fanout(_request_files(spark, d), R.width(spark)))
    keyed = R.fanout(_request_files(spark, d), R.width(spark), "slice")
    keyed = R.run_to_end(keyed.withColumn("task", F.spark_partition_id()))
    tasks = keyed.groupBy("slice").agg(F.count_distinct("task").alias("tasks"), F.count(F.lit(1)).alias("keyed_rows"))
    return even.groupBy("slice").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids")).join(tasks, "slice")


def _batched(spark, d, lanes=None, timer_ms=None):
    """Micro-batches in the order of events. Lanes are users, dealt to ``lanes`` or to as many as the table's size asks for."""
    events = V.table(spark, d, "events")
    step = STEP
    if lanes is None:
        lanes = max(1, events.count() // LANE_ROWS)
        step = max(STEP, lanes * ROUND)
    rows = events.select(
        (F.col("user_id") % lanes).alias("lane"), F.col("event_id").cast("string").alias("id"),
        F.concat_ws(" ", "event_type", "props").alias("prompt"), F.col("event_id").alias("seq"),
    )
    return B.run_lanes(rows, N, step, timer_ms=timer_ms)


def st_batcher(spark, d):
    """Window membership, place, size and the reason for closing, of every request: a fixed number of lanes, whose tails wait for their timers."""
    return _batched(spark, d, LANES, TIMEOUT_MS).select("lane", "wid", "at", "id", "batch", "closed_by")


def st_end_flush(spark, d):
    """Every request comes out exactly once, tails included, and in the order it was sent."""
    out = _batched(spark, d)
    before = F.lag("seq").over(Window.partitionBy("lane", "wid").orderBy("at"))
    return out.select("id", "lane", (F.col("batch") < N).alias("tail"), F.coalesce(F.col("seq") > before, F.lit(True)).alias("in_order"))


REPLIES = ['{"choices": ["big", "big", "small", "big", "big"]}', '{"choices": ["big", "small"]}', '{"choices": ["big"', '{"other": 1}']


def sink_batches(spark, d):
    """The windowed routing job: requests to windows, prompts and verdicts to the batch log, written and read back."""
    batched = _batched(spark, d)
    k = F.col("wid") % len(REPLIES)
    replies = batched.where("at = 0").select(
        "lane", "wid", F.element_at(F.array(*map(F.lit, REPLIES)), k.cast("int") + 1).alias("reply"), (k * 1.5 + 2).cast("double").alias("judge_ms"),
        (F.col("batch") * 10).cast("long").alias("judge_prompt_tokens"), F.lit(12).cast("long").alias("judge_completion_tokens"),
    )
    log = B.batch_log(batched, replies).select(*B.LOG, "lane", "wid", "at", "id", F.length("judge_prompt").alias("prompt_chars"))
    path = scratch(spark, "batches")
    log.write.json(path)
    back = spark.read.schema(log.schema).json(path)
    # Waits depend on the clock: only their bounds can be compared.
    return back.withColumn("waited", (F.col("wait_ms") >= 0) & (F.col("wait_ms") < 3_600_000)).drop("wait_ms")


def durable_decision(spark, d):
    """Two batches: contents of the first keep its decision when the second brings them again."""
    store = scratch(spark, "decisions")
    reqs = V.requests(spark, d).select("id", "prompt", "conv_id")

    def decider(seed):
        policy = P.coin(0.5, seed)
        return lambda df: df.withColumn("model", policy(F.col("prompt"))["selected"]).withColumn("decision_ms", F.length("prompt") * 1.0 + seed * 0.5)

    D.durable_table(reqs.where("conv_id % 2 = 0"), store, "b1", decider(1))
    out = D.durable_table(reqs, store, "b2", decider(2))
    return out.select("id", "model", "decision_ms", "replayed")


def udf_stateful(spark, d):
    """One decision per content: the second run of the stream proposes others, and the first run's stay."""
    rows = V.table(spark, d, "events").select(
        content_key(F.col("user_id").cast("string")).alias("content"), F.col("event_id").cast("string").alias("id"), "event_id",
        F.when(F.col("user_id") % 3 == 0, "small").otherwise("big").alias("first"), (F.col("user_id") % 10 + 0.5).cast("double").alias("ms"),
    )
    folder, state, path = scratch(spark, "in"), scratch(spark, "state"), scratch(spark, "sink")
    odd = F.col("event_id") % 2 == 1
    for part, model, ms in ((~odd, F.col("first"), F.col("ms")), (odd, F.lit("other"), F.lit(-1.0))):
        rows.where(part).select("content", "id", model.alias("model"), ms.alias("decision_ms")).write.mode("append").parquet(folder)
        out = D.keyed_answers(spark, folder, D.PROPOSAL, path, state)
    return out.select("content", "id", "model", "decision_ms")


def udf_policy(spark, d):
    """A model-backed policy: scores from a Python model, thresholded in columns."""

    def setup():
        return lambda texts: texts.str.len() % 100 / 100.0

    scored = H.model_policy(V.requests(spark, d).select("id", "prompt"), setup)
    out = P.decide(scored, "prompt", P.score_threshold("score", 0.6))
    return out.select("id", "score", "decision.selected")


def udf_events(spark, d):
    """Input and response handlers as two maps around the decision, run as a stream."""
    rows = V.turns(spark, d).select(F.col("id").alias("request_id"), "prompt", "answer")
    folder = R.as_files(rows, ["request_id"])
    stream = R.file_stream(spark, folder, "request_id string, prompt string, answer string")
    chats = H.on_input(stream, P.hash_split(50))
    return R.run_to_end(chats.select("request_id", "selected_model", "decision_source", F.substring(F.coalesce("answer", F.lit("")), 1, 80).alias("answer_head")))


def udf_meter(spark, d):
    df = V.long_words(V.requests(spark, d))
    df = df.withColumns({"out": F.lit(2), "ms": draw("prompt", 4)})
    df = H.metered(P.decide(df, "prompt", P.hash_split(50)), "prompt_words", "out", "ms")
    return df.select("id", "decision.selected", "decision.meter.judge_prompt_tokens", "decision.meter.judge_completion_tokens",
                     F.round("decision.meter.decision_ms", 6).alias("decision_ms"))


_SPLIT = f"case when {V.sql_bucket('prompt')} < 50 then 'big' else 'small' end"
_DEALT = f"(select greatest(1, count(*) // {LANE_ROWS}) from events)"


def _placed(lanes):
    return f"""(select *, count(*) over (partition by lane, wid)::int as batch from (
    select *, (rn - 1) // {N} as wid, cast((rn - 1) % {N} as int) as "at" from (
    select *, row_number() over (partition by lane order by cast(id as bigint)) as rn from (
      select user_id % {lanes} as lane, cast(event_id as varchar) as id, event_type || ' ' || props as prompt from events))))"""


_PLACED = _placed(_DEALT)

ENTRIES = {
    "src_replay": (src_replay, sql("select id, slice, prompt from v_requests", "v_requests")),
    "st_fanout": (st_fanout, sql("""select slice, count(*) as rows, count(distinct id) as ids, 1::bigint as tasks, count(*) as keyed_rows
        from v_requests group by 1""", "v_requests")),
    "st_batcher": (st_batcher, f"""select lane, wid, "at", id, batch, case when batch = {N} then 'size' else 'time' end as closed_by from {_placed(LANES)}"""),
    "st_end_flush": (st_end_flush, f"select id, lane, batch < {N} as tail, true as in_order from {_PLACED}"),
    "sink_batches": (sink_batches, f"""select lane, wid, "at", id, left(prompt, 60) as prompt_head, batch, (wid % 4) * 1.5::double + 2 as judge_ms,
        batch * 10::bigint as judge_prompt_tokens, 12::bigint as judge_completion_tokens, wid % 4 = 2 as parse_failed, true as waited,
        case when wid % 4 = 0 and "at" in (0, 1, 3, 4) or wid % 4 = 1 and "at" = 0 then 'big' else 'small' end as model,
        cast(sum(length('--- request ' || ("at" + 1) || ' ---') + 2 + least(length(prompt), {fixed.WINDOW_REQUEST_CHARS})) over (partition by lane, wid)
          + {len(fixed.WINDOW_HEAD) + len(fixed.WINDOW_TAIL)} + length(batch::varchar) as int) as prompt_chars from {_PLACED}"""),
    "st_durable_decision": (durable_decision, sql(f"""select id, case when {V.sql_draw('prompt', 1)} < 0.5 and conv_id % 2 = 0
        or {V.sql_draw('prompt', 2)} < 0.5 and conv_id % 2 <> 0 then 'big' else 'small' end as model,
        (length(prompt) + case when conv_id % 2 = 0 then 0.5 else 1.0 end)::double as decision_ms, conv_id % 2 = 0 as replayed from v_requests""", "v_requests")),
    "udf_stateful": (udf_stateful, """select sha256(cast(user_id as varchar)) as content, cast(event_id as varchar) as id,
        case when first_even is null then 'other' when user_id % 3 = 0 then 'small' else 'big' end as model,
        (case when first_even is null then -1.0 else user_id % 10 + 0.5 end)::double as decision_ms
        from (select *, min(event_id) filter (event_id % 2 = 0) over (partition by user_id) as first_even from events)"""),
    "udf_policy": (udf_policy, sql("""select id, length(prompt) % 100 / 100.0::double as score,
        case when length(prompt) % 100 >= 60 then 'big' else 'small' end as selected from v_requests""", "v_requests")),
    "udf_events": (udf_events, sql(f"""select id as request_id, {_SPLIT} as selected_model, 'strategy' as decision_source,
        left(coalesce(answer, ''), 80) as answer_head from v_turns""", "v_turns")),
    "udf_meter": (udf_meter, sql(f"""select id, {_SPLIT} as selected, {V.sql_words("prompt")} as judge_prompt_tokens, 2 as judge_completion_tokens,
        round({V.sql_draw('prompt', 4)}, 6) as decision_ms from v_requests""", "v_requests")),
}
