"""An event log rendered from the conversations table, and what folding it must give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymeter.functions.text import bucket, words
from waymeter.plans import views as V

START_S = 1704067200  # 2024-01-01T00:00:00Z


def _iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """Per request everything the log will say."""
    big = bucket("prompt") < 50
    return V.turns(spark, folder).select(
        "*",
        F.concat(F.lit("r"), F.col("id")).alias("rid"),
        ((F.lit(START_S) + F.col("conv_id") * 100 + F.col("turn")) * 1000).cast("long").alias("t0"),
        F.length("answer").cast("long").alias("e2e"),
        F.when(big, "big").otherwise("small").alias("sel"),
        F.when(big, V.BIG_MODEL).otherwise(V.SMALL_MODEL).alias("name"),
        (F.length("prompt") % 50 / 10.0).alias("ms"),
        words("prompt").alias("n_in"),
        words("answer").alias("n_out"),
    )


def _wrapped(kind: str, at: Column, event: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("eventType"), _iso(at).alias("timestamp"), event.alias("event")))


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``value, pos``: requests (some truncated, some unwrapped), decisions (some superseded, some
    fallbacks), replies, blank and broken lines."""
    f = facts(spark, folder)
    cut = F.col("conv_id") % 5 == 0

    def chat(content: Column, wrapped: bool) -> Column:
        msgs = F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))
        attrs = F.struct(msgs.alias("messages")).alias("attributes")
        if wrapped:
            return _wrapped("_chat_request_event", F.col("t0"), F.struct(F.col("rid").alias("id"), attrs))
        return F.to_json(F.struct(
            F.lit("_chat_request_event").alias("type"), F.col("rid").alias("id"), _iso(F.col("t0")).alias("timestamp"), attrs
        ))

    short = F.struct(
        F.concat(F.substring("prompt", 1, V.PREFIX), F.lit("...")).alias("truncatedString"),
        (F.length("prompt") - V.PREFIX).alias("omittedChars"),
    )
    request = F.when(cut, chat(short, True)).when(F.col("conv_id") % 7 == 0, chat(F.col("prompt"), False)).otherwise(
        chat(F.col("prompt"), True)
    )

    def route(model: Column, source: str, ms: Column) -> Column:
        meta = F.when(F.col("turn") % 4 == 0, F.struct(
            F.length("prompt").alias("judge_prompt_tokens"), F.lit(12).alias("judge_completion_tokens")
        ))
        score = F.when(F.col("conv_id") % 2 == 0, bucket("prompt") / 100.0)
        return _wrapped("_model_routing_event", F.col("t0"), F.struct(F.struct(
            F.col("rid").alias("request_id"), F.lit(source).alias("decision_source"), model.alias("selected_model"),
            ms.alias("decision_ms"), score.alias("score"), meta.alias("metadata"),
        ).alias("attributes")))

    old = F.when(F.col("conv_id") % 6 == 0, route(F.lit("stale"), "strategy", F.lit(9.9)))
    new = route(F.col("sel"), "strategy", F.col("ms"))
    fell = F.when(F.col("conv_id") % 4 == 0, route(F.lit("backup"), "fallback", F.lit(0.0)))
    final = F.when(F.col("conv_id") % 3 == 0, F.struct(F.concat(F.lit("final-"), F.col("sel")).alias("final_model")))
    extra = F.struct(
        F.col("n_in").alias("promptTokens"), F.col("n_out").alias("completionTokens"),
        F.col("name").alias("model_name"), final.alias("model_routing"),
    )
    reply = F.when(F.col("answer").isNotNull(), _wrapped(
        "_chat_response_event", F.col("t0") + F.col("e2e"),
        F.struct(F.struct(
            F.col("rid").alias("request_id"),
            F.struct(F.col("answer").alias("content"), extra.alias("extra_args")).alias("response"),
        ).alias("attributes")),
    ))
    broken = F.when(F.col("conv_id") % 3 == 1, F.concat(F.lit('{"eventType": "_chat_request_event", "id": "'), F.col("rid")))
    lines = F.array(request, old, new, broken, fell, F.when(F.col("turn") == 0, F.lit("  ")), reply)
    out = f.select(
        "conv_id", "turn", F.posexplode(lines).alias("k", "value")
    ).where("value is not null")
    return out.select("value", (F.col("conv_id") * 10000 + F.col("turn") * 10 + F.col("k")).alias("pos"))


V.SQL["v_facts"] = f"""select *, 'r' || id as rid, cast(({START_S} + conv_id * 100 + turn) * 1000 as bigint) as t0,
    cast(length(answer) as bigint) as e2e, case when {V.sql_bucket("prompt")} < 50 then 'big' else 'small' end as sel,
    {V.sql_bucket("prompt")} as b, case when {V.sql_bucket("prompt")} < 50 then '{V.BIG_MODEL}' else '{V.SMALL_MODEL}' end as name,
    length(prompt) % 50 / 10.0::double as ms, {V.sql_words("prompt")} as n_in, {V.sql_words("answer")} as n_out,
    conv_id % 5 = 0 as cut from v_turns"""
V.SQL["v_matched"] = f"""select f.*, case when not cut then f.id
    when (select count(*) from v_requests q where starts_with(q.prompt, left(f.prompt, {V.PREFIX}))) = 1 then f.id else '' end as wid
    from v_facts f"""
V.SQL["v_folded"] = """select rid as request_id, wid as workload_id, case when wid = '' then '' else slice end as slice, 'log' as arm,
    sel as selected_model,
    case when answer is not null and conv_id % 3 = 0 then 'final-' || sel when conv_id % 4 = 0 then 'backup' else sel end as final_model,
    'strategy' as decision_source, ms as decision_ms, case when conv_id % 4 = 0 then true end as fallback_attempted,
    case when turn % 4 = 0 then cast(length(prompt) as bigint) end as judge_prompt_tokens,
    case when turn % 4 = 0 then cast(12 as bigint) end as judge_completion_tokens,
    case when conv_id % 2 = 0 then b / 100.0::double end as win_rate,
    case when answer is not null then n_in end as prompt_tokens, case when answer is not null then n_out end as completion_tokens,
    case when answer is not null then name end as model_name, cast(e2e as double) as e2e_ms, left(answer, 4000) as answer
    from v_matched"""
V.NEEDS |= {"v_facts": ["v_turns"], "v_matched": ["v_facts"], "v_folded": ["v_matched"]}
