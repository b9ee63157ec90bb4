"""Views over the driver tables, written once in Spark and once as SQL text.

They stand for requests, replies, graded calls, predictions and ledgers, so that every operator
runs over whole tables that grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymeter import fixed
from waymeter.functions.text import bucket, sha1_key, words
from waymeter.session import prepare

CUT = "2024-01-16 00:00:00"
CUT_S = 1705363200.0
SMALL_MODEL = "gpt-4o-mini-2024-07-18"
BIG_MODEL = "gpt-4o-2024-08-06"
ARMS = {"nano": 85, "mini": 80, "big": 70}
SEEDS = [1, 2, 3]
PREFIX = 40
# Portable word edges: \b treats accented letters differently between regex engines.
WORD = "(^|[^0-9A-Za-z_])({})([^0-9A-Za-z_]|$)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def micros(ts: str) -> Column:
    """Whole microseconds since 1970 of a zone-less timestamp (session zone is UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


# ---- requests and replies -------------------------------------------------------------------


def requests(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("turn")
    return table(spark, folder, "conversations").where("role = 'user'").select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), t.cast("string")).alias("id"),
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.when(t % 3 == 0, "gsm8k").when(t % 3 == 1, "mmlu").otherwise("humaneval").alias("slice"),
        F.col("text").alias("prompt"),
        "conv_id",
        "turn",
    )


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Requests with the reply that follows directly, if any."""
    said = table(spark, folder, "conversations").where("role = 'assistant'")
    said = said.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return requests(spark, folder).join(said, ["conv_id", "turn"], "left")


def sql_words(x: str) -> str:
    return rf"cast(len(regexp_extract_all({x}, '[^ \n\t\r]+')) as bigint)"


def sql_u4(x: str) -> str:
    return f"cast('0x' || substr(sha1({x}), 1, 4) as bigint)"


def sql_bucket(x: str) -> str:
    u = sql_u4(x)
    return f"(((case when {u} >= 32768 then {u} - 65536 else {u} end) % 100 + 100) % 100)"


def sql_draw(x: str, seed: int, at: int = 1) -> str:
    return f"(cast('0x' || substr(sha1({x} || '|{seed}'), {at}, 7) as bigint) / 268435456.0)"


SQL = {
    "v_requests": """select conv_id || '-' || turn as id, cast(conv_id as varchar) as conversation_id,
        case turn % 3 when 0 then 'gsm8k' when 1 then 'mmlu' else 'humaneval' end as slice,
        text as prompt, conv_id, turn from conversations where role = 'user'""",
    "v_turns": """select r.*, a.text as answer from v_requests r left join conversations a
        on a.role = 'assistant' and a.conv_id = r.conv_id and a.turn = r.turn + 1""",
}
NEEDS = {"v_turns": ["v_requests"]}

# ---- one graded, priced call per line item ---------------------------------------------------


def calls(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    model = (
        F.when(F.col("l_linestatus") == "O", SMALL_MODEL)
        .when(F.col("l_suppkey") % 3 == 0, BIG_MODEL)
        .when(F.col("l_suppkey") % 3 == 1, "claude-haiku-4-5")
        .otherwise("local-model")
    )
    judged = F.col("l_linenumber") == 1
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("request_id"),
        F.col("l_returnflag").alias("arm"),
        F.concat(F.lit("run-"), F.year("l_shipdate").cast("string")).alias("run_id"),
        F.when(F.col("l_suppkey") % 4 == 0, "mmlu").otherwise("gsm8k").alias("slice"),
        F.when(F.col("l_linenumber") == 7, None).when(F.col("l_linenumber") == 6, "").otherwise(model).alias("model_name"),
        model.alias("final_model"),
        F.when(F.col("l_suppkey") % 2 == 0, "small").otherwise("big").alias("selected_model"),
        F.when(F.col("l_partkey") % 50 != 0, (F.col("l_quantity") * 10).cast("long")).alias("prompt_tokens"),
        (F.col("l_suppkey") % 300).cast("long").alias("completion_tokens"),
        F.when(judged, F.lit(200)).cast("long").alias("judge_prompt_tokens"),
        F.when(judged, F.lit(12)).cast("long").alias("judge_completion_tokens"),
        F.when(F.col("l_partkey") % 10 != 0, (F.col("l_orderkey") % 4 != 0).cast("int")).alias("graded_correct"),
        (F.col("l_discount") * 100 + F.col("l_tax")).alias("decision_ms"),
        (F.col("l_extendedprice") / 100).alias("e2e_ms"),
        F.when(F.col("l_partkey") % 5 != 0, F.lit("strategy")).alias("decision_source"),
        "l_orderkey",
        "l_linenumber",
    )


_MODEL = f"""case when l_linestatus = 'O' then '{SMALL_MODEL}' when l_suppkey % 3 = 0 then '{BIG_MODEL}'
        when l_suppkey % 3 = 1 then 'claude-haiku-4-5' else 'local-model' end"""
SQL["v_calls"] = f"""select l_orderkey || '-' || l_linenumber as request_id, l_returnflag as arm,
        'run-' || year(l_shipdate) as run_id, case when l_suppkey % 4 = 0 then 'mmlu' else 'gsm8k' end as slice,
        case when l_linenumber = 7 then null when l_linenumber = 6 then '' else {_MODEL} end as model_name,
        {_MODEL} as final_model, case when l_suppkey % 2 = 0 then 'small' else 'big' end as selected_model,
        case when l_partkey % 50 <> 0 then cast(l_quantity * 10 as bigint) end as prompt_tokens,
        cast(l_suppkey % 300 as bigint) as completion_tokens,
        case when l_linenumber = 1 then 200 end as judge_prompt_tokens,
        case when l_linenumber = 1 then 12 end as judge_completion_tokens,
        case when l_partkey % 10 <> 0 then cast(l_orderkey % 4 <> 0 as int) end as graded_correct,
        l_discount * 100 + l_tax as decision_ms, l_extendedprice / 100 as e2e_ms,
        case when l_partkey % 5 <> 0 then 'strategy' end as decision_source, l_orderkey, l_linenumber
        from lineitem"""
SQL["v_prices"] = "select * from (values " + ", ".join(
    f"('{m}', {i}::double, {o}::double)" for m, i, o in fixed.PRICES
) + ") as p(model, input, output)"
SQL["v_priced"] = """select c.*, coalesce(nullif(model_name, ''), nullif(final_model, ''), '') as model,
        coalesce((select arg_max(p.input, length(p.model)) from v_prices p where p.model <> 'default'
          and starts_with(coalesce(nullif(model_name, ''), nullif(final_model, ''), ''), p.model)), 0.0) as rate_in,
        coalesce((select arg_max(p.output, length(p.model)) from v_prices p where p.model <> 'default'
          and starts_with(coalesce(nullif(model_name, ''), nullif(final_model, ''), ''), p.model)), 0.0) as rate_out
        from v_calls c"""
SQL["v_usd"] = """select *, coalesce(prompt_tokens, 0) / 1e6 * rate_in + coalesce(completion_tokens, 0) / 1e6 * rate_out as call_usd,
        coalesce(judge_prompt_tokens, 0) / 1e6 * 0.15 + coalesce(judge_completion_tokens, 0) / 1e6 * 0.60 as judge_usd
        from v_priced"""
NEEDS |= {"v_priced": ["v_calls", "v_prices"], "v_usd": ["v_priced"]}

# ---- predictions of three arms over three seeds ----------------------------------------------


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "n_chars", "lang")
    rows = table(spark, folder, "labels").join(docs, "doc_id")
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(t).alias("thr")) for a, t in ARMS.items()])
    rows = rows.select("*", F.explode(arms).alias("a")).select("*", "a.arm", "a.thr")
    rows = rows.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
    draw = bucket(F.concat_ws("|", F.col("doc_id").cast("string"), "arm", F.col("seed").cast("string")))
    hit = draw < F.col("thr") - F.when(F.col("n_chars") > 3000, 15).otherwise(0)
    gold = F.col("toxic").cast("int")
    return rows.select(
        F.col("doc_id").alias("item"), "arm", "seed", "lang", "n_chars", gold.alias("gold"),
        F.when(hit, gold).otherwise(1 - gold).alias("pred"), hit.cast("int").alias("correct"),
    )


_HIT = f"""({sql_bucket("cast(doc_id as varchar) || '|' || arm || '|' || cast(seed as varchar)")}
        < thr - case when n_chars > 3000 then 15 else 0 end)"""
SQL["v_pred"] = f"""select doc_id as item, arm, seed, lang, n_chars, cast(toxic as int) as gold,
        cast(case when {_HIT} then toxic else 1 - toxic end as int) as pred, cast({_HIT} as int) as correct
        from labels join (select doc_id, n_chars, lang from documents) using (doc_id)
        cross join (values {", ".join(f"('{a}', {t})" for a, t in ARMS.items())}) as a(arm, thr)
        cross join (values {", ".join(f"({s})" for s in SEEDS)}) as s(seed)"""

# ---- invocation ledger and decisions on both sides of a cut ----------------------------------


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        (micros("ts") / 1e6).alias("ts"),
        F.when(kind == "purchase", "resp").when(kind == "error", "resp_err").otherwise("recv").alias("phase"),
        F.when(F.col("value") < 35, "small").otherwise("big").alias("model"),
        sha1_key(F.col("user_id").cast("string")).alias("prompt_sha1"),
    )


def side(spark: SparkSession, folder: str, before: bool) -> DataFrame:
    """Last decision of each user on one side of the cut."""
    ev = table(spark, folder, "events")
    cut = F.lit(CUT).cast("timestamp_ntz")
    ev = ev.where(F.col("ts") <= cut if before else F.col("ts") > cut)
    last = F.max_by(F.struct("value"), F.struct("ts", "event_id"))["value"]
    return ev.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("workload_id")).agg(
        F.when(last < 35, "small").otherwise("big").alias("model"), F.floor(last).cast("double").alias("decision_ms")
    )


SQL["v_ledger"] = """select epoch_us(ts) / 1e6 as ts, case event_type when 'purchase' then 'resp' when 'error' then 'resp_err'
        else 'recv' end as phase, case when value < 35 then 'small' else 'big' end as model,
        sha1(cast(user_id as varchar)) as prompt_sha1 from events"""
for _name, _op in (("v_pre", "<="), ("v_post", ">")):
    SQL[_name] = f"""select 'u' || user_id as workload_id, case when v < 35 then 'small' else 'big' end as model,
        cast(floor(v) as double) as decision_ms from (select user_id, arg_max(value, (ts, event_id)) as v from events
        where ts {_op} timestamp '{CUT}' group by user_id)"""
SQL["v_both"] = """select a.workload_id, a.model as pre_model, b.model as post_model, a.decision_ms as pre_ms,
        b.decision_ms as post_ms from v_pre a join v_post b using (workload_id)"""
SQL["v_sets"] = f"""select prompt_sha1, count(*) filter (phase = 'recv') as recv,
        count(*) filter (phase = 'resp' and ts <= {CUT_S}) as resp_before,
        count(*) filter (phase = 'resp' and ts > {CUT_S}) as resp_after,
        count(*) filter (phase = 'resp_err') as broken from v_ledger group by 1"""
NEEDS |= {"v_both": ["v_pre", "v_post"], "v_sets": ["v_ledger"]}

# ---- arrivals and their windows --------------------------------------------------------------

LANES, N, TIMEOUT_US = 4, 20, 4 * 3600 * 1_000_000


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        (F.col("user_id") % LANES).alias("lane"), "event_id", micros("ts").alias("us"), "value", "event_type"
    )


# Jumps from window start to window start within a lane.
WINDOWS = f"""arr as (select user_id % {LANES} as lane, event_id, epoch_us(ts) as us, value,
        row_number() over (partition by user_id % {LANES} order by ts, event_id) as rn from events),
      opens as (select lane, rn as start_rn, us as start_us, 1 as wid from arr where rn = 1
        union all
        select n.lane, n.rn, n.us, w.wid + 1 from opens w join lateral (
          select lane, rn, us from arr a where a.lane = w.lane and a.rn > w.start_rn
            and (a.rn = w.start_rn + {N} or a.us >= w.start_us + {TIMEOUT_US}) order by rn limit 1) n on true),
      spans as (select *, lead(start_rn, 1, 9223372036854775807) over (partition by lane order by start_rn) as next_rn from opens),
      batched as (select a.lane, a.event_id, a.us, a.value, s.wid, a.rn - s.start_rn as "at",
        count(*) over (partition by a.lane, s.wid) as batch, s.start_us as opened,
        max(a.us) over (partition by a.lane, s.wid) as last_us
        from arr a join spans s on s.lane = a.lane and a.rn >= s.start_rn and a.rn < s.next_rn)"""


def sql(body: str, *views: str) -> str:
    """``body`` with the common table expressions it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in NEEDS.get(name, []):
            add(dep)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    if not order:
        return body
    return "with " + ",\n".join(f"{v} as ({SQL[v]})" for v in order) + "\n" + body


def windowed(body: str) -> str:
    return f"with recursive {WINDOWS}\n{body}"


def long_words(df: DataFrame) -> DataFrame:
    return df.withColumn("prompt_words", words("prompt"))
