"""Restart audits over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymeter.functions.text import head, sha1_key
from waymeter.operators import recovery as R
from waymeter.operators import sets as S
from waymeter.operators import sketches as K
from waymeter.operators.stats import TAILS
from waymeter.plans import views as V
from waymeter.plans.views import sql
from waymeter.session import scratch


def _sides(spark, d):
    return V.side(spark, d, True), V.side(spark, d, False)


def join_replay(spark, d):
    both = R.replayed(*_sides(spark, d))
    return both.select("workload_id", "pre_model", "post_model", F.col("pre_decision_ms").alias("pre_ms"), F.col("post_decision_ms").alias("post_ms"))


def divergence(spark, d):
    return R.divergence(*_sides(spark, d)).withColumn("diverged_items", F.array_join("diverged_items", ","))


def fingerprint(spark, d):
    return R.fingerprint(*_sides(spark, d))


def determinism(spark, d):
    """Replay outcome by policy class and store, one trial per user group."""
    both = R.replayed(*_sides(spark, d)).withColumn("u", F.substring("workload_id", 2, 20).cast("long"))
    policy = F.when(F.col("u") % 2 == 0, "weighted").otherwise("hash_split")
    store = F.when(F.col("u") % 4 < 2, "durable").otherwise("none")
    trials = both.groupBy(policy.alias("policy"), store.alias("store")).agg(
        F.count(F.lit(1)).alias("replayed"), F.count_if(R.moved()).alias("diverged")
    )
    out = R.determinism(trials)
    return out.select("policy", F.round("durable", 6).alias("durable"), F.round("none", 6).alias("none"))


def backend_head(spark, d):
    """The last model behind each request head on both sides of the cut."""
    t = V.table(spark, d, "events")
    prompt = F.concat(F.lit("request of user "), F.lpad(F.col("user_id").cast("string"), 60, "0"), F.lit(" tail "), F.col("event_type"))
    rows = t.select(
        head(prompt).alias("prompt_head"), F.when(F.col("value") < 35, "small").otherwise("big").alias("model"),
        "ts", "event_id", (F.col("ts") <= F.lit(V.CUT).cast("timestamp_ntz")).alias("early"),
    )

    def last(early):
        part = rows.where("early" if early else "not early")
        return part.groupBy("prompt_head").agg(F.max_by("model", F.struct("ts", "event_id")).alias("model"))

    return R.divergence_by_head(last(True), last(False))


_HEADS = f"""select left('request of user ' || lpad(cast(user_id as varchar), 60, '0') || ' tail ' || event_type, 60) as h,
    arg_max(case when value < 35 then 'small' else 'big' end, (ts, event_id)) as m from events where ts {{}} timestamp '{V.CUT}' group by 1"""


def _items(spark, d):
    users = V.table(spark, d, "events").select("user_id").distinct()
    return users.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.col("user_id").cast("string").alias("prompt"))


def ledger_sha(spark, d):
    sets = R.ledger_sets(V.ledger(spark, d), V.CUT_S)
    return R.ledger_of_items(_items(spark, d), sets).select("workload_id", "recv", "reissued", "completed", "in_flight")


def ledger_semi(spark, d):
    sets = R.ledger_sets(V.ledger(spark, d), V.CUT_S)
    return sets.select("prompt_sha1", "reissued", "completed", "in_flight", "in_flight_wide")


def reissue(spark, d):
    shas = _items(spark, d).select(F.col("id").alias("workload_id"), sha1_key("prompt").alias("prompt_sha1"))
    out = R.reissue(V.ledger(spark, d), *_sides(spark, d), V.CUT_S, shas)
    return out.withColumn("diverged_items", F.array_join("diverged_items", ","))


_TOP = "select workload_id from v_both where pre_model <> post_model order by 1 limit {}"
_RATE = "round(count(*) filter (pre_model <> post_model)::double / nullif(count(*), 0), {})"
_AGAIN = "(select * from v_both join (select prompt_sha1 from v_sets where recv > 1) s on s.prompt_sha1 = sha1(substr(workload_id, 2)))"


def invocations(spark, d):
    return R.invocations_hist(V.ledger(spark, d))


def attribution(spark, d):
    return R.attribution(V.calls(spark, d), ["local-model"], ["arm", "run_id"])


def _keys(spark, d, early):
    ev = V.table(spark, d, "events")
    cut = F.lit(V.CUT).cast("timestamp_ntz")
    ev = ev.where(F.col("ts") <= cut if early else F.col("ts") > cut)
    return ev.select((F.col("event_id") % 997).alias("k"), F.col("event_type"), "user_id")


def set_intersect(spark, d):
    return S.intersect(_keys(spark, d, True), _keys(spark, d, False), ["k", "event_type"])


def _per_year(spark, d, rows, sketch):
    """Summaries of the calls, a year at a time: the first years in one run, the others in another, read back together."""
    table = scratch(spark, "sketches")
    early = F.col("run_id") < "run-1995"
    for run, part in (("early", early), ("late", ~early)):
        K.append(sketch(rows.where(part)), table, run)
    return K.read(spark, table)


def latency_sketch(spark, d):
    """Percentiles from merged sketches, and whether their ranks are as near to the points as promised."""
    calls = V.calls(spark, d).select("arm", "run_id", "e2e_ms", "decision_ms")
    kept = _per_year(spark, d, calls, lambda rows: K.quantile_sketches(rows, ["arm", "run_id"], ["e2e_ms", "decision_ms"]))
    found = K.quantiles(kept, ["arm"], TAILS).unpivot(["arm", "metric", "n"], list(TAILS), "point", "at")
    long = calls.select("arm", F.col("e2e_ms").cast("double").alias("e2e_ms"), F.col("decision_ms").cast("double").alias("decision_ms"))
    long = long.unpivot(["arm"], ["e2e_ms", "decision_ms"], "metric", "v").where("v is not null")
    ranks = long.join(found, ["arm", "metric"]).groupBy("arm", "metric", "point", "n").agg((F.count_if(F.col("v") < F.col("at")) / F.first("n")).alias("below"), (F.count_if(F.col("v") <= F.col("at")) / F.first("n")).alias("upto"))
    p = F.element_at(F.create_map(*[F.lit(x) for pair in TAILS.items() for x in pair]), F.col("point"))
    return ranks.select("arm", "metric", "point", "n", ((F.col("below") <= p + K.RANK_ERROR) & (F.col("upto") >= p - K.RANK_ERROR)).alias("within"))


def distinct_sketch(spark, d):
    """Distinct orders of each arm from the years' sketches, against their number."""
    calls = V.calls(spark, d).select("arm", "run_id", "l_orderkey")
    kept = _per_year(spark, d, calls, lambda rows: K.distinct_sketches(rows, ["arm", "run_id"], "l_orderkey"))
    exact = calls.groupBy("arm").agg(F.count_distinct("l_orderkey").alias("orders"))
    near = F.abs(F.col("distinct") - F.col("orders")) <= F.col("orders") * K.DISTINCT_ERROR
    return exact.join(K.distinct_counts(kept, ["arm"]), "arm").select("arm", "orders", near.alias("within"))


def intersect_sketch(spark, d):
    """Events' keys on both sides of the cut, from one sketch a side, against their number."""
    both = _keys(spark, d, True).withColumn("side", F.lit("pre")).union(_keys(spark, d, False).withColumn("side", F.lit("post")))
    keyed = both.select("side", F.concat_ws("|", F.col("user_id").cast("string"), F.col("k").cast("string")).alias("key"))
    found = K.overlap(K.set_sketches(keyed, ["side"], "key"), "side", "pre", "post")
    sides = keyed.groupBy("key").agg(F.count_distinct("side").alias("sides"))
    exact = sides.agg(F.count_if(F.col("sides") == 2).alias("both_sides"), F.count(F.lit(1)).alias("any_side"))
    near = lambda a, b: F.abs(found.select(a).scalar() - F.col(b)) <= F.col("any_side") * K.OVERLAP_ERROR
    return exact.select("both_sides", "any_side", (near("both", "both_sides") & near("either", "any_side")).alias("within"))


def set_except(spark, d):
    """Documents without a label."""
    done = V.table(spark, d, "labels").select("doc_id")
    return S.subtract(V.table(spark, d, "documents").select("doc_id", "source"), done, ["doc_id"])


def set_union(spark, d):
    docs = V.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.md5(F.encode("text", "UTF-8")).alias("digest"), F.lit("documents").alias("slice"))
    bench = V.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.md5(F.encode("text", "UTF-8")).alias("digest"), F.lit("benchmark").alias("slice"))
    reqs = V.requests(spark, d).select("id", F.md5(F.encode("prompt", "UTF-8")).alias("digest"), "slice")
    return S.union_all(docs, bench, reqs)


def sort_keys(spark, d):
    per = V.calls(spark, d).groupBy("arm", "run_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("final_model")).alias("models")
    )
    return per.withColumn("models", F.array_join("models", ",")).orderBy("arm", "run_id")


def topk_examples(spark, d):
    return R.diverged_items(R.replayed(*_sides(spark, d)), n=20)


ENTRIES = {
    "join_replay": (join_replay, sql("select * from v_both", "v_both")),
    "agg_divergence": (divergence, sql(f"""select (select count(*) from v_pre) as decided_pre_kill, (select count(*) from v_post) as decided_post_restore,
        count(*) as replayed_decisions, count(*) filter (pre_model <> post_model) as diverged, {_RATE.format(4)} as divergence_rate,
        (select coalesce(string_agg(workload_id, ',' order by workload_id), '') from ({_TOP.format(20)})) as diverged_items from v_both""", "v_both")),
    "agg_fingerprint": (fingerprint, sql("""select count(*) as replayed, count(*) filter (pre_model = post_model) as same_model,
        count(*) filter (pre_model = post_model and pre_ms is not distinct from post_ms) as identical from v_both""", "v_both")),
    "agg_determinism": (determinism, sql(f"""select policy, max(r) filter (store = 'durable') as durable, max(r) filter (store = 'none') as none from (
        select case when u % 2 = 0 then 'weighted' else 'hash_split' end as policy, case when u % 4 < 2 then 'durable' else 'none' end as store,
        {_RATE.format(6)} as r from (select *, cast(substr(workload_id, 2) as bigint) as u from v_both) group by 1, 2) group by 1""", "v_both")),
    "join_backend_head": (backend_head, f"""select count(*) as replayed, count(*) filter (a.m <> b.m) as diverged,
        round(count(*) filter (a.m <> b.m)::double / nullif(count(*), 0), 4) as rate
        from ({_HEADS.format("<=")}) a join ({_HEADS.format(">")}) b using (h)"""),
    "join_ledger_sha": (ledger_sha, sql("""select 'u' || user_id as workload_id, recv, recv > 1 as reissued, resp_before > 0 as completed,
        broken > 0 as in_flight from (select distinct user_id from events) join v_sets on prompt_sha1 = sha1(cast(user_id as varchar))""", "v_sets")),
    "join_ledger_semi": (ledger_semi, sql("""select prompt_sha1, recv > 1 as reissued, resp_before > 0 as completed, broken > 0 as in_flight,
        broken > 0 or resp_after > 0 as in_flight_wide from v_sets""", "v_sets")),
    "agg_reissue": (reissue, sql(f"""select sum(recv)::bigint as ledger_recv_total, count(*) filter (recv > 0) as unique_prompts_invoked,
        sum(broken)::bigint as in_flight_at_kill, count(*) filter (recv > 1) as reissued_prompts,
        count(*) filter (recv > 1 and broken > 0) as inflight_and_reissued,
        count(*) filter (recv > 1 and (broken > 0 or resp_after > 0)) as inflight_wide_and_reissued,
        count(*) filter (recv > 1 and resp_before > 0) as completed_prekill_reissued, max(recv) as max_recv_per_prompt,
        (18 * sum(greatest(recv - 1, 0)))::bigint as double_billed_tokens,
        (select count(*) from {_AGAIN} where pre_model = post_model) as reissued_decision_kept,
        (select count(*) from {_AGAIN} where pre_model <> post_model) as reissued_decision_diverged,
        (select coalesce(string_agg(workload_id, ',' order by workload_id), '') from (select workload_id from {_AGAIN}
          where pre_model <> post_model order by 1 limit 10)) as diverged_items from v_sets""", "v_both", "v_sets")),
    "agg_exactly_once": (invocations, sql("""select invocations, count(*) as prompts from (select count(*) as invocations from v_ledger
        where phase = 'recv' group by prompt_sha1) group by 1""", "v_ledger")),
    "agg_attribution": (attribution, sql("""select arm, run_id, count(*) as requests,
        count(distinct case when nullif(model_name, '') <> 'local-model' then model_name end) as models_visible,
        count(decision_source) as decisions_logged, count(*) filter (model_name = 'local-model') as alias_rows from v_calls group by 1, 2""", "v_calls")),
    "agg_latency_sketch": (latency_sketch, sql("""select arm, metric, unnest(['p50', 'p95', 'p99']) as point, n, true as within from (
        select arm, 'e2e_ms' as metric, count(e2e_ms) as n from v_calls group by 1
        union all select arm, 'decision_ms', count(decision_ms) from v_calls group by 1)""", "v_calls")),
    "agg_attribution_sketch": (distinct_sketch, sql("select arm, count(distinct l_orderkey) as orders, true as within from v_calls group by 1", "v_calls")),
    "set_intersect_sketch": (intersect_sketch, f"""select count(*) filter (sides = 2) as both_sides, count(*) as any_side, true as within from (
        select user_id, event_id % 997 as k, count(distinct ts <= timestamp '{V.CUT}') as sides from events group by 1, 2)"""),
    "set_intersect": (set_intersect, f"""select event_id % 997 as k, event_type from events where ts <= timestamp '{V.CUT}'
        intersect select event_id % 997, event_type from events where ts > timestamp '{V.CUT}'"""),
    "set_except": (set_except, "select doc_id, source from documents where doc_id not in (select doc_id from labels)"),
    "set_union": (set_union, sql("""select cast(doc_id as varchar) as id, md5(text) as digest, 'documents' as slice from documents
        union all select cast(item_id as varchar), md5(text), 'benchmark' from benchmark
        union all select id, md5(prompt), slice from v_requests""", "v_requests")),
    "sort_keys": (sort_keys, sql("""select arm, run_id, count(*) as n, string_agg(distinct final_model, ',' order by final_model) as models
        from v_calls group by 1, 2 order by 1, 2""", "v_calls")),
    "topk_examples": (topk_examples, sql(_TOP.format(20), "v_both")),
}
