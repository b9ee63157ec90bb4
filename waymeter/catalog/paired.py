"""Paired statistics over predictions, latency over events, and sampling over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymeter.operators import sampling as M
from waymeter.operators import resample as RS
from waymeter.operators import stats as S
from waymeter.plans import views as V
from waymeter.plans.views import sql
from waymeter.sources.readers import last_by_key

ARMS = list(V.ARMS)


def _by_seed(spark, d):
    """Every prediction; an item of one seed is an item of its own."""
    return V.predictions(spark, d).withColumn("item", F.concat_ws("/", F.col("item").cast("string"), F.col("seed").cast("string")))


def pair_arms(spark, d):
    return S.pair_arms(_by_seed(spark, d), ARMS)


def seeds(spark, d):
    out = S.seed_stats(V.predictions(spark, d))
    return out.select("arm", "seeds", F.round("mean_acc", 6).alias("mean_acc"), F.round("sd_acc", 6).alias("sd_acc"))


def recall(spark, d):
    out = S.recall(V.predictions(spark, d))
    return out.select("arm", "gold", "n", F.round("recall", 6).alias("recall"))


def mcnemar(spark, d):
    """Discordant counts of the majority votes with the corrected chi-square statistic and the exact p-value."""
    votes = S.majority(V.predictions(spark, d))
    out = S.exact_p(S.chi_square(S.discordant(votes, "nano", "big")))
    return out.select("pairs", "b", "c", F.round("chi2", 6).alias("chi2"), F.round("p_value", 9).alias("p_value"))


def oracle(spark, d):
    out = S.oracle(_by_seed(spark, d), ARMS, "nano")
    return out.select("items", *[F.round(c, 6).alias(c) for c in ("oracle_acc", "best_arm_acc", "headroom", "escalation")])


def drift(spark, d):
    ev = V.table(spark, d, "events").select(
        F.when(F.col("user_id") % 2 == 0, "small").otherwise("big").alias("model"), "ts",
        (F.col("value") < 40).cast("int").alias("correct"),
    )
    out = S.drift(ev, "ts", "week")
    return out.select("model", F.date_format("epoch", "yyyy-MM-dd").alias("epoch"), "n", F.round("acc", 6).alias("acc"), F.round("change", 6).alias("change"))


def _timed(spark, d):
    arm = F.element_at(F.array(F.lit("direct"), F.lit("rules"), F.lit("judge")), (F.col("user_id") % 3 + 1).cast("int"))
    return V.table(spark, d, "events").select(
        arm.alias("arm"), F.col("value").alias("e2e_ms"), (F.col("value") / 10).alias("decision_ms"), "event_id"
    )


_TIMED = """(select ['direct', 'rules', 'judge'][cast(user_id % 3 + 1 as int)] as arm, value as e2e_ms, value / 10 as decision_ms, event_id from events)"""


def latency(spark, d):
    out = S.latency(_timed(spark, d), ["e2e_ms", "decision_ms"])
    return out.select("arm", "metric", "n", *[F.round(c, 6).alias(c) for c in S.TAILS])


def overhead(spark, d):
    out = S.overhead(_timed(spark, d), "direct")
    return out.select("arm", "n", *[F.round(c, 6).alias(c) for c in ("p50", "delta_ms", "per_write_ms")])


REPS, SEED = 100, 7


def _items(spark, d):
    """Two timings per document: with and without an extra stage."""
    docs = V.table(spark, d, "documents").select("doc_id", "n_chars", (F.col("doc_id") * 37 % 101).alias("extra"))
    direct = docs.select(F.col("doc_id").alias("item"), F.lit("direct").alias("arm"), F.col("n_chars").cast("double").alias("v"))
    routed = docs.select(F.col("doc_id").alias("item"), F.lit("routed").alias("arm"), (F.col("n_chars") + F.col("extra")).cast("double").alias("v"))
    return direct.unionByName(routed)


def bootstrap(spark, d):
    out = S.bootstrap_ci(_items(spark, d), "routed", "direct", reps=REPS, seed=SEED)
    return out.select(*[F.round(c, 6).alias(c) for c in ("delta", "lo", "hi")], "reps")


def bootstrap_median(spark, d):
    out = S.bootstrap_median_gap(_items(spark, d), "routed", "direct", reps=REPS, seed=SEED)
    return out.select(*[F.round(c, 6).alias(c) for c in ("delta", "lo", "hi")], "reps")


_A, _B = RS.ABOVE, RS.BELOW
_SIDE = f"t - ({_A[0]} + t * ({_A[1]} + t * {_A[2]})) / ({_B[0]} + t * ({_B[1]} + t * ({_B[2]} + t * {_B[3]})))".replace("(1.0 ", "(1.0::double ")
_POISSON = " ".join(f"when c = {k} then len(list_filter({RS.poisson_cuts(k)}, lambda x: x <= h))" for k in range(1, RS.EXACT + 1))


def _draws(counted: str) -> str:
    """CTEs up to ``w (g, v, rank, rep, w)`` from the text of one that gives ``g, v, c, rank``, ``g`` being the digest's beginning."""
    return f"""counted as ({counted}),
    dug as (select *, sha1(g || rank || '|' || b || '|{SEED}') as digest from counted, range(0, {-(-REPS // RS.DRAWS)}) as r(b)),
    bits as (select g, v, c, rank, b * {RS.DRAWS} + i as rep, cast('0x' || substr(digest, cast(i * 8 + 1 as int), 8) as bigint) as h from dug, range(0, {RS.DRAWS}) as s(i)),
    us as (select *, (h + 0.5) / 4294967296.0::double as u, sqrt(-2 * ln(least((h + 0.5) / 4294967296.0::double, 1 - (h + 0.5) / 4294967296.0::double))) as t from bits where rep < {REPS}),
    zs as (select *, case when u < 0.5 then -({_SIDE}) else {_SIDE} end as z from us),
    w as (select g, v, rank, rep, (case {_POISSON} else greatest(0, floor(c + sqrt(c) * z + (z * z - 1) / 6 + 0.5)) end)::bigint as w from zs)"""


_BOOT = f"""with {_draws("select '' as g, d as v, count(*) as c, row_number() over (order by d) as rank from (select (doc_id * 37 % 101)::double as d from documents) group by d")},
    m as (select rep, sum(w * v) / sum(w) as mean from w group by 1)
    select round((select avg(doc_id * 37 % 101) from documents), 6) as delta, round(quantile_cont(mean, 0.025), 6) as lo, round(quantile_cont(mean, 0.975), 6) as hi,
    count(mean) as reps from m"""
_ARMS = "(select 'direct' as arm, n_chars::double as v from documents union all select 'routed', (n_chars + doc_id * 37 % 101)::double from documents)"
_BOOT_MEDIAN = f"""with {_draws(f"select arm || '|' as g, v, count(*) as c, row_number() over (partition by arm order by v) as rank from {_ARMS} group by arm, v")},
    s as (select *, sum(w) over (partition by g, rep order by rank) as upto, sum(w) over (partition by g, rep) as total from w),
    m as (select g, rep, (max(case when upto - w < (total + 1) // 2 and (total + 1) // 2 <= upto then v end)
      + max(case when upto - w < (total + 2) // 2 and (total + 2) // 2 <= upto then v end)) / 2 as median from s group by 1, 2),
    d as (select rep, max(case when g = 'routed|' then median end) - max(case when g = 'direct|' then median end) as gap from m group by 1)
    select round((select median(v) filter (arm = 'routed') - median(v) filter (arm = 'direct') from {_ARMS}), 6) as delta,
    round(quantile_cont(gap, 0.025), 6) as lo, round(quantile_cont(gap, 0.975), 6) as hi, count(gap) as reps from d"""


def row_ids(spark, d):
    return M.assign_ids(V.table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 42, "w")


def shuffled(spark, d):
    """The seeded order, shown as each row's place in it."""
    return M.shuffle(V.table(spark, d, "documents").select("doc_id"), "doc_id", 9).select("doc_id", "place")


def first_n(spark, d):
    return M.first_n(V.table(spark, d, "events").select("event_id", "ts", "user_id"), ["ts", "event_id"], 400).select("event_id", "user_id")


def balanced(spark, d):
    rows = V.table(spark, d, "labels").select("doc_id", "toxic")
    return M.balanced(rows, "toxic", 1000, 42, "doc_id").select("doc_id", "toxic")


def stratified(spark, d):
    rows = V.table(spark, d, "documents").select("doc_id", "source")
    return M.stratified(rows, "source", 250, 42, "doc_id").select("doc_id", "source")


def quota(spark, d):
    rows = V.table(spark, d, "documents").select("doc_id", "lang")
    return M.quota(rows, "lang", 112, 350, ["doc_id"], "doc_id", 42).select("doc_id", "lang")


def last(spark, d):
    ev = V.table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    out = last_by_key(ev, ["user_id", "event_type"], F.struct("ts", "event_id"))
    return out.select("user_id", "event_type", "event_id", "value")


def _o(key, seed):
    return f"sha1(cast({key} as varchar) || '|{seed}')"


ENTRIES = {
    "join_pair_arms": (pair_arms, sql("""select item || '/' || seed as item, max(correct) filter (arm = 'nano') as nano, max(correct) filter (arm = 'mini') as mini,
        max(correct) filter (arm = 'big') as big from v_pred group by 1""", "v_pred")),
    "agg_seeds": (seeds, sql("""select arm, count(*) as seeds, round(avg(a), 6) as mean_acc, round(stddev_samp(a), 6) as sd_acc
        from (select arm, seed, avg(correct) * 100 as a from v_pred group by 1, 2) group by 1""", "v_pred")),
    "agg_class_recall": (recall, sql("""select arm, gold, count(*) as n, round(avg(case when pred = gold then 1 else 0 end), 6) as recall
        from v_pred group by 1, 2""", "v_pred")),
    "agg_confusion": (
        lambda spark, d: S.confusion(V.predictions(spark, d)),
        sql("select arm, gold, pred, count(*) as n from v_pred group by 1, 2, 3", "v_pred"),
    ),
    "agg_majority": (
        lambda spark, d: S.majority(V.predictions(spark, d)),
        sql("select arm, item, cast(sum(correct) * 2 > count(*) as int) as correct from v_pred group by 1, 2", "v_pred"),
    ),
    "agg_mcnemar": (mcnemar, sql("""select *, round(least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1),
          lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2))))), 9) as p_value from (
        select count(*) as pairs, count(*) filter (x = 1 and y = 0) as b, count(*) filter (x = 0 and y = 1) as c,
        round(power(greatest(abs(count(*) filter (x = 1 and y = 0) - count(*) filter (x = 0 and y = 1)) - 1, 0), 2)::double
          / nullif(count(*) filter (x <> y), 0), 6) as chi2
        from (select item, max(v) filter (arm = 'nano') as x, max(v) filter (arm = 'big') as y from (
          select arm, item, cast(sum(correct) * 2 > count(*) as int) as v from v_pred group by 1, 2) group by 1))""", "v_pred")),
    "agg_oracle": (oracle, sql("""select count(*) as items, round(avg(greatest(nano, mini, big)), 6) as oracle_acc,
        round(greatest(avg(nano), avg(mini), avg(big)), 6) as best_arm_acc,
        round(avg(greatest(nano, mini, big)) - greatest(avg(nano), avg(mini), avg(big)), 6) as headroom, round(avg(1 - nano), 6) as escalation
        from (select max(correct) filter (arm = 'nano') as nano, max(correct) filter (arm = 'mini') as mini,
          max(correct) filter (arm = 'big') as big from v_pred group by v_pred.item, seed)""", "v_pred")),
    "agg_drift": (drift, """select model, strftime(epoch, '%Y-%m-%d') as epoch, n, round(acc, 6) as acc,
        round(acc - lag(acc) over (partition by model order by epoch), 6) as change from (
        select case when user_id % 2 = 0 then 'small' else 'big' end as model, date_trunc('week', ts) as epoch, count(*) as n,
        avg(cast(value < 40 as int)) as acc from events group by 1, 2)"""),
    "agg_latency": (latency, f"""select arm, metric, count(*) as n, round(quantile_cont(v, 0.5), 6) as p50, round(quantile_cont(v, 0.95), 6) as p95,
        round(quantile_cont(v, 0.99), 6) as p99 from (select arm, 'e2e_ms' as metric, e2e_ms as v from {_TIMED}
        union all select arm, 'decision_ms', decision_ms from {_TIMED}) group by 1, 2"""),
    "agg_overhead": (overhead, f"""with m as (select arm, count(*) as n, quantile_cont(e2e_ms, 0.5) as p from {_TIMED} group by 1)
        select arm, n, round(p, 6) as p50, round(p - (select p from m where arm = 'direct'), 6) as delta_ms,
        round((p - (select p from m where arm = 'direct')) / 2, 6) as per_write_ms from m"""),
    "agg_bootstrap": (bootstrap, _BOOT),
    "agg_bootstrap_median": (bootstrap_median, _BOOT_MEDIAN),
    "win_row_ids": (row_ids, f"""select doc_id, lang, 'w' || case when length(cast(rn as varchar)) < 4 then lpad(cast(rn as varchar), 4, '0')
        else cast(rn as varchar) end as id from (select doc_id, lang, row_number() over (order by {_o("doc_id", 42)}, doc_id) - 1 as rn from documents)"""),
    "win_shuffle": (shuffled, f"select doc_id, row_number() over (order by {_o('doc_id', 9)}, doc_id) as place from documents"),
    "win_first_n": (first_n, "select event_id, user_id from events order by ts, event_id limit 400"),
    "win_balanced": (balanced, f"""select doc_id, toxic from (select *, row_number() over (partition by toxic order by {_o("doc_id", 42)}, doc_id) as rn from labels)
        where rn <= least(500, (select min(n) from (select count(*) as n from labels group by toxic)))"""),
    "win_stratified": (stratified, f"""select doc_id, source from (select *, {_o("doc_id", 42)} as o,
        row_number() over (partition by source order by {_o("doc_id", 42)}, doc_id) as rn from documents)
        where rn <= greatest(1, 250 // (select count(distinct source) from documents)) order by o, doc_id limit 250"""),
    "win_quota": (quota, f"""select doc_id, lang from (select *, row_number() over (partition by lang order by doc_id) as rn from documents)
        where rn <= 112 order by {_o("doc_id", 42)}, doc_id limit 350"""),
    "win_last": (last, """select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value
        from events group by 1, 2"""),
}
