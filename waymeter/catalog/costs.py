"""Prices, costs, mixes, curves and frontiers over one call per line item."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymeter.functions.money import priced, token_cost
from waymeter.operators import cost as C
from waymeter.operators import stats as S
from waymeter.plans import views as V
from waymeter.plans.views import sql
from waymeter.sources.readers import read_prices
from waymeter.sources.writers import run_index


def _flat(df, column="by_model"):
    pairs = F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return df.withColumn(column, F.array_join(F.array_sort(pairs), ","))


def arm_cost(spark, d):
    return _flat(C.arm_cost(V.calls(spark, d), read_prices(spark)))


_COST = """select arm, sum(n)::bigint as requests, round(sum(correct) / sum(graded), 4) as accuracy, round(sum(usd), 4) as usd_total,
    round(sum(usd) / sum(n) * 1000, 4) as usd_per_1k, string_agg(model || '=' || n, ',' order by model || '=' || n) as by_model
    from (select arm, model, count(*) as n, count(graded_correct) as graded, sum(graded_correct)::double as correct,
      sum(call_usd + judge_usd) as usd from v_usd group by 1, 2) group by 1"""


def join_price(spark, d):
    rows = V.calls(spark, d).withColumn("model", C.model_column())
    return priced(rows, read_prices(spark), "model").select("request_id", "model", "price.input", "price.output")


def join_judge_price(spark, d):
    rows = C.judge_usd(V.calls(spark, d), read_prices(spark))
    return rows.select("request_id", F.round("judge_usd", 9).alias("judge_usd"))


def token_costs(spark, d):
    rows = priced(V.calls(spark, d).withColumn("model", C.model_column()), read_prices(spark), "model")
    usd = token_cost("prompt_tokens", "completion_tokens", "price.input", "price.output")
    return rows.select("request_id", F.round(usd, 9).alias("usd"))


def rounded(spark, d):
    rows = V.calls(spark, d).groupBy("run_id", "arm").agg(
        F.avg("graded_correct").alias("a"), F.count(F.lit(1)).alias("n")
    )
    return rows.select("run_id", "arm", F.round("a", 4).alias("accuracy"), F.round(F.col("n") / 7, 4).alias("part"))


def pct_of_baseline(spark, d):
    costs = C.arm_cost(V.calls(spark, d), read_prices(spark))
    return C.pct_of(costs, "R").select("arm", "usd_per_1k", F.round("pct_of_base", 2).alias("pct_of_base"))


def mix(spark, d):
    out = C.mix(V.calls(spark, d), ["arm", "slice"])
    return out.select("arm", "slice", "selected_model", "n", F.round("share", 6).alias("share"))


def manifest(spark, d):
    m = run_index(V.calls(spark, d), pos=F.struct("l_orderkey", "l_linenumber"))
    return m.withColumn("models_seen", F.array_join("models_seen", ";"))


def _points(spark, d):
    """Cost and accuracy of each run."""
    c = C.arm_cost(V.calls(spark, d), read_prices(spark), key="run_id")
    return c.select("run_id", F.col("usd_per_1k").alias("usd"), F.col("accuracy").alias("acc"))


_POINTS = """(select run_id, round(sum(call_usd + judge_usd) / count(*) * 1000, 4) as usd,
    round(avg(graded_correct), 4) as acc from v_usd group by 1)"""


def mixture(spark, d):
    m = S.mixture(_points(spark, d), "run-1995", "run-1997", "run_id")
    return m.select("run_id", F.round("share_b", 4).alias("share_b"), F.round("line_acc", 4).alias("line_acc"), F.round("residual", 4).alias("residual"))


def pareto(spark, d):
    """Cheapest and most accurate part-and-day groups; many points, so the frontier is a real scan."""
    li = V.table(spark, d, "lineitem").groupBy("l_suppkey", "l_shipdate").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("usd"), F.sum("l_quantity").alias("acc")
    )
    return S.pareto(li).select("l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "usd", "acc")


_RUNS = """(select [1, 2, 4, 8][cast(user_id % 4 + 1 as int)] as p, event_id % 3 as repeat, sum(value) / 100
    / [1, 2, 4, 8][cast(user_id % 4 + 1 as int)] as wall_s from events group by 1, 2, user_id % 4)"""


def _runs(spark, d):
    p = F.element_at(F.array(*[F.lit(x) for x in (1, 2, 4, 8)]), (F.col("user_id") % 4 + 1).cast("int"))
    ev = V.table(spark, d, "events").select(p.alias("p"), (F.col("event_id") % 3).alias("repeat"), "value")
    return ev.groupBy("p", "repeat").agg((F.sum("value") / 100 / F.col("p")).alias("wall_s"))


def speedup(spark, d):
    out = S.speedup(_runs(spark, d), 400, 4.5)
    return out.select("p", "repeats", *[F.round(c, 4).alias(c) for c in ("wall_s", "rec_per_s", "speedup", "net_speedup")])


def sweep(spark, d):
    li = V.table(spark, d, "lineitem").groupBy(
        F.col("l_linenumber").cast("int").alias("n"), F.col("l_returnflag").alias("arm")
    ).agg(F.count(F.lit(1)).alias("requests"))
    return S.sweep({"n": [1, 3, 5, 7, 9], "arm": ["A", "N", "R", "X"]}, li)


ENTRIES = {
    "agg_arm_cost": (arm_cost, sql(_COST, "v_usd")),
    "join_price": (join_price, sql("select request_id, model, rate_in as input, rate_out as output from v_priced", "v_priced")),
    "join_judge_price": (join_judge_price, sql("select request_id, round(judge_usd, 9) as judge_usd from v_usd", "v_usd")),
    "fn_token_cost": (token_costs, sql("select request_id, round(call_usd, 9) as usd from v_usd", "v_usd")),
    "fn_round": (rounded, sql("""select run_id, arm, round(avg(graded_correct), 4) as accuracy, round(count(*) / 7.0::double, 4) as part
        from v_calls group by 1, 2""", "v_calls")),
    "agg_pct_of_baseline": (pct_of_baseline, sql(f"""select arm, usd_per_1k, round(100.0::double * usd_per_1k /
        (select usd_per_1k from c where arm = 'R'), 2) as pct_of_base from c""", "v_usd").replace("\nselect arm, usd_per_1k", f", c as ({_COST})\nselect arm, usd_per_1k")),
    "agg_mix": (mix, sql("""select arm, slice, selected_model, count(*) as n,
        round(count(*) / sum(count(*)) over (partition by arm, slice)::double, 6) as share from v_calls group by 1, 2, 3""", "v_calls")),
    "agg_slice_counts": (
        lambda spark, d: C.by_slice(V.requests(spark, d)),
        sql("select slice, count(*) as n from v_requests group by 1", "v_requests"),
    ),
    "agg_manifest": (manifest, sql("""select run_id, arg_min(arm, (l_orderkey, l_linenumber)) as arm, count(*) as requests,
        string_agg(distinct nullif(model_name, ''), ';' order by nullif(model_name, '')) as models_seen,
        count(graded_correct) as graded from v_calls group by 1""", "v_calls")),
    "agg_mixture": (mixture, sql(f"""select run_id, round((usd - a.u) / (b.u - a.u), 4) as share_b,
        round(a.c + (usd - a.u) / (b.u - a.u) * (b.c - a.c), 4) as line_acc,
        round(acc - (a.c + (usd - a.u) / (b.u - a.u) * (b.c - a.c)), 4) as residual
        from {_POINTS} p, (select usd as u, acc as c from {_POINTS} where run_id = 'run-1995') a,
        (select usd as u, acc as c from {_POINTS} where run_id = 'run-1997') b""", "v_usd")),
    "agg_pareto": (pareto, """with p as (select l_suppkey, l_shipdate, round(sum(l_extendedprice), 2) as usd, sum(l_quantity) as acc
          from lineitem group by 1, 2),
        best as (select usd, max(acc) as acc from p group by 1),
        front as (select usd, acc, max(acc) over (order by usd rows between unbounded preceding and 1 preceding) as seen from best)
        select l_suppkey, strftime(l_shipdate, '%Y-%m-%d') as day, usd, acc from p join front using (usd, acc)
        where seen is null or acc > seen"""),
    "agg_speedup": (speedup, f"""with m as (select p, count(*) as repeats, quantile_cont(wall_s, 0.5) as w from {_RUNS} group by 1)
        select p, repeats, round(w, 4) as wall_s, round(400 / w, 4) as rec_per_s,
        round((select w from m order by p limit 1) / w, 4) as speedup,
        round(((select w from m order by p limit 1) - 4.5) / (w - 4.5), 4) as net_speedup from m"""),
    "agg_sweep": (sweep, """select n, arm, requests from (select unnest([1, 3, 5, 7, 9]) as n)
        cross join (select unnest(['A', 'N', 'R', 'X']) as arm)
        left join (select l_linenumber as n, l_returnflag as arm, count(*) as requests from lineitem group by 1, 2) using (n, arm)"""),
}
