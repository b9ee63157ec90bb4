"""Graders and prompt texts over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymeter import fixed
from waymeter.functions import grading as G
from waymeter.functions import prompts as P
from waymeter.functions import text as X
from waymeter.operators import cost as C
from waymeter.plans import views as V
from waymeter.plans.views import sql

# Reply endings by doc_id % 8 and their gold values.
NUMBER = [("ANSWER: 1,234", "1234"), ("answer:  b", "7"), ("the answer is 7.50", "7.5"), ("", "3"), (None, "1"),
          ("ANSWER: -3, no, ANSWER: 12", "12"), ("ANSWER:\n.5", "0.5"), ("ANSWER: C 99", "99")]
LETTER = [("ANSWER: c", "C"), ("ANSWER: Apple", "A"), ("so B, or C.", "C"), ("", "A"), (None, "B"),
          ("ANSWER: 4 then D", "D"), ("answer:\nB", "B"), ("ANSWER: a ANSWER: d", "D")]
BINARY = ["ANSWER: toxic", "I say it is SAFE  ", "ANSWER: SAFE, then ANSWER: TOXIC", "", None, "safe", "Answer:\n Safe", "toxic."]
LABEL = ["ANSWER: En", "ANSWER: lang/fr", " answer: DE -", "", None, "ANSWER: es\nnext", "ANSWER:  fr", "ANSWER: E n"]
CODE = ["```python\nx = 1\n``` and ```y```", "```\nz\n```", "``` open", "", None, "``````", "a ```b``` c", "```python```"]


def _case(values, key="doc_id"):
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(F.col(key) % len(values) == i, F.lit(v)).otherwise(out)
    return out


def _sql_case(values, key="doc_id"):
    def lit(v):
        return "null" if v is None else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    return f"(case {key} % {len(values)} " + " ".join(f"when {i} then {lit(v)}" for i, v in enumerate(values)) + " end)"


def _docs(spark, d):
    return V.table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars", "source")


def _replied(spark, d, values):
    return _docs(spark, d).withColumn("reply", F.concat("text", F.lit("\n"), _case(values)))


_DOCS = "(select doc_id, text, lang, n_chars, source, text || chr(10) || {} as reply from documents)"
_LAST = "(regexp_extract_all(coalesce({0}, ''), '{1}', {2}))[-1]"
_EDGE = r"[^\p{L}\p{N}_]"


def _s_number(t):
    marked = f"try_cast(replace({_LAST.format(t, fixed.ANSWER_PATTERN, 1)}, ',', '') as double)"
    loose = f"try_cast(replace({_LAST.format(t, fixed.NUMBER_PATTERN, 0)}, ',', '') as double)"
    return f"coalesce({marked}, {loose})"


def _s_letter(t):
    marked = f"upper({_LAST.format(t, fixed.ANSWER_PATTERN, 1)})"
    doubled = f"regexp_replace(right({t}, 200), '({_EDGE})', '\\1\\1', 'g')"
    loose = _LAST.format(doubled, f"(^|{_EDGE})([A-D])({_EDGE}|$)", 2)
    return f"case when {marked} in ('A', 'B', 'C', 'D') then {marked} else {loose} end"


def _s_binary(t):
    marked = f"upper({_LAST.format(t, fixed.TOXIC_PATTERN, 1)})"
    end = rf"regexp_replace(upper(right({t}, 200)), '\s+$', '')"
    return f"coalesce({marked}, case when ends_with({end}, 'TOXIC') then 'TOXIC' when ends_with({end}, 'SAFE') then 'SAFE' end)"


def _s_norm(t):
    return f"regexp_replace(regexp_replace(lower(coalesce({t}, '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def _s_label(t):
    found = _LAST.format(t, fixed.LABEL_PATTERN, 1)
    return f"case when {found} is not null then {_s_norm(found)} end"


def grade_number(spark, d):
    df = _replied(spark, d, [r for r, _ in NUMBER]).withColumn("gold", _case([g for _, g in NUMBER]))
    return df.select("doc_id", G.answered_number("reply").alias("got"), G.grade_number("reply", "gold").alias("ok"))


def grade_letter(spark, d):
    df = _replied(spark, d, [r for r, _ in LETTER]).withColumn("gold", _case([g for _, g in LETTER]))
    return df.select("doc_id", G.answered_letter("reply").alias("got"), G.grade_letter("reply", "gold").alias("ok"))


def grade_binary(spark, d):
    df = _replied(spark, d, BINARY).join(V.table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    gold = F.when(F.col("toxic") == 1, "TOXIC").otherwise("SAFE")
    return df.select("doc_id", G.answered_binary("reply").alias("got"), G.grade_binary("reply", gold).alias("ok"))


def grade_label(spark, d):
    df = _replied(spark, d, LABEL)
    return df.select("doc_id", G.answered_label("reply").alias("got"), G.grade_label("reply", "lang").alias("ok"))


def norm_label(spark, d):
    return _docs(spark, d).select("doc_id", X.norm_label("text").alias("label"))


def code_block(spark, d):
    df = _replied(spark, d, CODE)
    return df.select("doc_id", F.md5(F.encode(G.code_block("reply"), "UTF-8")).alias("digest"))


def gold_split(spark, d):
    raw = F.concat("text", F.lit(" #### 1,0#### "), F.col("n_chars").cast("string"), F.lit(",5 "))
    return _docs(spark, d).select("doc_id", X.gold_split(raw).alias("gold"))


KINDS = ["gsm8k", "mmlu", "toxicchat", "banking77", "humaneval"]
MIXED = ["ANSWER: 5", "ANSWER: b", "ANSWER: SAFE", "ANSWER: En", "code", "x 6", "so A", "TOXIC", "none", "code"]
MIXED_GOLD = ["5", "B", "SAFE", "en", None, "6", "B", "SAFE", "en", None]


def _mixed(spark, d):
    df = _replied(spark, d, MIXED).withColumns({"kind": _case(KINDS), "gold": _case(MIXED_GOLD), "verdict": F.col("n_chars") % 2 == 0})
    return df.select("doc_id", "kind", "lang", G.grade("kind", "reply", "gold", "verdict").alias("ok"))


_MIXED = f"""(select doc_id, kind, lang, coalesce(case kind when 'gsm8k' then abs({_s_number("reply")} - try_cast(gold as double)) < 1e-6
      when 'mmlu' then {_s_letter("reply")} = gold when 'toxicchat' then {_s_binary("reply")} = gold
      when 'banking77' then {_s_label("reply")} = {_s_norm("gold")} else n_chars % 2 = 0 end, false) as ok
      from (select *, {_sql_case(KINDS)} as kind, {_sql_case(MIXED_GOLD)} as gold from {_DOCS.format(_sql_case(MIXED))}))"""


def _answer_key(spark, d):
    """Gold per document, missing for each seventh."""
    return _docs(spark, d).where("doc_id % 7 <> 0").select(
        F.col("doc_id").cast("string").alias("id"), _case(KINDS).alias("slice"), _case(MIXED_GOLD).alias("answer")
    )


def _joined(spark, d):
    rows = _replied(spark, d, MIXED).select(F.col("doc_id").cast("string").alias("workload_id"), "doc_id", "lang", "n_chars", "reply")
    rows = C.join_answers(rows, _answer_key(spark, d))
    ok = G.grade("gold_slice", "reply", "gold", F.col("n_chars") % 2 == 0)
    return rows.withColumn("graded_correct", F.when(F.col("has_gold"), ok.cast("int")))


def join_answers(spark, d):
    return _joined(spark, d).select("workload_id", "gold_slice", "gold", "graded_correct")


def grade_counts(spark, d):
    out = C.grade_counts(_joined(spark, d), ["lang"])
    return out.select("lang", "graded", "correct", "ungradable", F.round("acc", 6).alias("acc"))


_KEYED = f"(select *, doc_id % 7 <> 0 as has from {_MIXED})"


def prompt_templates(spark, d):
    """All templates of the rows that have a message: of every ninth it is blank, of every eleventh there is none."""
    message = F.when(F.col("doc_id") % 9 == 0, " \t\n").when(F.col("doc_id") % 11 != 0, F.col("text"))
    rows = _docs(spark, d).withColumn("msg", message)
    df = P.moderation_prompts(P.intent_prompts(rows, "msg", "source", "intent"), "msg", "moderation")

    def digest(c):
        return F.md5(F.encode(c, "UTF-8"))

    q = F.col("text")
    choices = F.array("lang", "source", F.col("n_chars").cast("string"), F.lit("none"))
    return df.select(
        "doc_id", digest(P.number_prompt(q)).alias("number"), digest(P.choice_prompt(q, choices)).alias("choice"),
        digest(P.code_prompt(q)).alias("code"), digest("moderation").alias("moderation"), digest("intent").alias("intent"),
    )


def _q(text):
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_TEMPLATES = f"""select doc_id, md5({_STRIP.format("text")} || {_q(chr(10) * 2 + fixed.NUMBER_TASK)}) as number,
    md5({_STRIP.format("text")} || {_q(chr(10) * 2)} || 'A. ' || lang || chr(10) || 'B. ' || source || chr(10) || 'C. ' || n_chars
      || chr(10) || 'D. none' || {_q(chr(10) * 2 + fixed.LETTER_TASK)}) as choice,
    md5({_q(fixed.CODE_TASK)} || text) as code,
    md5({_q(fixed.MODERATION_HEAD)} || left({_STRIP.format("text")}, 6000) || {_q(fixed.MODERATION_TAIL)}) as moderation,
    md5({_q(fixed.INTENT_HEAD)} || {_STRIP.format("text")} || {_q(fixed.INTENT_LIST)}
      || (select string_agg('- ' || source, chr(10) order by source) from (select distinct source from documents))
      || {_q(fixed.INTENT_TAIL)}) as intent from documents where doc_id % 9 <> 0 and doc_id % 11 <> 0 and {_STRIP.format("text")} <> ''"""

ENTRIES = {
    "fn_grade_number": (grade_number, f"""select doc_id, {_s_number("reply")} as got,
        coalesce(abs({_s_number("reply")} - cast({_sql_case([g for _, g in NUMBER])} as double)) < 1e-6, false) as ok
        from {_DOCS.format(_sql_case([r for r, _ in NUMBER]))}"""),
    "fn_grade_letter": (grade_letter, f"""select doc_id, {_s_letter("reply")} as got,
        coalesce({_s_letter("reply")} = {_sql_case([g for _, g in LETTER])}, false) as ok from {_DOCS.format(_sql_case([r for r, _ in LETTER]))}"""),
    "fn_grade_binary": (grade_binary, f"""select doc_id, {_s_binary("reply")} as got,
        coalesce({_s_binary("reply")} = case when toxic = 1 then 'TOXIC' else 'SAFE' end, false) as ok
        from {_DOCS.format(_sql_case(BINARY))} join (select doc_id, toxic from labels) using (doc_id)"""),
    "fn_grade_label": (grade_label, f"""select doc_id, {_s_label("reply")} as got,
        coalesce({_s_label("reply")} = {_s_norm("lang")}, false) as ok from {_DOCS.format(_sql_case(LABEL))}"""),
    "fn_norm_label": (norm_label, f"select doc_id, {_s_norm('text')} as label from documents"),
    "fn_grade_dispatch": (_mixed, f"select doc_id, kind, lang, ok from {_MIXED}"),
    "fn_code_block": (code_block, rf"""select doc_id, md5(case when regexp_matches(coalesce(reply, ''), '{fixed.CODE_PATTERN}')
        then regexp_extract(reply, '{fixed.CODE_PATTERN}', 1) else coalesce(reply, '') end) as digest from {_DOCS.format(_sql_case(CODE))}"""),
    "fn_gold_split": (gold_split, "select doc_id, n_chars || '5' as gold from documents"),
    "fn_prompt_templates": (prompt_templates, _TEMPLATES),
    "join_answers": (join_answers, f"""select cast(doc_id as varchar) as workload_id, case when has then kind end as gold_slice,
        case when has then {_sql_case(MIXED_GOLD)} end as gold, case when has then cast(ok as int) end as graded_correct from {_KEYED}"""),
    "agg_grade_counts": (grade_counts, f"""select lang, count(*) filter (has) as graded, count(*) filter (has and ok) as correct,
        count(*) filter (not has) as ungradable, round(coalesce(count(*) filter (has and ok)::double / nullif(count(*) filter (has), 0), 0.0::double), 6) as acc
        from {_KEYED} group by 1"""),
    "fn_head": (
        lambda spark, d: V.requests(spark, d).select("id", X.head("prompt").alias("prompt_head")),
        sql("select id, left(prompt, 60) as prompt_head from v_requests", "v_requests"),
    ),
    "fn_sha1": (
        lambda spark, d: V.requests(spark, d).select("id", X.sha1_key("prompt").alias("prompt_sha1")),
        sql("select id, sha1(prompt) as prompt_sha1 from v_requests", "v_requests"),
    ),
}
