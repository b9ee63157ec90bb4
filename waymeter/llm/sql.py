"""The queries that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

from waymeter.llm import quality, secrets

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def op2() -> str:
    """Gaps before matches give their places: a match starts behind all gaps and matches so far."""
    either = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    found = []
    for rank, (kind, (pattern, group, least)) in enumerate(secrets.RULES.items(), 1):
        if kind == "assign":  # RE2 would fold letters beyond ASCII too
            pattern = pattern.replace("(?i:(password|passwd|secret|token|api_?key))", f"({either})")
        gap = _text(f"(?s)(.*?)(?:{pattern})")
        found.append(f"""select doc_id, {_text(kind)} as kind, {rank} as rank, unnest(regexp_extract_all(t, {gap}, 1)) as gap, unnest(regexp_extract_all(t, {_text(pattern)}, 0)) as hit,
            unnest(regexp_extract_all(t, {_text(pattern)}, {group})) as part, {least} as least, unnest(range(length(t) + 1)[1:len(regexp_extract_all(t, {_text(pattern)}, 0))]) as i from d""")
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents), found as ({" union all ".join(found)}),
ends as (select *, sum(length(gap) + length(hit)) over (partition by doc_id, kind order by i) as "end" from found),
spans as (select doc_id, kind, rank, ("end" - length(hit))::int as start, "end"::int as "end" from ends where length(part) >= least),
listed as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  string_agg(kind || ':' || start || ':' || "end", ',' order by start, rank) filter (rank <= {len(secrets.BASE)}) as base,
  string_agg(kind || ':' || start || ':' || "end", ',' order by start, rank) as spans from spans group by 1)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans from d left join listed using (doc_id)"""


def op3() -> str:
    return f"""
with t as (select doc_id, {LOW} as low from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept, sha256(low) as text_sha256
from t window same as (partition by low)"""


def op6(domains: list[str], weights: dict[str, dict[str, int]], share: tuple[int, int], epochs: int, seed: int) -> str:
    levels = ["domain", "lang", "source"]
    listed = "[" + ", ".join(map(_text, domains)) + "]"
    parts = [f"""t as (select doc_id, {listed}[coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) as bigint), 0) % {len(domains)} + 1] as domain,
        coalesce(lang, '') as lang, coalesce(source, '') as source, len({WORDS}) as tokens from documents)""",
        f"leaf as (select domain, lang, source, sum(tokens)::hugeint as tokens, sum(tokens)::hugeint * {epochs} as cap from t group by all)"]
    for depth, level in enumerate(levels):
        keys, parent = ", ".join(levels[: depth + 1]), ", ".join(levels[:depth])
        by = f"partition by {parent}" if parent else ""
        weight = f"case {level} " + " ".join(f"when {_text(v)} then {w}" for v, w in weights.get(level, {}).items()) + " else 1 end" if weights.get(level) else "1"
        budget = f"join g{depth - 1} using ({parent})" if parent else f"cross join (select sum(tokens) * {share[0]} // {share[1]} as budget from leaf) r"
        parts += [
            f"n{depth} as (select * from (select {keys}, sum(cap)::hugeint as cap, ({weight})::hugeint as w from leaf group by {keys}) {budget})",
            f"""f{depth} as (select *, cap * sum(w) over ({by} order by cap::double / w::double, {level} rows between current row and unbounded following)
              <= w * (budget - coalesce(sum(cap) over ({by} order by cap::double / w::double, {level} rows between unbounded preceding and 1 preceding), 0)) as filled from n{depth})""",
            f"""g{depth} as (select {keys}, case when filled then cap else (budget - sum(case when filled then cap else 0 end) over ({by}))::hugeint * w
              // nullif(sum(case when filled then 0 else w end) over ({by}), 0)::hugeint end as budget from f{depth})""",
        ]
    return f"""
with {", ".join(parts)},
given as (select domain, lang, source, tokens::bigint as leaf_tokens, budget::bigint as got, case when tokens > 0 then (budget // tokens)::bigint else 0 end as whole
  from leaf join g2 using (domain, lang, source)),
run as (select *, sum(tokens) over (partition by domain, lang, source order by md5('{seed}:' || whole || ':' || doc_id), tokens rows unbounded preceding) as upto
  from t join given using (domain, lang, source))
select doc_id, domain, lang, source, tokens, leaf_tokens, got as leaf_budget, (whole + case when got > 0 and upto <= got - whole * leaf_tokens then 1 else 0 end)::bigint as copies,
  (case when got > 0 and upto > got - whole * leaf_tokens then greatest(got - whole * leaf_tokens - (upto - tokens), 0) else 0 end)::bigint as border_tokens from run"""


def op7() -> str:
    return rf"""
with recursive w as (select doc_id, regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end) as s from w),
n as (select doc_id, count(*) as n from s group by 1),
-- The rarest fifth of a set and one more: linked sets share one of these.
placed as (select doc_id, s, n, row_number() over (partition by doc_id order by df, s) as place from (select *, count(*) over (partition by s) as df from s) join n using (doc_id)),
near as (select distinct a.doc_id as x, b.doc_id as y from placed a join placed b on a.s = b.s and a.doc_id < b.doc_id
  where a.place <= a.n // 5 + 1 and b.place <= b.n // 5 + 1),
links as (select x, y from near join s a on a.doc_id = x join s b on b.doc_id = y and a.s = b.s join n nx on nx.doc_id = x join n ny on ny.doc_id = y
  group by x, y, nx.n, ny.n having 100 * count(*) >= 80 * (nx.n + ny.n - count(*))),
sides as (select x, y from links union select y, x from links),
reach(x, y) as (select doc_id, doc_id from documents union select r.x, l.y from reach r join sides l on r.y = l.x)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from (select x as doc_id, min(y) as component_id from reach group by 1) left join n using (doc_id)"""


def op8(length: int = 50) -> str:
    return f"""
with recursive w as (select doc_id, {WORDS} as w from documents),
runs as (select doc_id, i, md5(array_to_string(w[i : i + {length - 1}], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - {length - 2})) as i from w)),
seen as (select doc_id, i, h, least from (select *, min(doc_id) over (partition by h) as least, max(doc_id) over (partition by h) as most from runs) where least < most),
hit as (select doc_id, i from seen where least < doc_id),
-- Windows that another document has too, at each doubled length.
levels(size, doc_id, i, h) as (select {length}, doc_id, i, h from seen union all
  select size * 2, doc_id, i, h from (select *, min(doc_id) over (partition by h) as least, max(doc_id) over (partition by h) as most
    from (select a.size, a.doc_id, a.i, md5(a.h || b.h) as h from levels a join levels b on a.doc_id = b.doc_id and b.i = a.i + a.size)) where least < most),
longest as (select doc_id, max(size)::bigint as longest from levels group by 1),
gone as (select doc_id, list(distinct p) as gone from (select doc_id, unnest(range(i, i + {length})) as p from hit) group by 1),
kept as (select doc_id, len(w) as n_words, list_filter(w, lambda x, p: not list_contains(coalesce(gone, []), p)) as kept from w left join gone using (doc_id))
select doc_id, n_words, n_words - len(kept) as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256, coalesce(longest, 0) as longest
from kept left join longest using (doc_id)"""


def op9() -> str:
    digit = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    base32 = f"""array_to_string(list_transform(range(0, 32), lambda i: substr({digit},
      1 + ((cast('0x' || substr(h, 1 + 5 * (i // 4)::int, 5) as bigint) >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), '')"""
    return f"""
with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h, min(page_id) over (partition by coalesce(html, '')) as first from pages)
select page_id, strlen(body) as payload_bytes, {base32} as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to from p"""


def op10() -> str:
    q = quality
    ladder = "[" + ", ".join(f"{c}::double" for c in q.LADDER) + "]"
    shares = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "upper": ("n_upper", "word_chars"), "bangs": ("n_bangs", "word_chars")}
    each = " union all ".join(f"select doc_id, stratum, '{r}' as rule, case when {b} > 0 then {a}::double / {b} else 0.0 end as share from m" for r, (a, b) in shares.items())
    return f"""
with d as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t, {WORDS} as w from documents),
runs as (select doc_id, i, count(*) over (partition by doc_id, run) as c from (select doc_id, i, w[i : i + {q.WINDOW - 1}] as run from (select doc_id, w, unnest(range(1, len(w) - {q.WINDOW - 2})) as i from d))),
rep as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest(range(i, i + {q.WINDOW})) as p from runs where c > 1) group by 1),
m as (select doc_id, stratum, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(t) - length(regexp_replace(t, '{q.SYMBOLS}', '', 'g')) as n_symbols,
  len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_upper, length(t) - length(replace(t, '!', '')) as n_bangs
  from (select *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{q.WORD}')) as l from d) left join rep using (doc_id)),
each as ({each}),
held as (select stratum, rule, len({ladder}) - len(list_filter({ladder}, lambda c: c < share)) + 1 as step, quality from each join (select doc_id, min(quality) as quality from labels group by 1) using (doc_id)),
groups as (select stratum, rule, count(*) filter (quality = 1) as n from held group by 1, 2),
tried as (select stratum, rule, n, step, sum(k) over down as k, sum(bad) over down as bad from (
  select stratum, rule, n, step, (select count(*) from held h where h.stratum = g.stratum and h.rule = g.rule and h.step = s.step and quality = 1) as k,
    (select count(*) from held h where h.stratum = g.stratum and h.rule = g.rule and h.step = s.step and quality <> 1) as bad from groups g cross join range(1, {len(q.LADDER)} + 1) s(step))
  window down as (partition by stratum, rule order by step)),
tested as (select *, case when k > n * {q.RISK} then 1.0 else list_sum(list_transform(range(0, k::bigint + 1),
    lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({q.RISK}) + (n - j) * ln(1 - {q.RISK})))) end as p from tried),
certified as (select *, min(p <= {q.ERROR}::double / (select count(*) from groups)) over (partition by stratum, rule order by step) as so_far from tested),
best as (select stratum, rule, {ladder}[step] as cutoff from (select *, row_number() over (partition by stratum, rule order by bad - {q.PRICE} * k desc, step) as rn
  from certified where so_far and bad - {q.PRICE} * k > 0) where rn = 1),
failed as (select doc_id, list(rule order by list_position({list(shares)}, rule)) as failed_rules from each join best using (stratum, rule) where share > cutoff group by 1),
base as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and failed_rules is null as kept,
  coalesce(failed_rules, []::varchar[]) as failed_rules from base left join failed using (doc_id)"""


def op11() -> str:
    return """with r as (
        select row_number() over () as place, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
          list_transform(embedding, lambda x: floor(256 * x::double)) as q
        from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
      s as (select a.place, a.vec_id as anchor_id, r.vec_id, r.place as other, r.label = a.label as same, list_inner_product(a.q, r.q)::bigint as score
        from r a, r where a.vec_id % 100 = 0 and a.place <> r.place),
      p as (select place, anchor_id, vec_id as positive_id, score as positive_score from s where same
        qualify row_number() over (partition by place order by score desc, vec_id nulls last, other) <= 5),
      w as (select distinct place, positive_score from p),
      n as (select w.place, w.positive_score, s.vec_id as negative_id, s.score as negative_score,
          row_number() over (partition by w.place, w.positive_score order by s.score desc, s.vec_id nulls last, s.other)::int as rank
        from w join s on w.place = s.place and not s.same and 80 * w.positive_score <= 100 * s.score and s.score <= w.positive_score qualify rank <= 5)
      select p.anchor_id, p.positive_id, n.rank, n.negative_id, p.positive_score, n.negative_score from p join n using (place, positive_score)"""
