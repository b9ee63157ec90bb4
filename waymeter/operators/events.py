"""From log events to one row per request, and from requests to workload items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymeter import fixed
from waymeter.functions.text import content_key, ts_ms, untruncate
from waymeter.operators.layout import lay_out
from waymeter.session import pin
from waymeter.sources.readers import prompt_keyed


def _attr(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("attributes", path, kind)


def _user_messages(any_role: bool = False) -> Column:
    messages = F.coalesce(_attr("$.messages", "array<variant>"), F.array().cast("array<variant>"))
    if any_role:
        return messages
    return F.filter(
        messages,
        lambda m: F.coalesce(F.lower(F.try_variant_get(m, "$.role", "string")) == "user", F.lit(False)),
    )


def _content(message: Column) -> Column:
    """Digest of a message's text, the text itself if the log had truncated it, and whether it had.

    A whole text is only ever looked up by equality, so its digest travels instead.
    """
    kind = F.schema_of_variant(F.try_variant_get(message, "$.content", "variant"))
    cut = F.startswith(kind, F.lit("OBJECT"))
    whole = F.try_variant_get(message, "$.content", "string")
    short = untruncate(F.coalesce(F.try_variant_get(message, "$.content.truncatedString", "string"), F.lit("")))
    text = F.when(cut, short).otherwise(F.coalesce(whole, F.lit("")))
    return F.struct(
        content_key(text).alias("key"), F.when(cut, short).alias("text"), F.coalesce(cut, F.lit(False)).alias("cut")
    )


def typed_events(events: DataFrame, epoch_millis: bool = False) -> DataFrame:
    """The fields each event type contributes, still one row per event; the texts of replies and cut prompts are columns of their own."""
    kind = F.col("type")
    asked, routed, replied = (
        kind == fixed.CHAT_REQUEST, kind == fixed.MODEL_ROUTING, kind == fixed.CHAT_RESPONSE,
    )
    users = _user_messages()
    fallback = routed & F.coalesce(_attr("$.decision_source") == "fallback", F.lit(False))
    final = F.nullif(_attr("$.response.extra_args.model_routing.final_model"), F.lit(""))
    reply = F.struct(
        ts_ms("raw_ts", epoch_millis).alias("t"),
        _attr("$.response.extra_args.promptTokens", "long").alias("prompt_tokens"),
        _attr("$.response.extra_args.completionTokens", "long").alias("completion_tokens"),
        _attr("$.response.extra_args.model_name").alias("model_name"),
    )
    answer = F.substring(F.coalesce(_attr("$.response.content"), F.lit("")), 1, fixed.ANSWER_CHARS)
    choice = F.struct(
        _attr("$.selected_model").alias("selected_model"),
        _attr("$.decision_source").alias("decision_source"),
        _attr("$.decision_ms", "double").alias("decision_ms"),
        _attr("$.metadata.judge_prompt_tokens", "long").alias("judge_prompt_tokens"),
        _attr("$.metadata.judge_completion_tokens", "long").alias("judge_completion_tokens"),
        _attr("$.score", "double").alias("win_rate"),
    )
    rid = F.when(asked, F.col("event_id")).otherwise(_attr("$.request_id"))
    return events.where(asked | routed | replied).select(
        F.coalesce(rid, F.lit("None")).alias("request_id"),
        "pos",
        F.when(asked, F.struct(ts_ms("raw_ts", epoch_millis).alias("t"))).alias("asked"),
        F.when(asked & (F.size(users) > 0), _content(F.element_at(users, -1))).alias("prompt"),
        F.when(routed & ~fallback, choice).alias("choice"),
        F.when(replied, reply).alias("reply"),
        F.when(replied, answer).alias("answer"),
        fallback.alias("is_fallback"),
        F.when(fallback, F.struct(_attr("$.selected_model").alias("m")))
        .when(replied & final.isNotNull(), F.struct(final.alias("m")))
        .alias("final"),
    )


LAST = ["asked", "prompt", "choice", "reply", "final"]


def states(typed: DataFrame) -> DataFrame:
    """One mergeable row per request id: of each kind of event the last one and its position."""

    def last(name: str) -> Column:
        return F.max_by(F.struct("pos", F.col(name).alias("v")), F.when(F.col(name).isNotNull(), F.col("pos"))).alias(name)

    return typed.groupBy("request_id").agg(*map(last, LAST), F.bool_or("is_fallback").alias("fell_back"))


def merged(some: DataFrame) -> DataFrame:
    """The states of several parts of a log as those of the whole."""
    return some.groupBy("request_id").agg(*[F.max_by(n, F.col(f"{n}.pos")).alias(n) for n in LAST], F.bool_or("fell_back").alias("fell_back"))


def _rows(last: DataFrame, arm: Column | str) -> DataFrame:
    """States to rows; whole ``prompt`` and ``reply`` structs are left for the caller to take apart."""
    folded = last.select("request_id", *[F.col(f"{n}.v").alias(n) for n in LAST], "fell_back")
    t0, t1 = F.nullif(F.col("asked.t"), F.lit(0.0)), F.nullif(F.col("reply.t"), F.lit(0.0))
    unset = F.coalesce(F.nullif(F.col("choice.selected_model"), F.lit("")), F.col("reply.model_name"))
    return folded.select(
        "request_id",
        (arm if isinstance(arm, Column) else F.lit(arm)).alias("arm"),
        "choice.*",
        F.when(F.col("fell_back"), F.lit(True)).alias("fallback_attempted"),
        F.when(F.col("final").isNull(), unset).otherwise(F.col("final.m")).alias("final_model"),
        F.col("reply.prompt_tokens").alias("prompt_tokens"),
        F.col("reply.completion_tokens").alias("completion_tokens"),
        F.col("reply.model_name").alias("model_name"),
        (t1 - t0).alias("e2e_ms"),
        F.col("prompt.key").alias("prompt_key"),
        F.coalesce(F.col("prompt.cut"), F.lit(False)).alias("prompt_cut"),
        "prompt", "reply",
    )


def with_texts(typed: DataFrame) -> DataFrame:
    """Puts answers into the replies, for a fold that carries them."""
    return typed.withColumn("reply", F.when(F.col("reply").isNotNull(), F.struct("reply.*", "answer")))


def finish(last: DataFrame, arm: Column | str) -> DataFrame:
    """States that carry texts to folded rows."""
    texts = {"answer": F.col("reply.answer"), "prompt_text": F.col("prompt.text")}
    return _rows(last, arm).withColumns(texts).drop("prompt", "reply")


def fold_events(events: DataFrame, arm: Column | str, epoch_millis: bool = False) -> DataFrame:
    """One row per request id with any event; the last event of each type wins whole.

    One shuffle on request_id. Each map task reduces a request's events first, so a request
    id that repeats in a third of the log reaches the shuffle once per task.
    """
    return finish(states(with_texts(typed_events(events, epoch_millis))), arm)


class FoldedLog:
    """A log folded without its texts, which are fetched for the rows that need them.

    The log is parsed once and its typed events are written, each with a number. The fold carries numbers, digests and
    the event numbers of the winning reply and prompt. :meth:`answers` and :meth:`prompts` look texts up by event number in the written
    table, of which only these two columns are read. So answers move once, whatever is joined to the rows before.
    """

    def __init__(self, events: DataFrame, arm: Column | str, epoch_millis: bool = False) -> None:
        typed = typed_events(events, epoch_millis).withColumn("at", F.monotonically_increasing_id())
        self.events = pin(typed, "typed")
        reply = F.when(F.col("reply").isNotNull(), F.struct("reply.*", "at"))
        prompt = F.when(F.col("prompt").isNotNull(), F.struct("prompt.key", "prompt.cut", "at"))
        narrow = self.events.select("request_id", "pos", "asked", prompt.alias("prompt"), "choice", reply.alias("reply"), "is_fallback", "final")
        places = {"answer_at": F.col("reply.at"), "prompt_at": F.col("prompt.at")}
        self.rows = pin(_rows(states(narrow), arm).withColumns(places).drop("prompt", "reply"), "folded")

    def _fetched(self, rows: DataFrame, place: str, text: Column, name: str) -> DataFrame:
        texts = self.events.select(F.col("at").alias("_at"), text.alias(name)).where(F.col(name).isNotNull())
        # Rows without a place are spread over places that no event has.
        none = -1 - F.pmod(F.xxhash64("request_id"), F.lit(1 << 40))
        return rows.withColumn("_place", F.coalesce(place, none)).join(texts, F.col("_place") == F.col("_at"), "left").drop("_place", "_at")

    def answers(self, rows: DataFrame) -> DataFrame:
        """Adds ``answer``."""
        return self._fetched(rows, "answer_at", F.col("answer"), "answer")

    def prompts(self, rows: DataFrame) -> DataFrame:
        """Adds ``prompt_text``, the beginning that the log has of a cut prompt."""
        return self._fetched(rows, "prompt_at", F.col("prompt.text"), "prompt_text")


def match_prefixes(probes: DataFrame, items: DataFrame) -> DataFrame:
    """``prefix, id, slice`` for each prefix that exactly one item's prompt starts with.

    In sorted order the prompts sharing a prefix follow it directly, so a prefix has exactly
    one hit when the next prompt starts with it and the one after does not. Probes and items
    are therefore sorted together once, and each probe looks two items ahead. Prompts that
    share a long template never meet pairwise, and prefixes may have any mix of lengths.
    """
    item = F.struct(F.col("prompt").alias("p"), F.col("id").alias("id"), F.col("slice").alias("slice"))
    both = probes.select(F.col("prefix").alias("s"), F.lit(0).alias("kind"), F.lit(None).alias("item")).distinct()
    both = both.unionByName(
        items.select(F.col("prompt").alias("s"), F.lit(1).alias("kind"), item.alias("item"))
    )
    laid = lay_out(both, "s", "kind")
    back = Window.partitionBy("_slab").orderBy(F.desc("_idx"))
    before = back.rowsBetween(Window.unboundedPreceding, -1)
    here = laid.withColumn("next1", F.last("item", ignorenulls=True).over(before))
    pair = F.when(F.col("item").isNotNull(), F.struct(F.col("item").alias("a"), F.col("next1").alias("b")))
    here = here.withColumn("pair", F.last(pair, ignorenulls=True).over(before)).where("kind = 0")
    # The first two items of each slab, then of everything after a slab: one row per slab.
    marked = F.when(F.col("kind") == 1, F.col("_idx"))
    heads = laid.groupBy("_slab").agg(F.min_by("item", marked).alias("h1"), F.min(marked).alias("i1"))
    seconds = (
        laid.join(heads.select("_slab", "i1"), "_slab")
        .where((F.col("kind") == 1) & (F.col("_idx") > F.col("i1")))
        .groupBy("_slab")
        .agg(F.min_by("item", "_idx").alias("h2"))
    )
    heads = heads.join(seconds, "_slab", "left")
    later = Window.orderBy(F.desc("_slab")).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("l1", F.last("h1", ignorenulls=True).over(later))
    # Two ahead of a slab: the second item of the slab that gave l1, or that slab's own l1.
    two = F.when(
        F.col("h1").isNotNull(), F.struct(F.coalesce(F.col("h2"), F.col("l1")).alias("v"))
    )
    heads = heads.withColumn("l2", F.last(two, ignorenulls=True).over(later)["v"]).select("_slab", "l1", "l2")
    found = here.join(heads, "_slab").select(
        F.col("s").alias("prefix"),
        F.coalesce(F.col("pair.a"), F.col("l1")).alias("one"),
        F.when(F.col("pair").isNotNull(), F.coalesce(F.col("pair.b"), F.col("l1")))
        .otherwise(F.col("l2"))
        .alias("two"),
    )
    hit = F.coalesce(F.startswith(F.col("one.p"), F.col("prefix")), F.lit(False))
    more = F.coalesce(F.startswith(F.col("two.p"), F.col("prefix")), F.lit(False))
    return found.where(hit & ~more).select("prefix", F.col("one.id").alias("id"), F.col("one.slice").alias("slice"))


def join_prefix(rows: DataFrame, requests: DataFrame, text: str = "prompt_text") -> DataFrame:
    """Add ``workload_id, slice`` where the truncated text is a prefix of exactly one prompt."""
    items = prompt_keyed(requests, texts=True).select("prompt", "id", "slice")
    hits = match_prefixes(rows.select(F.col(text).alias("prefix")).where(F.col(text).isNotNull()), items)
    hits = hits.select(content_key("prefix").alias("_key"), F.col("id").alias("_id"), F.col("slice").alias("_sl"))
    return _attach(rows.withColumn("_key", content_key(text)), hits)


def join_exact(rows: DataFrame, requests: DataFrame, key: str = "prompt_key", pos: Column | str | None = None) -> DataFrame:
    """Add ``workload_id, slice`` by exact prompt; both sides meet on digests, not on texts."""
    items = prompt_keyed(requests, pos).select("_key", F.col("id").alias("_id"), F.col("slice").alias("_sl"))
    return _attach(rows.withColumn("_key", F.col(key)), items)


def _attach(rows: DataFrame, items: DataFrame) -> DataFrame:
    return (
        rows.join(items, "_key", "left")
        .withColumn("workload_id", F.coalesce("_id", F.lit("")))
        .withColumn("slice", F.coalesce("_sl", F.lit("")))
        .drop("_key", "_id", "_sl")
    )


def join_workload(log: FoldedLog, requests: DataFrame, pos: Column | str | None = None) -> DataFrame:
    """Workload item of each folded row: exact for whole prompts, by unique prefix for cut ones.

    Rows whose request event carried no user message keep a null item. Only the beginnings of cut prompts are fetched.
    """
    exact = join_exact(log.rows.where(~F.col("prompt_cut")), requests, pos=pos)
    cut = join_prefix(log.prompts(log.rows.where("prompt_cut")), requests).drop("prompt_text")
    none = F.col("prompt_key").isNull()
    return exact.unionByName(cut).withColumns({
        "workload_id": F.when(~none, F.col("workload_id")),
        "slice": F.when(~none, F.col("slice")),
    })


def results(events: DataFrame, requests: DataFrame, arm: Column | str) -> DataFrame:
    """The results table of one log. Answers are fetched last."""
    log = FoldedLog(events, arm)
    return log.answers(join_workload(log, requests)).select(*fixed.RESULT_COLUMNS)


def decisions(events: DataFrame, requests: DataFrame, any_role: bool = False) -> DataFrame:
    """``workload_id, model``: the last non-fallback decision of each item.

    ``any_role`` reads every message of a request instead of the last user message; in both
    forms truncated texts are unwrapped and must then match a prompt exactly.
    """
    messages = _user_messages(any_role)
    asked = events.where(F.col("type") == fixed.CHAT_REQUEST)
    if any_role:
        texts = asked.select("event_id", "pos", F.posexplode(messages).alias("at", "m"))
    else:
        texts = asked.select(
            "event_id", "pos", F.lit(0).alias("at"), F.try_element_at(messages, F.lit(-1)).alias("m")
        ).where(F.col("m").isNotNull())
    texts = texts.select("event_id", F.struct("pos", "at").alias("o"), _content(F.col("m"))["key"].alias("_key"))
    items = prompt_keyed(requests).select("_key", F.col("id").alias("workload_id"))
    owner = (
        texts.join(items, "_key").groupBy("event_id").agg(F.max_by("workload_id", "o").alias("workload_id"))
    )
    chosen = (
        events.where(
            (F.col("type") == fixed.MODEL_ROUTING)
            & F.coalesce(_attr("$.decision_source") != "fallback", F.lit(True))
        )
        .groupBy(_attr("$.request_id").alias("event_id"))
        .agg(
            F.max_by(
                F.struct(_attr("$.selected_model").alias("model"), _attr("$.decision_ms", "double").alias("decision_ms")), "pos"
            ).alias("d"),
            F.min("pos").alias("first"),
        )
    )
    joined = chosen.join(owner, "event_id")
    return joined.groupBy("workload_id").agg(F.max_by("d", "first").alias("d")).select("workload_id", "d.*")


def pair(requests: DataFrame, responses: DataFrame, pos: str = "pos") -> DataFrame:
    """Request and response by request id with ``e2e_ms`` (times in epoch ms, zero counts as unset).

    Of repeated events the last by ``pos`` counts, whatever its time.
    """
    a = requests.groupBy("request_id").agg(F.max_by("t_request", pos).alias("t_request"))
    b = responses.groupBy("request_id").agg(F.max_by("t_response", pos).alias("t_response"))
    both = a.where("t_request <> 0").join(b.where("t_response <> 0"), "request_id")
    return both.withColumn("e2e_ms", F.col("t_response") - F.col("t_request"))
