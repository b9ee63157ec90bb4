"""Secret scanning with a ledger of blobs.

A blob is a text's SHA-256. The ledger has a row for every (blob, rule version) that was ever scanned,
with the spans found, also when there were none. A scan takes the blobs of all versions of all
paths, drops the pairs that the ledger has, scans each remaining blob once, for its missing rules
only, appends to the ledger, and joins the findings back to every path that holds the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymeter.session import exists, pin, scratch

Rules = dict[str, tuple[str, int, int]]
#: Name, pattern, the group that must reach a length, and that length. Matches are found from the left without overlap, then
#: those that are too short are dropped. Only a URL's scheme has an upper bound, since each of its letters begins an attempt of its own.
RULES: Rules = {
    "assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    "url": (r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D:/@]*:([^\x20\x09-\x0D:/@]+)@", 1, 3),
}
BASE = ["assign", "access", "hex"]
BLOB_BYTES = 64  # what a digest may take in a broadcast table
LEDGER = "blob binary, rule string, spans array<struct<start:int,end:int>>"


def version(name: str, rule: tuple[str, int, int]) -> str:
    """The rule's name and a digest of all that decides its findings."""
    return f"{name}@{hashlib.sha256(repr(rule).encode()).hexdigest()[:12]}"


def find(rule: tuple[str, int, int], text: str) -> list[dict[str, int]]:
    """Spans in code points, the end exclusive."""
    pattern, group, least = rule
    return [{"start": m.start(), "end": m.end()} for m in re.finditer(pattern, text, re.ASCII) if m.end(group) - m.start(group) >= least]


def _scan(rules: Rules):
    """``blob, todo, text`` to a ledger row for each pair."""
    by_version = {version(name, rule): rule for name, rule in rules.items()}
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, names, spans = [], [], []
            for blob, todo, text in zip(*(batch.column(c) for c in ("blob", "todo", "text"))):
                whole = text.as_py() or ""
                for name in todo.as_py():
                    blobs.append(blob.as_py())
                    names.append(name)
                    spans.append(find(by_version[name], whole))
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(names, pa.string()), pa.array(spans, span)], ["blob", "rule", "spans"])

    return run


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path) if exists(spark, path) else spark.createDataFrame([], LEDGER)


def _one_each(texts: DataFrame, blobs: DataFrame) -> DataFrame:
    """``blob, text, todo``, once for each unseen blob, however many rows hold it.

    Copies are reduced in the map tasks before they move. Few unseen blobs, by their number, pick their texts out before that.
    """
    limit = int(texts.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    if blobs.count() * BLOB_BYTES <= limit:
        texts = texts.join(F.broadcast(blobs.select("blob")), "blob", "left_semi")
    return texts.groupBy("blob").agg(F.first("text").alias("text")).join(blobs, "blob")


def _extend(df: DataFrame, ledger: str | None, id_col: str, text_col: str, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Appends the missing pairs to the ledger. Returns ``id, blob`` of each row, and ``blob, rule, spans`` where spans were found."""
    spark, wanted = df.sparkSession, [version(*r) for r in rules.items()]
    ledger = ledger or scratch(spark, "ledger")
    text = F.coalesce(F.col(text_col), F.lit(""))
    paths = df.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("blob"))
    seen = read_ledger(spark, ledger).where(F.col("rule").isin(wanted)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = F.array_except(F.array(*map(F.lit, wanted)), F.coalesce("seen", F.array().cast("array<string>")))
    blobs = paths.select("blob").distinct().join(seen, "blob", "left").select("blob", todo.alias("todo"))
    blobs = pin(blobs.where(F.size("todo") > 0), "unseen")
    unseen = _one_each(df.select(F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text")), blobs)
    unseen.mapInArrow(_scan(rules), LEDGER).write.mode("append").parquet(ledger)
    return paths, read_ledger(spark, ledger).where(F.col("rule").isin(wanted) & (F.size("spans") > 0))


def scan(df: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text", rules: Rules = RULES) -> DataFrame:
    """``id, blob, kind, start, end``: a row for each finding of each row's text; extends the ledger when called.

    ``id_col`` names the path and version; it may be null or repeat, and each row gets its own findings once for every
    distinct (id, text); ``blob``, the text's SHA-256, tells the texts of an id apart. Null texts count as empty. ``ledger`` is
    a folder in a store that all executors reach; without one, a new folder in the shared one is used, so everything is scanned.
    """
    paths, found = _extend(df, ledger, id_col, text_col, rules)
    each = found.select("blob", F.substring_index("rule", "@", 1).alias("kind"), F.explode("spans").alias("span"))
    return paths.distinct().join(each, "blob").select(F.col("id").alias(id_col), "blob", "kind", "span.start", "span.end")


def _figures(found: DataFrame, key: str) -> DataFrame:
    """``key, n_assign, n_access, n_hex, base, spans`` from ``key, all``, the sorted findings."""
    listed = lambda keep: F.array_join(F.transform(F.filter("all", keep), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        key, *[count(k).alias(f"n_{k}") for k in BASE],
        listed(lambda s: s["kind"].isin(BASE)).alias("base"), listed(lambda s: F.lit(True)).alias("spans"),
    )


def _filled(joined: DataFrame, id_col: str) -> DataFrame:
    none = F.lit("")
    return joined.select(
        id_col, *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce("base", none), 256).alias("base_sha256"), F.coalesce("spans", none).alias("spans"),
    )


def by_row(df: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_assign, n_access, n_hex, base_sha256, spans`` for each row, of its own text only; extends the ledger when called.

    ``spans`` lists ``kind:start:end`` by start, then kind in the order of ``RULES``. The list is made once for each blob, so it
    is bounded by one text, and joined to the rows by blob: nulls and repeated ids need no care.
    """
    paths, found = _extend(df, ledger, id_col, text_col, RULES)
    order, kind = F.array(*map(F.lit, RULES)), F.substring_index("rule", "@", 1)
    found = found.select("blob", F.array_position(order, kind).alias("rank"), kind.alias("kind"), "spans")
    # A set, since two jobs may have appended the same pair.
    per = found.groupBy("blob").agg(F.collect_set(F.struct("rank", "kind", "spans")).alias("rules"))
    spans = F.flatten(F.transform("rules", lambda r: F.transform(
        r["spans"], lambda s: F.struct(s["start"].alias("start"), r["rank"].alias("rank"), s["end"].alias("end"), r["kind"].alias("kind")))))
    per = _figures(per.select("blob", F.array_sort(spans).alias("all")), "blob")
    return _filled(paths.join(per, "blob", "left").drop("blob").withColumnRenamed("id", id_col), id_col)


def summary(df: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The figures of :func:`by_row` by id instead of by text, built from :func:`scan`.

    Rows of one id with several texts are summed up together; rows with a null id too. All findings of an id
    meet in one row, so where ids are null or repeat often, use :func:`by_row`.
    """
    order = F.array(*map(F.lit, RULES))
    found = scan(df, ledger, id_col, text_col).withColumn("rank", F.array_position(order, F.col("kind")))
    per = found.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("all"))
    per = _figures(per.withColumnRenamed(id_col, "_id"), "_id")
    return _filled(df.select(F.col(id_col).cast("long").alias(id_col)).join(per, F.col(id_col).eqNullSafe(F.col("_id")), "left"), id_col)
