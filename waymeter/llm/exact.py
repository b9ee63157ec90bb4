"""Exact deduplication by a tree-merge of sorted digest runs. DataFrame functions only.

The rows of each input partition form one run: one entry per digest with the smallest (or largest) id and the
number of rows, reduced in the map tasks before anything is sent, so a text with very many copies costs
at most one entry for each task. In every round ``fan_in`` neighbouring runs are merged into one: their entries
are exchanged by ranges of (merged run, digest), sorted there, and neighbours of equal digests become the first of them, with
their rows summed, until a single run is left. An entry is a digest and three numbers, whatever the length of the texts.

Entries are the same when SHA-256, length and a second, unrelated 64-bit hash all agree; the last two
verify every merge at every level, since SHA-256 alone decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymeter.session import pin

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["digest", "length", "proof"]


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else. ``lower`` does that for ASCII texts, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def form_runs(entries: DataFrame, largest: bool = False) -> DataFrame:
    """One entry per run and digest, from entries of single rows; rows of one input partition meet in its map task."""
    pick = F.max if largest else F.min
    return entries.groupBy("run", *KEY).agg(pick("keep").alias("keep"), F.sum("rows").alias("rows"))


def merge_round(entries: DataFrame, fan_in: int, largest: bool = False) -> DataFrame:
    """Merges ``fan_in`` neighbouring runs into one, in digest order.

    The exchange is by range, so the merged runs lie one after the other over all partitions, each in order. The window asks for
    that order and for no exchange of its own; equal entries stand side by side, at most one for each merged run, the wanted id first.
    """
    entries = entries.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).repartitionByRange("run", *KEY)
    wanted = F.col("keep").desc_nulls_last() if largest else F.col("keep").asc_nulls_last()
    equal = Window.partitionBy("run", *KEY).orderBy(wanted)
    everything = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = entries.withColumn("place", F.row_number().over(equal)).withColumn("rows", F.sum("rows").over(everything))
    return merged.where("place = 1").drop("place")


def merge_runs(entries: DataFrame, runs: int, fan_in: int = 16, largest: bool = False) -> DataFrame:
    """``digest, length, proof, keep, rows`` of all runs, from entries with a run number below ``runs``."""
    entries = form_runs(entries, largest)
    while runs > 1:
        entries = merge_round(entries, fan_in, largest)
        runs = -(-runs // fan_in)
    return entries.drop("run")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False, runs: int = 256, fan_in: int = 16) -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256`` for each row.

    Texts are equal when identical after A-Z are lower-cased; a null text counts as empty. Of equal
    texts the row with the smallest id stays (``largest``: the largest). Ids may be of any type that has an order. Rows that repeat the kept id and its text all stay
    equal rows: each is marked kept. Rows with a null id are counted, are kept only if no row of the
    group has an id, and then have a null ``keep_id``. ``runs`` bounds the number of first runs;
    partitions beyond it share a run.
    """
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.select(F.col(id_col).alias("id"), text.alias("t"))
    rows = rows.select(
        "id", F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").alias("length"), F.xxhash64("t").alias("proof"),
        F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"),
    )
    rows = pin(rows, "digests")
    entries = rows.select("run", *KEY, F.col("id").alias("keep"), F.lit(1).cast("long").alias("rows"))
    best = merge_runs(entries, runs, fan_in, largest)
    found = rows.drop("run").join(best, KEY)
    return found.select(
        F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("rows").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
