"""Shards of nearly equal size from sampled splitters.

1. Keys are (CRC-32 of the text, id, a running number), so equal texts are neighbours and stay together
   where a border does not part them. A sample of keys, drawn with a probability in proportion to
   the size, gives splitters at its quantiles, one for each range.
2. Ranges that hold too many records are subdivided by a sample of their own, as often as needed. Every other such
   round draws by records, not by size, so that a few huge records cannot keep a range of many small ones whole.
   Since keys are unique, even one text with very many copies is divided.
3. Sums over the ranges, one row each, place every range exactly, and a running sum inside a range
   places its records, so shards are cut at exact shares of all bytes whatever the sample was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymeter.session import pin

SAMPLE, RANGES = 8192, 64  # keys drawn in expectation for a range that is divided, and its parts
RANGE_ROWS = 1 << 17  # a range with more records is divided
KEY = ["crc", "id", "tie"]


def _divide(rows: DataFrame, most: int, seed: int, by_size: bool) -> DataFrame | None:
    """Numbers the parts of ranges above ``most`` records, keeping key order; None if there are none.

    Keys are drawn with a probability in proportion to their size or, if not ``by_size``, all alike. In the latter case a range with more than one
    record that is drawn whole is surely divided, and a larger one but for a chance that vanishes.
    """
    sums = rows.groupBy("rng").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    full = sums.where(F.col("n") > most).select("rng", F.col("bytes" if by_size else "n").alias("all"))
    full = pin(full, "full")
    if full.isEmpty():
        return None
    weight = F.col("size") if by_size else F.lit(1)
    drawn = rows.join(full, "rng").where(F.rand(seed) < weight * SAMPLE / F.col("all"))
    tiles = drawn.select("rng", F.struct(*KEY).alias("key"), F.ntile(RANGES).over(Window.partitionBy("rng").orderBy(*KEY)).alias("tile"))
    cuts = tiles.where("tile > 1").groupBy("rng", "tile").agg(F.min("key").alias("cut"))
    cuts = pin(cuts.groupBy("rng").agg(F.collect_list("cut").alias("cuts")), "cuts")  # one row a range, fewer than RANGES cuts each
    part = F.size(F.filter("cuts", lambda c: c <= F.struct(*KEY)))
    held = rows.join(cuts, "rng", "left")
    return pin(held.withColumn("rng", F.col("rng") * RANGES + F.when(F.col("cuts").isNull(), 0).otherwise(part)).drop("cuts"), "ranges")


def shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 8, seed: int = 11, most: int = RANGE_ROWS) -> DataFrame:
    """``id, size, text_crc32, law, shard, slot, grown_shard`` for each row.

    ``size`` is the text's UTF-8 bytes (none for null) plus 1. The law is ``bytes``: a record lies in the
    shard that holds its middle when all sizes are lined up in key order, so a shard is off the mean by
    half a record at each end at most. ``slot`` counts from 0 in each shard without gaps, in key order.
    ``grown_shard`` is null under this law. Rows with null ids come first among equal texts; repeated rows
    are told apart by a running number. Empty input gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("crc"))
    rows = pin(rows.withColumn("tie", F.monotonically_increasing_id()).withColumn("rng", F.lit(0).cast("long")), "sizes")
    rows = _divide(rows, 0, seed, True) or rows  # an empty table has no range
    turn = 1
    while (finer := _divide(rows, max(most, 1), seed + turn, turn % 2 == 0)) is not None:
        rows, turn = finer, turn + 1
    sums = rows.groupBy("rng").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    before = Window.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = sums.select("rng", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows0"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes0"))
    inside = Window.partitionBy("rng").orderBy(*KEY)
    run = rows.withColumn("row", F.row_number().over(inside) - 1).withColumn("upto", F.sum("size").over(inside))
    total = rows.agg(F.sum("size").alias("total")).scalar()
    middle = 2 * (F.col("bytes0") + F.col("upto")) - F.col("size")
    cut = run.join(starts, "rng").select(
        "id", "size", "crc", (F.col("rows0") + F.col("row")).alias("row"), F.least(F.floor(middle * n / (2 * total)), F.lit(n - 1)).cast("int").alias("shard")
    )
    cut = pin(cut, "shards")
    firsts = cut.groupBy("shard").agg(F.min("row").alias("first")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "first")))).scalar()
    return cut.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.element_at(firsts, F.col("shard"))).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
