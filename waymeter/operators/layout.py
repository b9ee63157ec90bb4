"""Ordered work without one-task windows.

``row_number() over (order by …)``, or the same partitioned by a key that holds a large
share of the rows, puts that share into one task. These operators range-partition on the
full sort order instead, so that even one hot key spreads over many slabs, and carry only
one summary row per slab (or per slab and key) across slab borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymeter.session import pin

SLAB_BITS = 33  # monotonically_increasing_id keeps the partition number above this bit


def lay_out(df: DataFrame, *order: Column | str) -> DataFrame:
    """Sort globally and freeze the result with ``_slab`` and ``_idx`` (0-based in the slab).

    Eager: the sorted rows are written to the shared folder when this is called.

    ``order`` should end in a unique column, so that no slab is forced to hold all ties.
    """
    laid = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_slab", F.shiftright("_at", SLAB_BITS))
        .withColumn("_idx", F.col("_at").bitwiseAND(F.lit((1 << SLAB_BITS) - 1)))
        .drop("_at")
    )
    return pin(laid, "slabs")


def slab_offsets(laid: DataFrame) -> DataFrame:
    """``_slab, _off``: rows in earlier slabs. One row per slab, so one small window."""
    w = Window.orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    return (
        laid.groupBy("_slab")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_slab", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    )


def number_rows(df: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """1-based position of each row in its key group (or overall when ``keys`` is empty)."""
    laid = lay_out(df, *keys, *order)
    placed = laid.join(slab_offsets(laid), "_slab").withColumn("_pos", F.col("_off") + F.col("_idx"))
    if not keys:
        return placed.withColumn(name, F.col("_pos") + 1).drop("_slab", "_idx", "_off", "_pos")
    # One row per (slab, key) reaches the shuffle; the key's first position comes from it.
    firsts = placed.groupBy(*keys).agg(F.min("_pos").alias("_first"))
    firsts = firsts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_first")
    same = [placed[k].eqNullSafe(firsts[f"_k_{k}"]) for k in keys]
    return (
        placed.join(firsts, same)
        .withColumn(name, F.col("_pos") - F.col("_first") + 1)
        .drop("_slab", "_idx", "_off", "_pos", "_first", *[f"_k_{k}" for k in keys])
    )


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` within each key, in ``order``."""
    return _running_sum(lay_out(df, *keys, *order), keys, value, name)


def _running_sum(laid: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    inside = Window.partitionBy("_slab", *keys).orderBy("_idx")
    local = laid.withColumn("_local", F.sum(value).over(inside))
    across = (
        Window.partitionBy(*keys).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        laid.groupBy("_slab", *keys)
        .agg(F.sum(value).alias("_part"))
        .withColumn("_carry", F.coalesce(F.sum("_part").over(across), F.lit(0)))
        .select(F.col("_slab").alias("_s"), *[F.col(k).alias(f"_k_{k}") for k in keys], "_carry")
    )
    same = [local["_slab"] == carry["_s"]]
    same += [local[k].eqNullSafe(carry[f"_k_{k}"]) for k in keys]
    return (
        local.join(carry, same)
        .withColumn(name, F.col("_local") + F.col("_carry"))
        .drop("_slab", "_idx", "_local", "_s", "_carry", *[f"_k_{k}" for k in keys])
    )


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, points: list[float]
) -> DataFrame:
    """Exact linear-interpolation percentiles per key: ``*keys, _n, _p, _q``, one row per point.

    Equal values are counted before the shuffle, the distinct values are ranked by
    :func:`running_sum`, and each key's answer is a conditional ``min`` over those ranks.
    No task ever holds a whole key.
    """
    counted = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    )
    laid = lay_out(counted, *keys, value)
    ranked = _running_sum(laid, keys, "_c", "_cum")
    sizes = laid.groupBy(*keys).agg(F.sum("_c").alias("_size"))  # without ranking a second time
    if keys:
        sized = ranked.join(
            sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_size"),
            [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys],
        )
    else:
        sized = ranked.withColumn("_size", sizes.scalar())
    picks = []
    for i, p in enumerate(points):
        pos = F.lit(float(p)) * (F.col("_size") - 1)
        picks.append(F.min(F.when(F.col("_cum") > F.floor(pos), F.col(value))).alias(f"_lo{i}"))
        picks.append(F.min(F.when(F.col("_cum") > F.ceil(pos), F.col(value))).alias(f"_hi{i}"))
    picked = sized.groupBy(*keys).agg(F.max("_size").alias("_size"), *picks)
    found = []
    for i, p in enumerate(points):
        pos = F.lit(float(p)) * (F.col("_size") - 1)
        lo, hi = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        found.append(
            F.struct(F.lit(float(p)).alias("_p"), (lo + (hi - lo) * (pos - F.floor(pos))).alias("_q"))
        )
    out = picked.select(*keys, F.col("_size").alias("_n"), F.explode(F.array(*found)).alias("_f"))
    return out.select(*keys, "_n", "_f._p", "_f._q")


def percentiles_wide(
    df: DataFrame, keys: list[str], value: str, points: dict[str, float], count: str = "n"
) -> DataFrame:
    """:func:`exact_percentiles` with one named column per point and the row count."""
    long = exact_percentiles(df, keys, value, list(points.values()))
    cols = [
        F.max(F.when(F.col("_p") == F.lit(float(p)), F.col("_q"))).alias(name)
        for name, p in points.items()
    ]
    return long.groupBy(*keys).agg(F.max("_n").alias(count), *cols)


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column | str], k: int, unique: str, name: str = "_rn",
    salts: int | None = None,
) -> DataFrame:
    """The first ``k`` rows of each group, numbered. ``order`` ends in a unique column.

    A hot group is first cut to ``k`` rows in each of ``salts`` salted parts (as many as there are shuffle
    partitions), where Spark keeps no more than ``k`` rows of a part in its map tasks. It does so up to a
    threshold of its own; beyond it the rows are numbered over range-sorted slabs, which gives the same
    numbers and splits any group.
    """
    conf = df.sparkSession.conf
    if k > int(conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        return number_rows(df, keys, order, name).withColumn(name, F.col(name).cast("long")).where(F.col(name) <= k)
    salts = salts or int(conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(unique), F.lit(salts)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    first = salted.withColumn("_cut", F.row_number().over(part)).where(F.col("_cut") <= k)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        first.withColumn(name, F.row_number().over(whole).cast("long"))
        .where(F.col(name) <= k)
        .drop("_salt", "_cut")
    )
