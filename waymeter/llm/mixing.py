"""Mixing sources to target weights by hierarchical budgets.

The budget in tokens flows down a tree (domain, then language, then source). A node's budget is shared among its
children by weight, but no child gets more than all of its leaves can give in the allowed epochs. What a child
cannot use goes to its siblings by their weights, and only what a whole family cannot use has gone to the family's own
siblings, since a family's capacity is the sum of its leaves'. A leaf then reads whole epochs, and a
prefix of one more: documents in a seeded order of that epoch, as long as their tokens fit.

All arithmetic is in whole tokens; a family may leave fewer tokens unused than it has children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymeter.session import pin

BUCKET_ROWS = 1024  # documents of a leaf that are ordered together
BLOCK_BUCKETS = 1024  # buckets of a leaf that are summed together
WIDE = "decimal(38,0)"


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``got`` to ``*parent, name, cap, weight, budget``: water is filled up to each child's cap, in one pass.

    Children stand in the order of cap per weight. Those before the first that is not filled get their cap; the
    rest divide what is left by weight. Only nodes are ordered here, one row for each.
    """
    live, cap, weight = F.col("weight") > 0, F.col("cap").cast(WIDE), F.col("weight").cast(WIDE)
    order = [F.col("cap") / F.when(live, F.col("weight")), F.col(name)]
    family = Window.partitionBy(*parent, live).orderBy(*order)
    before = F.coalesce(F.sum(cap).over(family.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum(weight).over(family.rowsBetween(0, Window.unboundedFollowing))
    nodes = nodes.withColumn("filled", live & (cap * weights <= weight * (F.col("budget").cast(WIDE) - before)))
    whole = Window.partitionBy(*parent, live)
    left = F.col("budget").cast(WIDE) - F.sum(F.when(F.col("filled"), cap).otherwise(0)).over(whole)
    rest = F.sum(F.when(F.col("filled"), 0).otherwise(weight)).over(whole)
    nodes = nodes.withColumn("left", left.cast(WIDE)).withColumn("rest", rest.cast(WIDE))
    shared = F.when(F.col("rest") > 0, F.expr("cast(left * cast(weight as decimal(18,0)) div rest as bigint)")).otherwise(F.lit(0))
    return nodes.withColumn("got", F.when(~live, F.lit(0)).when(F.col("filled"), F.col("cap")).otherwise(shared).cast("long")).drop("filled", "left", "rest")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], share: tuple[int, int], epochs: int) -> DataFrame:
    """``*levels, tokens, docs, got`` from ``*levels, tokens, docs``: the tokens each leaf may give.

    The root's budget is ``share`` (a fraction) of all tokens, at most what all leaves can give.
    ``weights`` has a whole number for a name on a level; names without one weigh 1, a weight of 0 shuts a node out.
    """
    def weight(level: str) -> Column:
        out = F.lit(1)
        for value, number in sorted(weights.get(level, {}).items()):
            out = F.when(F.col(level) == value, F.lit(int(number))).otherwise(out)
        return out

    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    total = leaves.agg(F.sum("tokens")).scalar()
    budget = F.floor(F.lit(int(share[0])) * total / F.lit(int(share[1])))
    given = None
    for depth, level in enumerate(levels):
        parent = levels[:depth]
        nodes = leaves.groupBy(*levels[: depth + 1]).agg(F.sum("cap").alias("cap")).withColumn("weight", weight(level))
        nodes = nodes.join(given, parent) if parent else nodes.withColumn("budget", budget)
        given = _share_out(nodes, parent, level).select(*levels[: depth + 1], F.col("got").alias("budget"))
    return leaves.join(given, levels).select(*levels, "tokens", "docs", F.col("budget").alias("got"))


def mix(
    df: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], share: tuple[int, int] = (1, 1), epochs: int = 4, seed: int = 17,
    id_col: str = "doc_id", tokens: Column | None = None, row_col: str | None = None,
) -> DataFrame:
    """``id, *levels, tokens, leaf_tokens, leaf_budget, copies, border_tokens`` for each row.

    ``levels`` names the tree's levels from the root down, each with its column; null values count as empty text, so they form
    leaves of their own. ``copies`` tells how often a row is taken: once in every whole epoch, and once more if it lies in the
    prefix of the next one. ``border_tokens`` tells how many tokens are taken from the start of the one row of a leaf that the prefix ends in,
    0 elsewhere; with it, each leaf with tokens gives exactly its budget. ``tokens`` counts a row's tokens (words of ``text`` by default); rows without tokens are taken
    with the prefix they lie in. Rows with a null or repeated id are ordered by their tokens where the seeded order ties,
    then by ``row_col``, a number of the caller's for each row, which is passed on.
    """
    names, own = [*levels], [] if row_col is None else [row_col]
    rows = df.select(
        *own,
        F.col(id_col).cast("long").alias("id"), *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()],
        (count_words(F.col("text")) if tokens is None else tokens.cast("long")).alias("tokens"),
    )
    rows = pin(rows, "tokens")
    leaves = rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    given = pin(budgets(leaves, names, weights, share, epochs), "budgets").withColumnRenamed("tokens", "leaf_tokens")
    whole = F.when(F.col("leaf_tokens") > 0, F.expr("got div leaf_tokens")).otherwise(F.lit(0))
    given = given.withColumn("whole", whole).withColumn("over", F.col("got") - F.col("whole") * F.col("leaf_tokens"))
    given = given.withColumn("buckets", F.ceil(F.col("docs") / BUCKET_ROWS))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    placed = rows.join(given, names).withColumn("key", key)
    # The seeded order is uniform, so its leading bits cut a leaf of any size into buckets of like size.
    placed = placed.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("buckets") / F.lit(1 << 32)))
    sums = placed.groupBy(*names, "bucket").agg(F.sum("tokens").alias("part"))
    sums = sums.withColumn("block", F.floor(F.col("bucket") / BLOCK_BUCKETS))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.groupBy(*names, "block").agg(F.sum("part").alias("part"))
    blocks = blocks.select(*names, "block", F.coalesce(F.sum("part").over(earlier(*names).orderBy("block")), F.lit(0)).alias("base"))
    sums = sums.withColumn("inner", F.coalesce(F.sum("part").over(earlier(*names, "block").orderBy("bucket")), F.lit(0)))
    sums = sums.join(blocks, [*names, "block"]).select(*names, "bucket", (F.col("base") + F.col("inner")).alias("ahead"))
    inside = Window.partitionBy(*names, "bucket").orderBy("key", "tokens", *own).rowsBetween(Window.unboundedPreceding, 0)
    run = placed.withColumn("upto", F.sum("tokens").over(inside)).join(sums, [*names, "bucket"])
    upto = F.col("ahead") + F.col("upto")
    taken = (F.col("got") > 0) & (upto <= F.col("over"))
    border = F.when(taken | (F.col("got") <= 0), 0).otherwise(F.greatest(F.col("over") - (upto - F.col("tokens")), F.lit(0)))
    return run.select(
        *own, F.col("id").alias(id_col), *names, "tokens", "leaf_tokens", F.col("got").alias("leaf_budget"),
        (F.col("whole") + F.when(taken, 1).otherwise(0)).cast("long").alias("copies"), border.cast("long").alias("border_tokens"),
    )
