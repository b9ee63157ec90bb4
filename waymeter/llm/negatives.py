"""Hard negatives by the threshold algorithm over sorted lists, one per dimension.

Candidates are dealt into blocks of bounded size. A block's index holds its vectors and, for each
dimension, its candidates in rising order. An anchor walks the lists of a block side by side, from the
top where its own component is positive and from the bottom where it is negative, so each list gives the candidates in
falling order of what that dimension adds to the score. Every candidate met is looked up and scored whole, in
whole numbers. What the lists' current places add up to bounds the score of all candidates not met yet: once it is
strictly below the kth score of each wanted window (or below the window itself), the block is done.

Anchors meet all blocks, in blocks of their own, and keep k candidates of each. The search runs twice: for
positives, whose only window is open, and for negatives, with one window for each positive's score.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymeter.session import pin

BLOCK, ANCHORS = 4096, 2048  # rows of a block of candidates, of a block of anchors
FIRST = 16  # places of each list that are read at first; then as many again as before
LEAST, MOST = -(1 << 63), (1 << 63) - 1
INDEX = "block long, n long, ids binary, unnamed binary, rows binary, labels binary, vectors binary, kind string, orders binary, order_kind string"
FOUND = "anchor long, high long, score long, id long, row long"


def matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of whole numbers as rows; shorter ones end in zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def smallest(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest type that holds them."""
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    for kind in (np.int8, np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return values.astype(kind)
    return values


class Candidates:
    """A block: identifiers, labels and vectors, and the candidates of each dimension in rising order."""

    def __init__(self, ids: np.ndarray, unnamed: np.ndarray, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray, orders: np.ndarray):
        self.ids, self.unnamed, self.rows, self.labels, self.orders = ids, unnamed, rows, labels, orders
        self.largest = np.abs(vectors.astype(np.float64)).max(axis=0, initial=0)
        self.whole, self.forms = vectors, {}

    def exact(self, anchor: np.ndarray) -> np.ndarray:
        """The vectors in a type in which no sum of products with this anchor is rounded."""
        most = float(np.abs(anchor.astype(np.float64)) @ self.largest)
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object
        if kind not in self.forms:
            self.forms[kind] = self.whole.astype(kind)
        return self.forms[kind]

    def search(self, anchor: np.ndarray, eligible: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each window (low, high): (score, place) of the first k eligible candidates with a score inside.

        Higher scores come first, then smaller identifiers, null ones last, then rows.
        """
        n = len(self.ids)
        vectors = self.exact(anchor)
        weight = anchor.astype(vectors.dtype)
        up, down = np.flatnonzero(anchor < 0), np.flatnonzero(anchor > 0)
        rising, falling = self.orders[up], self.orders[down][:, ::-1]
        if not len(up) + len(down):  # every score is 0, and any order is as good
            rising = np.arange(n)[None, :]
        tops: list[list[tuple[int, int]]] = [[] for _ in windows]
        waiting = eligible.copy()
        depth, upto = 0, min(FIRST, n)
        while depth < n and waiting.any():
            met = np.zeros(n, bool)
            met[rising[:, depth:upto]] = True
            met[falling[:, depth:upto]] = True
            new = np.flatnonzero(met & waiting)
            waiting[new] = False
            scores = vectors[new] @ weight
            for j, (low, high) in enumerate(windows):
                least = max(low, tops[j][-1][0]) if len(tops[j]) == k else low
                inside = np.flatnonzero((scores >= least) & (scores <= high))
                if len(inside):
                    tops[j] = self._first(tops[j], [(int(scores[i]), int(new[i])) for i in self._cut(scores[inside], inside, k)], k)
            bound = int(weight[up] @ vectors[rising[: len(up), upto - 1], up]) + int(weight[down] @ vectors[falling[:, upto - 1], down])
            if all(bound < (max(low, top[-1][0]) if len(top) == k else low) for (low, _), top in zip(windows, tops)):
                break
            depth, upto = upto, min(2 * upto, n)
        return tops

    @staticmethod
    def _cut(scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
        """The places of the k highest scores, and all that tie with the last of them."""
        if len(scores) <= k or scores.dtype == object:
            return places
        return places[scores >= np.partition(scores, len(scores) - k)[len(scores) - k]]

    def _first(self, held: list[tuple[int, int]], new: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        return sorted(held + new, key=lambda s: (-s[0], self.unnamed[s[1]], self.ids[s[1]], self.rows[s[1]]))[:k]


def _build(table: pa.Table) -> pa.Table:
    """One block's rows to its index."""
    vectors, ids = matrix(table["vector"]), table["id"]
    orders = smallest(np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T))
    vectors, unnamed = smallest(vectors), ids.is_null().to_numpy()
    held = [ids.fill_null(0).to_numpy(), unnamed, table["row"].to_numpy(), table["label"].to_numpy()]
    return pa.table({
        "block": pa.array([table["block"][0].as_py()], pa.int64()), "n": pa.array([len(table)], pa.int64()),
        **{name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(("ids", "unnamed", "rows", "labels"), held)},
        "vectors": pa.array([vectors.tobytes()], pa.binary()), "kind": [vectors.dtype.str], "orders": pa.array([orders.tobytes()], pa.binary()), "order_kind": [orders.dtype.str],
    })


def _opened(index: pa.Table) -> Candidates:
    row = index.slice(0, 1).to_pylist()[0]
    held = [np.frombuffer(row[name], kind) for name, kind in (("ids", np.int64), ("unnamed", bool), ("rows", np.int64), ("labels", np.int64))]
    n = row["n"]
    return Candidates(*held, np.frombuffer(row["vectors"], row["kind"]).reshape(n, -1), np.frombuffer(row["orders"], row["order_kind"]).reshape(-1, n))


def _cell(k: int, share: tuple[int, int] | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block of anchors against a block of candidates.

    Without ``share`` they are of the anchor's label and any score will do. With it they are of other labels, and
    each number of ``highs`` is the top of a window that begins at that share of it.
    """

    def run(anchors: pa.Table, index: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(index) and len(anchors):
            block = _opened(index)
            vectors = matrix(anchors["vector"])
            dims = max(vectors.shape[1], block.whole.shape[1])
            if block.whole.shape[1] < dims:  # shorter vectors end in zeros
                more = dims - block.whole.shape[1]
                orders = np.concatenate([block.orders, np.tile(np.arange(len(block.ids), dtype=block.orders.dtype), (more, 1))])
                block = Candidates(block.ids, block.unnamed, block.rows, block.labels, np.pad(block.whole, ((0, 0), (0, more))), orders)
            vectors = np.pad(vectors, ((0, 0), (0, dims - vectors.shape[1])))
            for row, label, vector, highs in zip(anchors["row"].to_pylist(), anchors["label"].to_pylist(), vectors, anchors["highs"].to_pylist()):
                eligible = (block.labels == label) & (block.rows != row) if share is None else block.labels != label
                windows = [(LEAST, MOST)] if share is None else [(-(-share[0] * high // share[1]), high) for high in highs]
                for (_, high), top in zip(windows, block.search(vector, eligible, windows, k)):
                    out += [(row, high, min(max(score, LEAST), MOST), None if block.unnamed[at] else int(block.ids[at]), int(block.rows[at])) for score, at in top]
        schema = pa.schema([(name.split(" ")[0], pa.int64()) for name in FOUND.split(", ")])
        return pa.Table.from_pydict({f.name: [o[i] for o in out] for i, f in enumerate(schema)}, schema)

    return run


def _search(anchors: DataFrame, index: DataFrame, blocks: int, k: int, share: tuple[int, int] | None, per_block: int) -> DataFrame:
    """The first k candidates of each (anchor, window) over all blocks."""
    sets = -(-anchors.count() // per_block) or 1
    dealt = anchors.withColumn("set", F.pmod(F.xxhash64("row"), F.lit(sets))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    copies = index.withColumn("set", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sets - 1).cast("long"))))
    found = dealt.groupBy("set", "block").cogroup(copies.groupBy("set", "block")).applyInArrow(_cell(k, share), FOUND)
    order = Window.partitionBy("anchor", "high").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(vector: Column) -> Column:
    """Whether a vector is not null and holds neither null nor non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def mine(
    df: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", scale: int = 256,
    positives: int = 5, negatives: int = 5, low: tuple[int, int] = (80, 100), block: int = BLOCK, anchors: int = ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A component x becomes floor(scale * x), held to 62 bits; a score is the whole inner product with the anchor, held to a long's range. An
    anchor's positives are its first rows of the same label, the row itself left out; each gets the first rows of other labels whose
    score is at most its own and at least ``low`` of it. Of equal scores the smaller id comes first, null ids last. A
    positive without such rows gives none, and so does one with a negative score, whose window is empty.

    ``anchor`` marks the rows to search for; null is no. Rows with a null label or an unusable vector take no part. Repeated rows are rows
    of their own: a copy of the anchor is its positive. Labels are whole numbers; shorter vectors count as ending in zeros; other columns are ignored. Jobs run when this is called.
    """
    size = float(1 << 62)
    scaled = F.transform(vector_col, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale).cast("double"), F.lit(size)), F.lit(-size)).cast("long"))
    name = F.col(label) if isinstance(label, str) else label
    rows = df.where(name.isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), name.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("asks"), scaled.alias("vector")
    )
    rows = pin(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    parts = -(-rows.count() // block) or 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(parts)))
    index = pin(dealt.groupBy("block").applyInArrow(_build, INDEX), "lists")
    asking = rows.where("asks").select("row", "id", "label", "vector")
    near = _search(asking.withColumn("highs", F.array().cast("array<long>")), index, parts, positives, None, anchors).select("anchor", "score", "id")
    near = pin(near, "positives")
    highs = near.where("score >= 0").groupBy("anchor").agg(F.collect_set("score").alias("highs"))  # at most as many as there are positives
    again = asking.join(highs, asking["row"] == highs["anchor"]).select("row", "label", "vector", "highs")
    hard = _search(pin(again, "anchors"), index, parts, negatives, low, anchors).select(
        "anchor", F.col("high").alias("score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    names = asking.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    out = near.withColumnRenamed("id", "positive_id").join(hard, ["anchor", "score"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")
