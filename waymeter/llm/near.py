"""Near-duplicates: MinHash signatures, banding, verification on full sets, and components.

1. Each text becomes its set of distinct word shingles (A-Z lower-cased) and the minima of 128
   universal hash functions over it. Texts with the same set are one class from here on, named
   by its smallest id.
2. 32 bands of 4 minima make bucket keys. At a similarity of 0.8 a linked pair misses every
   band with a chance of 5e-8. Each bucket of two or more classes names a pivot.
3. Every member is compared with its pivots by signature. The best one that is not below the
   threshold by more than six standard errors is confirmed on the full sets; confirmed links make
   the first components.
4. In buckets that still span several components, the members outside the largest one are a
   query set that is compared on full sets with all the others, in blocks of bounded size.
   So no link that shares a bucket is lost, however large a group of near copies is, and only
   texts that the first links left apart are compared again.
5. Large-star and small-star over all links give the components.

Rows with a null id, an empty or null text, or no word are linked with nothing. Rows of one id
count as one document, whose links are those of all its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymeter.llm.stars import components
from waymeter.llm.words import blocks, split, window_hashes, word_hashes
from waymeter.session import pin

HASHES, BAND = 128, 4
BLOCK_DOCS, BLOCK_BYTES = 128, 1 << 23  # what one side of a block comparison may hold


def _functions() -> tuple[np.ndarray, np.ndarray]:
    """Multiply-add-shift functions, strongly universal from 32 bits to 32 bits."""
    draw = np.random.default_rng(7)
    return draw.integers(0, 1 << 64, HASHES, np.uint64), draw.integers(0, 1 << 64, HASHES, np.uint64)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle."""
    words = split(texts, lower=True)
    hashes = word_hashes(words)
    runs = window_hashes(hashes, size)
    out = []
    for low, high in zip(words.first[:-1], words.first[1:]):
        if high - low >= size:
            out.append(np.unique(runs[low : high - size + 1]))
        else:
            out.append(window_hashes(hashes[low:high], max(1, high - low)))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of minima for each set; an empty set has the largest values."""
    out = np.full((len(sets), HASHES), 0xFFFFFFFF, np.uint32)
    filled = np.flatnonzero([len(s) for s in sets])
    if len(filled):
        flat = np.concatenate([sets[i] for i in filled]) >> np.uint64(32)
        starts = np.cumsum([0] + [len(sets[i]) for i in filled[:-1]])
        for k, (a, b) in enumerate(zip(*_functions())):
            out[filled, k] = np.minimum.reduceat((flat * a + b) >> np.uint64(32), starts)
    return out


def _describe(size: int, digests: bool):
    """``id, text`` batches to ``id, n_shingles, digest, signature``, or with the text instead of the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in blocks(batch.column(1)):
                sets = shingle_sets(texts, size)
                rows = [bytes(x) for x in signatures(sets)]
                third = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets] if digests else texts
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(third), pa.array(rows, pa.binary())],
                    ["id", "n", "digest" if digests else "text", "sig"],
                )

    return run


def _alike(percent: int):
    """Keeps pairs whose signatures agree as often as a linked pair's would, up to six standard errors."""
    p = percent / 100
    least = HASHES * (p - 6 * (p * (1 - p) / HASHES) ** 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sa", "sb"))
                same = (a == b).sum(1)
                keep = np.flatnonzero(same >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep)), pa.array(same[keep], pa.int64())], ["a", "b", "same"])

    return run


def _confirm(size: int, percent: int):
    """Keeps pairs that are linked on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for at, left in blocks(batch.column("ta")):
                for x, y in zip(shingle_sets(left, size), (s for _, t in blocks(batch.column("tb").slice(at, len(left))) for s in shingle_sets(t, size))):
                    inter = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    return run


def _compare_blocks(size: int, percent: int):
    """Links between a block of queries and a block of all texts, without those that tie nothing new together."""

    def run(table: pa.Table) -> pa.Table:
        sides = []
        for query in (True, False):
            part = table.filter(pa.array(np.asarray(table["query"]) == query)).combine_chunks()
            texts = pa.concat_arrays(part["text"].chunks) if part.num_rows else pa.array([], pa.string())
            sets = [s for _, t in blocks(texts) for s in shingle_sets(t, size)]
            sides.append((part["id"].to_pylist(), part["c"].to_pylist(), sets))
        (ids, comps, sets), (all_ids, all_comps, all_sets) = sides
        held = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), held)
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        found: tuple[list[int], list[int]] = ([], [])
        for j, other in enumerate(all_sets):
            low, high = np.searchsorted(flat, other, "left"), np.searchsorted(flat, other, "right")
            many = high - low
            at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
            inter = np.bincount(owner[at], minlength=len(sets))
            for i in np.flatnonzero((100 * inter >= percent * (held + len(other) - inter)) & (inter > 0)):
                a, b = root(comps[i]), root(all_comps[j])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    found[0].append(ids[i])
                    found[1].append(all_ids[j])
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return run


def _across(hits: DataFrame, texts: DataFrame, comps: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between different components that meet in a bucket, all of them compared on full sets."""
    placed = hits.join(comps.withColumnRenamed("node", "doc"), "doc", "left")
    placed = pin(placed.select("key", "doc", F.coalesce("component", "doc").alias("c")), "placed")
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    inside = placed.join(mixed, "key")
    sizes = placed.select("doc", "c").distinct().groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    sized = inside.select("key", "c").distinct().join(sizes, "c")
    mains = sized.groupBy("key").agg(F.max(F.struct("size", "c")).alias("main")).select("key", F.col("main.c").alias("g"))
    grouped = inside.join(mains, "key").select("g", "doc", "c").distinct()
    grouped = pin(grouped.join(texts.select(F.col("id").alias("doc"), F.octet_length("text").alias("bytes")), "doc"), "groups")
    is_query = F.col("c") != F.col("g")
    cut = lambda n, size: F.ceil(F.greatest(n / BLOCK_DOCS, size / BLOCK_BYTES)).cast("int")
    counts = grouped.groupBy("g").agg(
        cut(F.count_if(is_query), F.sum(F.when(is_query, F.col("bytes")).otherwise(0))).alias("nq"),
        cut(F.count(F.lit(1)), F.sum("bytes")).alias("na"),
    )
    counts = pin(counts, "counts")  # read anew, so that adaptive execution can split a large group's rows
    dealt = grouped.join(counts, "g").select(
        "g", "doc", "c", "nq", "na", is_query.alias("asks"),
        F.pmod(F.xxhash64("doc"), F.col("nq")).cast("int").alias("qb"), F.pmod(F.xxhash64("doc", F.lit(1)), F.col("na")).cast("int").alias("ab"),
    )
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asks = dealt.where("asks").select("g", "qb", upto(F.col("na")).alias("ab"), "doc", "c", F.lit(True).alias("query"))
    rest = dealt.select("g", upto(F.col("nq")).alias("qb"), "ab", "doc", "c", F.lit(False).alias("query"))
    rows = asks.union(rest).join(texts.select(F.col("id").alias("doc"), "text"), "doc")
    cells = rows.select("g", "qb", "ab", F.col("doc").alias("id"), "c", "query", "text").groupBy("g", "qb", "ab")
    return cells.applyInArrow(_compare_blocks(size, percent), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for each row: Jaccard similarity of ``percent`` or more links.

    ``component_id`` is the smallest id reachable over links (null for a null id) and ``kept`` marks
    the row of that id; rows with a null id are kept. Ids are integers. Runs jobs when called and
    writes intermediate tables to the shared folder.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    facts = pin(rows.mapInArrow(_describe(words, True), "id long, n long, digest binary, sig binary"), "minhash")
    known = facts.where("n > 0 and id is not null")
    classes = pin(known.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    firsts = known.join(classes.withColumnRenamed("rep", "id"), ["id", "digest"]).select("id", "sig")
    bands = F.transform(F.sequence(F.lit(0), F.lit(HASHES // BAND - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * (4 * BAND) + 1, F.lit(4 * BAND))))
    members = firsts.select(F.col("id").alias("doc"), F.explode(bands).alias("key"))
    turned = F.col("doc").bitwiseXOR(F.col("key"))  # another order of ids, so another pivot, in each bucket
    buckets = members.groupBy("key").agg(F.min(turned).alias("p"), F.max(turned).alias("q")).where("p <> q")
    hits = pin(members.join(buckets.select("key", F.col("p").bitwiseXOR(F.col("key")).alias("pivot")), "key"), "hits")

    wanted = hits.select(F.col("doc").alias("id")).distinct()
    # A document whose rows have several texts counts with each of its classes' first rows.
    texts = rows.join(wanted, "id").mapInArrow(_describe(words, False), "id long, n long, text string, sig binary")
    texts = pin(texts.where("n > 0").dropDuplicates(["id", "sig"]), "texts")
    pairs = hits.where("doc <> pivot").select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct()
    sig = lambda c: texts.select(F.col("id").alias(c), F.col("sig").alias(f"s{c}"))
    text = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"t{c}"))
    alike = pairs.join(sig("a"), "a").join(sig("b"), "b").mapInArrow(_alike(percent), "a long, b long, same long")
    best = alike.withColumn("rn", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("same"), "b"))).where("rn = 1").select("a", "b")
    links = pin(best.join(text("a"), "a").join(text("b"), "b").mapInArrow(_confirm(words, percent), "a long, b long"), "links")
    comps = components(links, "a", "b")
    more = pin(_across(hits, texts, comps, words, percent), "links")
    named = facts.select("id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(classes, "digest", "left")
    # An id whose rows are in several classes ties these together.
    several = named.where("id is not null").groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi")
    tied = named.join(several, "id").select("rep", "lo").distinct()
    comps = components(comps.select("node", "component").union(more).union(tied), "node", "component")
    found = named.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "id")
    return found.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), component).alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == component)).alias("kept"),
    )
