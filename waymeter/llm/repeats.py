"""Removal of passages that a document with a smaller id has too, by level-wise doubling.

A window is a run of consecutive words of one document, unchanged. Windows that occur in one
document only cannot be part of a longer repeated window, so the work goes by levels:

* At the first length, half the wanted one, only windows that are the smallest hash inside some
  window of the wanted length are exchanged. Equal wanted windows choose equal inner ones, so a
  repeated passage always has its choice in both documents, while about a twelfth of all
  windows travel. A choice seen in one document alone ends there.
* Survivors are extended to twice the length: the wanted windows around them are told by a
  128-bit digest of their words, which decides the removal; the 64-bit hashes of the first level only
  choose candidates.
* From there a surviving window meets the surviving one that follows it in the same text, and the
  two digests make the digest of twice the length. Texts are not read again. Levels go on until no
  window survives, and the last that had one is each row's ``longest``.

The windows of a row stay together, places and digests packed in one record, so that doubling is a map. A level exchanges
each digest once a row, reduced in the map tasks to its smallest and largest id, so a passage that very many
documents share is one row there. What comes back is one message for each different window, not for each place:
to the row that has it first, or alone. All else in a row is a later occurrence. Documents whose whole
word sequence is an earlier document's are settled by one digest and need no windows. Rows are told apart by a
running number written with their digests, not with their texts, which are found again by id and digest; messages go by id where the rows with candidates have ids of their own, which is
looked up, and by number, with one more join on the window, where some share an id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymeter.llm.words import BLOCK, Words, blocks, split, window_hashes, word_hashes
from waymeter.session import pin

PLACES = 1 << 14  # windows of one text whose words are held at once
DIGEST = np.dtype("V16")
PACKED = [("row", pa.int64()), ("id", pa.int64()), ("places", pa.binary()), ("digests", pa.binary())]
SETTLED = [*PACKED[:2], ("alive", pa.bool_()), ("gone", pa.list_(pa.int64())), ("upto", pa.list_(pa.int64())), *PACKED[2:]]


def _least_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values, by doubling the span."""
    span = 1
    while span * 2 <= width:
        hashes = np.minimum(hashes[:-span], hashes[span:])
        span *= 2
    return np.minimum(hashes[: len(hashes) - (width - span)], hashes[width - span :]) if width > span else hashes


def chosen(hashes: np.ndarray, length: int, base: int) -> np.ndarray:
    """For each window of ``length`` words of one text, the hash of its chosen inner window."""
    return _least_of(window_hashes(hashes, base), length - base + 1)


def _own_digest(text: bytes | None) -> tuple[int, bytes]:
    """The number of words, and a digest of the words joined by one space."""
    own = (text or b"").split()
    return len(own), hashlib.sha256(b" ".join(own)).digest()


def _facts(length: int, base: int):
    """Each row's number of words, their digest, and the chosen inner windows, each once (none without an id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in blocks(batch.column("text")):
                ids = batch.column("id").slice(at, len(texts))
                words = split(texts)
                hashes = word_hashes(words)
                picks = []
                for doc, low, high in zip(ids, words.first[:-1], words.first[1:]):
                    fits = doc.is_valid and high - low >= length
                    picks.append(np.unique(chosen(hashes[low:high], length, base)).view(np.int64) if fits else np.zeros(0, np.int64))
                counts, digests = zip(*map(_own_digest, texts.cast(pa.large_binary()).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(picks, pa.list_(pa.int64()))], ["id", "n", "sha", "picks"]
                )

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the digest of their words; of rows with the same id and words only the first of a batch."""
    for batch in batches:
        seen = {}
        for at, (doc, text) in enumerate(zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.large_binary()))):
            seen.setdefault((doc, _own_digest(text.as_py())[1]), at)
        taken = batch.take(pa.array(seen.values(), pa.int64()))
        yield pa.RecordBatch.from_arrays([taken.column("id"), pa.array([sha for _, sha in seen], pa.binary()), taken.column("text")], ["id", "sha", "text"])


def _told(words: Words, low: int, places: np.ndarray, length: int) -> list[bytes]:
    """A 128-bit digest of the words of each window that begins at one of the sorted ``places`` of the text at ``low``."""
    if not len(places):
        return []
    first, end = low + places[0], low + places[-1] + length
    own = [bytes(words.buf[s:e]) for s, e in zip(words.start[first:end], words.end[first:end])]
    return [hashlib.blake2b(b" ".join(own[p : p + length]), digest_size=16).digest() for p in (places - places[0]).tolist()]


def _windows(length: int, base: int):
    """The windows of each row whose chosen inner window survived (``picks``), packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in blocks(batch.column("text")):
                words = split(texts)
                hashes = word_hashes(words)
                packed = []
                for row, (low, high) in enumerate(zip(words.first[:-1], words.first[1:])):
                    if high - low < length:
                        continue
                    alive = np.isin(chosen(hashes[low:high], length, base), np.array(batch.column("picks")[at + row].values).view(np.uint64))
                    own = np.flatnonzero(alive).astype(np.int64)
                    parts = (b"".join(_told(words, low, some, length)) for some in np.array_split(own, len(own) // PLACES + 1))
                    packed.append((batch.column("row")[at + row].as_py(), batch.column("id")[at + row].as_py(), _steps(own), b"".join(parts)))
                yield _records(packed, PACKED)

    return run


def _records(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def _steps(places: np.ndarray) -> bytes:
    """Places as steps from one to the next, which are ones in a passage and take little room."""
    return np.diff(places, prepend=0).astype(np.int64).tobytes()


def _unpacked(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and digests of the windows of one row."""
    return np.cumsum(np.frombuffer(batch.column("places")[at].as_py(), np.int64)), np.frombuffer(batch.column("digests")[at].as_py(), DIGEST)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different windows of each row, a digest as two numbers."""
    for batch in batches:
        for at in range(len(batch)):
            halves = np.unique(_unpacked(batch, at)[1]).view(np.int64).reshape(-1, 2)
            row, doc = (pa.repeat(batch.column(c)[at], len(halves)) for c in ("row", "id"))
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), row, doc], ["high", "low", "row", "id"])


def _among(digests: np.ndarray, told: pa.ListScalar) -> np.ndarray:
    """Which digests are among the ``told`` pairs of numbers."""
    if told.values is None or not len(told.values):
        return np.zeros(len(digests), bool)
    halves = np.column_stack([np.array(told.values.field(c)) for c in ("high", "low")])
    return np.isin(digests, np.ascontiguousarray(halves).view(DIGEST).ravel())


def extend(places: np.ndarray, digests: np.ndarray, length: int) -> tuple[np.ndarray, bytes]:
    """Windows of twice the length from the surviving ones of a row: their places, and their digests joined."""
    after = np.searchsorted(places, places + length)
    pairs = np.flatnonzero(places[np.minimum(after, len(places) - 1)] == places + length) if len(places) else np.zeros(0, np.int64)
    own = digests.tobytes()
    halves = ((own[16 * p : 16 * p + 16], own[16 * q : 16 * q + 16]) for p, q in zip(pairs.tolist(), after[pairs].tolist()))
    return places[pairs], b"".join([hashlib.blake2b(x + y, digest_size=16).digest() for x, y in halves])


def _covered(places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of words begin and end that windows at the sorted ``places`` cover."""
    edge = np.diff(places) > length
    return places[np.r_[np.ones(len(places[:1]), bool), edge]], places[np.r_[edge, np.ones(len(places[:1]), bool)]] + length


def _settle(length: int):
    """Drops the windows that no other id has (``alone``), notes those that another has ``first``, and doubles what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for at in range(len(batch)):
                places, digests = _unpacked(batch, at)
                alive = ~_among(digests, batch.column("alone")[at])
                later = alive & ~_among(digests, batch.column("first")[at])
                doubled, joined = extend(places[alive], digests[alive], length)
                rows.append((batch.column("row")[at].as_py(), batch.column("id")[at].as_py(), bool(alive.any()), *_covered(places[later], length), _steps(doubled), joined))
                held += len(joined)
                if held > BLOCK:
                    yield _records(rows, SETTLED)
                    rows, held = [], 0
            yield _records(rows, SETTLED)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes out the runs of words that begin at ``gone`` and end before ``upto``."""
    for batch in batches:
        kept_texts, removed = [], []
        for at, texts in blocks(batch.column("text")):
            words = split(texts)
            for row, (low, high) in enumerate(zip(words.first[:-1], words.first[1:])):
                edges = np.zeros(high - low + 1, np.int64)
                edges[np.array(batch.column("gone")[at + row].values, np.int64)] += 1
                edges[np.array(batch.column("upto")[at + row].values, np.int64)] -= 1
                keep = low + np.flatnonzero(np.cumsum(edges[:-1]) == 0)
                removed.append(high - low - len(keep))
                kept_texts.append(b" ".join([bytes(words.buf[s:e]) for s, e in zip(words.start[keep], words.end[keep])]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"), pa.array(removed, pa.int64()),
                pa.array(kept_texts, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in kept_texts]),
            ],
            ["row", "n_removed", "kept", "kept_sha"],
        )


def _repeated(rows: DataFrame) -> DataFrame:
    """The windows (of ``h, id``) that occur under several ids, with the smallest."""
    return rows.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("h", "least")


def settled(windows: DataFrame, length: int, key: str) -> DataFrame:
    """One level: ``row, id, alive, gone, upto, places, digests`` for each row of packed ``windows`` of one length.

    From ``gone`` to before ``upto`` go the words whose window a smaller id has too; ``places`` and ``digests`` are the windows of twice the length.
    ``key`` is ``id`` if no two rows have the same, else ``row``.
    """
    spread = windows.mapInArrow(_spread, "high long, low long, row long, id long")
    told = spread.groupBy("high", "low").agg(F.min("id").alias("id"), F.max("id").alias("most"))
    if key == "row":  # every row with the smallest id has to know
        told = spread.join(told.withColumnRenamed("id", "least"), ["high", "low"]).where("id = least")
    window, alone = F.struct("high", "low"), F.col("id") == F.col("most")
    told = told.groupBy(key).agg(F.collect_list(F.when(alone, window)).alias("alone"), F.collect_list(F.when(~alone, window)).alias("first"))
    return windows.join(told, key, "left").select("row", "id", "places", "digests", "alone", "first").mapInArrow(
        _settle(length), "row long, id long, alive boolean, gone array<long>, upto array<long>, places binary, digests binary"
    )


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """``id, n_words, n_removed, kept_text, kept_sha256, longest`` for each row.

    A word is removed if a window of ``length`` words that covers it also starts in a row with a
    smaller id; windows are judged on the input. Texts that lose nothing carry a null ``kept_text``
    (they stay as they are), so that only texts with a cut are moved. ``longest`` is the longest of ``length``, twice and
    four times that and so on at which the row shares a window with a row of another id, 0 for none. Null and empty texts have no
    words. Rows with a null id lose nothing and take nothing from others; neither do rows that share an id from
    each other. ``length`` must be even and at least 2.
    The rows are read twice, so they must be the same each time; pin them first if they may not be.
    """
    if length < 2 or length % 2:
        raise ValueError("length must be even: the first level has half of it")
    base = length // 2
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    facts = rows.mapInArrow(_facts(length, base), "id long, n long, sha binary, picks array<long>")
    facts = pin(facts.withColumn("row", F.monotonically_increasing_id()), "words")
    # Of rows with the same words the first by id stands for all.
    same = facts.where("n > 0 and id is not null").groupBy("sha").agg(
        F.min("id").alias("rep"), F.max("id").alias("last"), F.min_by("row", F.struct("id", "row")).alias("rep_row")
    )
    picks = facts.select(F.explode("picks").alias("h"), "row", "id")
    alive = picks.join(_repeated(picks).select("h"), "h").groupBy("row").agg(F.collect_list("h").alias("picks"))
    facts = pin(facts.drop("picks").join(same, "sha", "left"), "told")
    alive = alive.join(facts.where("row = rep_row").select("row", "id", "sha"), "row")
    held = rows.where("id is not null").mapInArrow(_keyed, "id long, sha binary, text string").join(alive, ["id", "sha"])
    held = pin(held.dropDuplicates(["id", "sha"]).drop("sha"), "held")

    key = "id" if held.groupBy("id").count().where("count > 1").isEmpty() else "row"
    windows = pin(held.mapInArrow(_windows(length, base), "row long, id long, places binary, digests binary"), "windows")
    level = pin(settled(windows, length, key), "survivors")
    gone = level.where("size(gone) > 0").select("row", "gone", "upto")
    cut = held.join(gone, "row").select("row", "text", "gone", "upto").mapInArrow(_cut, "row long, n_removed long, kept string, kept_sha string")
    levels, size = level.where("alive").select("row", F.lit(length).cast("long").alias("longest")), length
    while not (windows := level.where("length(places) > 0").select("row", "id", "places", "digests")).isEmpty():
        size *= 2
        level = pin(settled(windows, size, key), "survivors")
        levels = levels.union(level.where("alive").select("row", F.lit(size).cast("long").alias("longest")))
    levels = levels.groupBy("row").agg(F.max("longest").alias("longest"))
    found = cut.join(levels, "row", "full").withColumnRenamed("row", "at")

    # Equal texts share all their windows: the highest binary digit of n / length is their longest level.
    whole = F.when(F.col("n") >= length, F.expr(f"{length} * shiftleft(1L, length(bin(n div {length})) - 1)")).otherwise(F.lit(0))
    copy, first = F.coalesce(F.col("id") > F.col("rep"), F.lit(False)) & (F.col("n") >= length), F.coalesce(F.col("id") == F.col("rep"), F.lit(False))
    # Rows that nothing was found for meet themselves, so that no key is hot.
    keyed = facts.withColumn("at", F.when(first, F.col("rep_row")).otherwise(-1 - F.col("row"))).join(found, "at", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return keyed.select(
        F.col("id").alias(id_col), F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept_text"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept_sha", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.greatest(F.coalesce("longest", F.lit(0)), F.when(F.col("id").isNotNull() & (F.col("last") > F.col("rep")), whole).otherwise(F.lit(0))).cast("long").alias("longest"),
    )
