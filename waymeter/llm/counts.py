"""Token counts through a cache: a text is encoded once per tokenizer version, wherever it turns up again.

The cache is a table of (version, digest, count). A version is the SHA-256 of the vocabulary file and of the
library that reads it; a digest is the SHA-256 of the content as the tokenizer sees it. Each run takes the distinct
digests of its rows, looks them up, encodes one text of each that is missing, appends the counts in a
folder of its own, and joins all counts back to the rows. Only digests are compared across rows; texts move for
the misses.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymeter.llm.words import blocks
from waymeter.session import exists, pin, scratch

CACHE = "digest binary, n_tokens long"
DIGEST_BYTES = 64  # what a digest may take in a broadcast table


class Tokenizer:
    """A vocabulary file of the tokenizers (.json) or sentencepiece (.model) library, read on the driver."""

    def __init__(self, path: str):
        self.library = {".json": "tokenizers", ".model": "sentencepiece"}.get(os.path.splitext(path)[1])
        if self.library is None:
            raise ValueError(f"{path}: a .json or .model file is expected")
        with open(path, "rb") as file:
            self.data = file.read()
        stamp = f"{self.library} {importlib.metadata.version(self.library)}\n".encode()
        self.version = hashlib.sha256(stamp + self.data).hexdigest()
        #: Whether the library only writes spaces as U+2581 and otherwise takes a text as it is.
        self.marks_spaces = self.library == "sentencepiece" and _marks_spaces(self.data)

    def content(self, text: Column) -> Column:
        """What the count of a text depends on: two texts of the same content have the same tokens."""
        text = F.coalesce(text, F.lit(""))
        return F.replace(text, F.lit(" "), F.lit("▁")) if self.marks_spaces else text


def _marks_spaces(model: bytes) -> bool:
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto.FromString(model)
    rules = proto.normalizer_spec
    return rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap


def counter(library: str, data: bytes) -> Callable[[list[str]], list[int]]:
    """Counts of a list of texts, without added special tokens, truncation or padding."""
    if library == "sentencepiece":
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer as Theirs

    theirs = Theirs.from_str(data.decode())
    theirs.no_truncation()
    theirs.no_padding()
    return lambda texts: [len(e.ids) for e in theirs.encode_batch(texts, add_special_tokens=False)]


_counters: dict[str, Callable] = {}


def _encode(version: str, library: str, data) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``digest, text`` batches to ``digest, n_tokens``, a block of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if version not in _counters:
            _counters[version] = counter(library, data.value)
        for batch in batches:
            for at, texts in blocks(batch.column(1)):
                found = _counters[version](texts.to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(found, pa.int64())], ["digest", "n_tokens"])

    return run


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The counts that a cache holds for a version, one row per digest also where two runs have met the same text."""
    folder = f"{cache.rstrip('/')}/version={version}"
    if not exists(spark, folder):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).option("recursiveFileLookup", True).parquet(folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _misses(texts: DataFrame, missing: DataFrame, n: int) -> DataFrame:
    """``digest, text``, one row for each missing digest.

    Copies are reduced in the map tasks, so a text with very many copies is nowhere gathered. A list of misses
    that Spark would broadcast (its size is known) filters the texts before they move.
    """
    spark = texts.sparkSession
    limit = int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    if n * DIGEST_BYTES <= limit:
        texts = texts.join(F.broadcast(missing), "digest", "left_semi")
        return texts.groupBy("digest").agg(F.first("text").alias("text"))
    return texts.groupBy("digest").agg(F.first("text").alias("text")).join(missing, "digest", "left_semi")


def count_tokens(
    df: DataFrame, vocabulary: str, cache: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` for each row, also repeated ones; null texts count as empty.

    ``cache`` is a folder that all executors reach, by default a new one. A run adds the counts of the texts it has not found
    there, in a folder of its own that becomes visible when it is complete, so a run that is broken off
    leaves nothing behind and runs beside each other at most encode a text twice. Other columns are ignored; rows with a
    null id are counted like others. An empty table gives no rows and adds nothing. Jobs run when this is called.
    """
    spark = df.sparkSession
    tokenizer = Tokenizer(vocabulary)
    cache = cache or scratch(spark, "token-counts")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = df.select(
        F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(tokenizer.content(F.col(text_col)), 256)).alias("digest"), text.alias("text")
    )
    rows = pin(keyed.drop("text"), "digests")
    wanted = pin(rows.select("digest").distinct(), "wanted")
    missing = pin(wanted.join(cached(spark, cache, tokenizer.version), "digest", "left_anti"), "missing")
    n = missing.count()
    if n:
        data = spark.sparkContext.broadcast(tokenizer.data)  # a vocabulary file, whatever the data
        counted = _misses(keyed.select("digest", "text"), missing, n).mapInArrow(_encode(tokenizer.version, tokenizer.library, data), CACHE)
        counted.write.parquet(f"{cache.rstrip('/')}/version={tokenizer.version}/run={uuid.uuid4().hex}")
    # Written, so that the join below has plain tables on both sides and a digest with very many rows can be split.
    known = pin(cached(spark, cache, tokenizer.version).join(wanted, "digest", "left_semi"), "known")
    out = rows.join(known, "digest", "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
