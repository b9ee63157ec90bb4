"""Token counts against the libraries, and what a second run finds in the cache."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from waymeter.llm import counts
from waymeter.session import scratch

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
MORE = [(90, "a b"), (91, "a▁b"), (92, " a b"), (93, "a  b"), (94, "<s>x</s><unk><0x0A>"), (95, "\x00\r\n\t"), (96, "日本 😀"), (97, "<|endoftext|>")]


def run(df, vocabulary, **more):
    return sorted((tuple(r) for r in counts.count_tokens(df, vocabulary, **more).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=repr)


@pytest.mark.parametrize("vocabulary", [PIECES, WORDS])
def test_counts(docs, odd_rows, vocabulary):
    if vocabulary == PIECES:
        pieces = SentencePieceProcessor(model_file=PIECES)
        count = lambda t: len(pieces.encode(t))
    else:
        theirs = Tokenizer.from_file(WORDS)
        count = lambda t: len(theirs.encode(t, add_special_tokens=False).ids)
    rows = odd_rows + MORE
    want = sorted(((i, len((t or "").encode()), count(t or ""), count(t or "") > 4096) for i, t in rows), key=repr)
    assert run(docs(rows), vocabulary) == want and any(w[3] for w in want)
    assert run(docs([]), vocabulary) == []


def entries(spark, cache, vocabulary):
    found = counts.cached(spark, cache, counts.Tokenizer(vocabulary).version)
    return {bytes(r.digest): r.n_tokens for r in found.collect()}


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_only_misses_are_encoded(spark, docs, odd_rows, monkeypatch, broadcast):
    """Both plans: a list of misses that may be broadcast, and one that may not."""
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        cache, encoded, real = scratch(spark, "cache"), [], counts._misses
        monkeypatch.setattr(counts, "_misses", lambda texts, missing, n: encoded.append(real(texts, missing, n).collect()) or real(texts, missing, n))
        first, rows = odd_rows[:9], odd_rows + MORE + [(200 + i, "a copy") for i in range(50)]
        run(docs(first), PIECES, cache=cache)
        before = entries(spark, cache, PIECES)
        whole = run(docs(rows), PIECES, cache=cache)
        assert whole == run(docs(rows), PIECES)  # as from an empty cache
        distinct = {(t or "").replace(" ", "▁") for _, t in rows}
        old = {(t or "").replace(" ", "▁") for _, t in first}
        assert [len(e) for e in encoded[:2]] == [len(old), len(distinct - old)]
        after = entries(spark, cache, PIECES)
        assert before.items() <= after.items() and len(after) == len(distinct)
        run(docs(rows), PIECES, cache=cache)
        assert len(encoded) == 3  # two runs here and the one with a cache of its own; the last found all
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def test_versions_and_repeated_entries(spark, docs):
    cache = scratch(spark, "cache")
    table = docs([(1, "one two"), (2, "one two"), (3, None)])
    assert run(table, PIECES, cache=cache) != [] and run(table, WORDS, cache=cache) != []
    version = counts.Tokenizer(PIECES).version
    assert len(entries(spark, cache, PIECES)) == len(entries(spark, cache, WORDS)) == 2 and version != counts.Tokenizer(WORDS).version
    counts.cached(spark, cache, version).write.parquet(f"{cache}/version={version}/run=beside")  # what a run at the same time leaves
    got = run(table, PIECES, cache=cache)
    assert [r[0] for r in got] == [1, 2, 3] and got == run(table, PIECES)


def test_a_file_of_another_kind_is_refused():
    with pytest.raises(ValueError):
        counts.Tokenizer("vocabulary.bin")


def test_a_dominant_text_is_reduced_before_it_moves(spark, docs):
    table = docs([(i, "hot" if i % 3 else f"t{i}") for i in range(300)], parts=6)
    keyed = table.select(F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    plan = counts._misses(keyed, keyed.select("digest").distinct(), 1 << 40)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftSemi") < plan.index("Aggregate [digest")  # the join stands above the aggregate
