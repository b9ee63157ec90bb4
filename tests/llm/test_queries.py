"""Registered queries on the smallest tables, and the pipeline stage by stage against brute force."""

import hashlib
from pathlib import Path

import corpus_pipeline
import pytest
import test_dedup
import test_others
from oracle import mismatch
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from waymeter.llm import queries, toxicity

FOLDER = "/root/testdata/sf0.001"
ENTRIES = queries.entries()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


def test_one_query_for_each_operator_and_the_pipeline():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert not {"op4_sampled_splitters", "op12_chebyshev_whitening", "op13_cached_token_counts", "pipeline"} & set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(ENTRIES))
def test_query(spark, name):
    run, query = ENTRIES[name]
    out = run(spark, FOLDER)
    if name.startswith("op12_"):
        assert out.count() == 32 * spark.read.parquet(f"{FOLDER}/embeddings.parquet").count()
    elif query is None:
        assert out.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    else:
        assert mismatch(out, FOLDER, query) is None


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, theirs = docs.columns, Tokenizer.from_file(test_others.VOCABULARY)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        path = str(tmp_path / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        out = spark.read.parquet(path)
        got = sorted(r.doc_id for r in out.select("doc_id").collect())
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
            want = sorted(r.doc_id for r in toxicity.grade(docs, model).where("kept").collect())
        elif name == "exact_dedup":
            want = sorted(r[1] for r in test_dedup.exact_brute(rows, False) if r[4])
        elif name == "near_dedup":
            want = sorted(r[1] for r in test_dedup.near_brute(rows, 5, 80) if r[4])
        elif name == "mixing":
            full = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
            levels = [lambda r: queries.DOMAINS[int(r[3][3:]) % 4], lambda r: r[2], lambda r: r[3]]
            mixed = test_others.mix_brute(full, levels, queries.WEIGHTS, corpus_pipeline.SHARE, corpus_pipeline.EPOCHS, queries.SEED)
            want = sorted(r[0] for r in mixed if r[7] > 0)
            assert 0.7 * sum(r[4] for r in mixed) < sum(r[4] for r in mixed if r[7]) <= 0.9 * sum(r[4] for r in mixed)
        else:
            want = sorted(d for d, _ in rows)
            ids = {r.doc_id: r.ids for r in out.collect()}
            assert all(ids[d] == theirs.encode(t, add_special_tokens=False).ids for d, t in rows)
        assert got == want, name
        assert name == "bpe" or out.columns == columns
        docs = out
    again = corpus_pipeline.run(spark, FOLDER)
    digest = lambda df: hashlib.sha256(repr(sorted((r.doc_id, r.ids_sha256) for r in df.collect())).encode()).hexdigest()
    assert digest(again) == digest(docs)


def test_pipeline_on_odd_rows(spark, docs, odd_rows, tmp_path):
    frame = docs([(r[0], r[1], None, None) if i % 2 else r for i, r in enumerate(odd_rows)])
    labels = spark.createDataFrame([(1, 0, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for table in (frame, frame.where(F.lit(False))):
        out = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, str(tmp_path))
            if name != "bpe":
                assert out.columns == frame.columns
            left = out.count()
            assert left <= table.count() and (left > 0) == (table.count() > 0)


def test_pipeline_decides_by_row(spark, docs):
    """Rows that repeat, and copies without an id, are copies like others; rows that only share an id are not."""
    text, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, text), (5, text), (None, text), (9, text.upper()), (None, other), (None, other), (5, "tail"), (5, "end"), (7, None), (None, None)]
    out = corpus_pipeline.drop_exact_copies(spark, docs(rows), FOLDER)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(5, text), (None, other), (5, "tail"), (5, "end"), (7, None)], key=repr)
    near_rows = [(5, text), (5, text + " x"), (None, text + " y"), (3, text + " z"), (None, other), (None, other + " q"), (5, "tail")]
    out = corpus_pipeline.drop_near_copies(spark, docs(near_rows), FOLDER)
    left = [(r.doc_id, r.text) for r in out.collect()]
    assert len(left) == 3 and (3, text + " z") in left and (5, "tail") in left and [d for d, t in left if t[0] == "b"] == [None]
    many = docs([(None, f"w{i} " * 10, "en", "src1") for i in range(200)])
    assert corpus_pipeline.mix_sources(spark, many, FOLDER).count() == 180
