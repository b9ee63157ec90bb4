import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymeter.llm import exact, near, repeats, stars, words

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def near_brute(rows, size, percent):
    sets = []
    for doc, text in rows:
        w = WORD.findall(lower(text or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            inter = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] or (inter and 100 * inter >= percent * len(sets[i] | sets[j])):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted((d is None, d, len(s), None if d is None else least[root(i)], d is None or least[root(i)] == d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_rows(out):
    return sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect())


@pytest.mark.parametrize("size", [2, 5])
def test_near_on_odd_rows(docs, odd_rows, size):
    assert near_rows(near.near_duplicates(docs(odd_rows), words=size)) == near_brute(odd_rows, size, 80)


def test_near_chains_of_edits(docs, monkeypatch):
    """A group whose members lie on both sides of the threshold, compared in many small blocks."""
    monkeypatch.setattr(near, "BLOCK_DOCS", 8)
    rng, rows = random.Random(2), []
    for group in range(3):
        base = [f"g{group}w{i}" for i in range(60)]
        for i in range(70):
            text = list(base)
            for at in rng.sample(range(60), rng.choice([1, 3, 4, 5, 6])):
                text[at] = f"e{rng.randrange(4)}"
            rows.append((group * 1000 + i, " ".join(text)))
    rows += [(5000 + i, " ".join(f"r{rng.randrange(500)}" for _ in range(50))) for i in range(40)]
    rng.shuffle(rows)
    want = near_brute(rows, 2, 80)
    assert 5 < len({r[3] for r in want}) < len(rows)
    assert near_rows(near.near_duplicates(docs(rows), words=2)) == want


def test_near_one_id_ties_classes(docs):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(3, a), (5, a), (5, b), (7, b)]
    assert {r.component_id for r in near.near_duplicates(docs(rows)).collect()} == {3}


def test_near_empty(docs):
    assert near.near_duplicates(docs([])).collect() == []


def test_stars_against_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(50)] + [(2000 + i, 2001 + i) for i in range(40)]
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    nodes = {x for link in links for x in link}
    got = {r.node: r.component for r in stars.components(spark.createDataFrame(links + [(None, 1)], "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in nodes if root(x) != x}


def test_words_against_regex():
    texts = ["", None, " a  b\tc\x0b", "é ü x", "one", "\x1c\x1d", "a" * 70 + " b"]
    got = words.split(pa.array(texts), lower=True)
    for i, t in enumerate(texts):
        own = [bytes(got.buf[s:e]).decode() for s, e in zip(got.start[got.first[i] : got.first[i + 1]], got.end[got.first[i] : got.first[i + 1]])]
        assert own == WORD.findall(lower(t or ""))
    sliced = pa.array(["skip me", "a b", "b a"]).slice(1)
    h = words.word_hashes(words.split(sliced))
    assert h[0] == h[3] and h[1] == h[2] and h[0] != h[1]
    runs = words.window_hashes(h, 2)
    assert len(set(runs.tolist())) == 3 and len(words.window_hashes(h, 9)) == 0


def test_word_hashes_in_small_blocks(monkeypatch):
    texts = pa.array(["".join(random.Random(i).choice("ab ") for _ in range(400)) for i in range(5)])
    whole = words.word_hashes(words.split(texts))
    monkeypatch.setattr(words, "BLOCK", 16)
    assert (words.word_hashes(words.split(texts)) == whole).all()
    assert sum(len(t) for _, t in words.blocks(texts, 500)) == 5


def exact_brute(rows, largest):
    groups = {}
    for doc, text in rows:
        groups.setdefault(lower(text or ""), []).append(doc)
    pick = max if largest else min
    out = []
    for doc, text in rows:
        ids = [d for d in groups[lower(text or "")] if d is not None]
        keep = pick(ids) if ids else None
        out.append((doc is None, doc, keep, len(groups[lower(text or "")]), doc == keep, hashlib.sha256(lower(text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("runs, fan_in", [(256, 16), (5, 2), (1, 2)])
def test_exact(docs, odd_rows, largest, runs, fan_in):
    rows = odd_rows + [(100 + i, "Hot Copy") for i in range(60)]
    got = exact.exact_duplicates(docs(rows, 7), largest=largest, runs=runs, fan_in=fan_in).collect()
    assert sorted([(r.doc_id is None, r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got], key=repr) == exact_brute(rows, largest)
    assert exact.exact_duplicates(docs([])).collect() == []


def test_exact_merges_sorted_runs(docs):
    """A round exchanges by range once, sorts, and reads neighbours; nothing regroups or drops the order."""
    entries = exact.exact_duplicates(docs([(i, f"t{i % 40}") for i in range(400)], 7)).select("doc_id", F.unhex("text_sha256").alias("digest"))
    entries = entries.select((F.col("doc_id") % 5).cast("int").alias("run"), "digest", F.octet_length("digest").alias("length"), F.xxhash64("digest").alias("proof"), F.col("doc_id").alias("keep"), F.lit(1).alias("rows"))
    formed = exact.form_runs(entries)
    merged = exact.merge_round(formed, 5)
    plan = merged._jdf.queryExecution().sparkPlan().toString()
    physical = merged._jdf.queryExecution().executedPlan().toString()
    above = physical[: physical.index("HashAggregate")]
    assert "rangepartitioning(run" in above and "hashpartitioning" not in above and "Sort [run" in above and "Window" in plan
    rows = merged.select("run", "digest", "keep", "rows", F.spark_partition_id().alias("part")).collect()
    assert len(rows) == 40 and {r.rows for r in rows} == {10} and sorted(r.keep for r in rows) == list(range(40))
    for part in {r.part for r in rows}:
        inside = [bytes(r.digest) for r in rows if r.part == part]
        assert inside == sorted(inside)


def test_exact_has_no_python(docs):
    plan = exact.exact_duplicates(docs([(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


def repeats_brute(rows, length):
    first, texts = {}, [(d, (t or "").encode().split()) for d, t in rows]
    for doc, w in texts:
        if doc is not None:
            for s in range(len(w) - length + 1):
                key = tuple(w[s : s + length])
                first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, w in texts:
        gone = [False] * len(w)
        for s in range(len(w) - length + 1 if doc is not None else 0):
            if first[tuple(w[s : s + length])] < doc:
                gone[s : s + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc is None, doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length", [4, 50])
def test_repeats(docs, odd_rows, length):
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(90)]
    rows = list(odd_rows)
    for i in range(60):
        text = [f"u{rng.randrange(40)}" for _ in range(rng.randrange(120))]
        if i % 2:
            at, low = rng.randrange(len(text) + 1), rng.randrange(45)
            text[at:at] = passage[low : low + rng.choice([3, 4, 49, 50, 51, 90])]
        rows.append((200 + i, rng.choice([" ", "  ", "\n"]).join(text)))
    got = repeats.cut_repeats(docs(rows), length=length)
    assert sorted((r.doc_id is None, r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == repeats_brute(rows, length)
    for r in got.where("kept_text is not null").collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def longest_brute(rows, length):
    out = []
    for doc, text in rows:
        w, size, best = WORD.findall(text or ""), length, 0
        others = [WORD.findall(t or "") for d, t in rows if d not in (None, doc)]
        while doc is not None and size <= len(w):
            theirs = {tuple(o[s : s + size]) for o in others for s in range(len(o) - size + 1)}
            if not any(tuple(w[s : s + size]) in theirs for s in range(len(w) - size + 1)):
                break
            best, size = size, size * 2
        out.append((doc is None, doc, best))
    return sorted(out)


@pytest.mark.parametrize("length, shared_ids", [(4, False), (4, True), (10, True)])
def test_repeats_longest_level(docs, length, shared_ids, monkeypatch):
    """Passages of many lengths, some inside others, repeats within one text, copies, rows that repeat or share an id."""
    monkeypatch.setattr(repeats, "PLACES", 7)
    rng, run = random.Random(9), [f"z{i}" for i in range(170)]
    rows = [(i, " ".join([f"u{i}x{j}" for j in range(3)] + run[(low := rng.randrange(100)) : low + rng.randrange(70)])) for i in range(40)]
    rows += [(50, "a b c d e " * 30), (51, "a b c d e " * 9), (52, "q " + "a b c d e " * 4), (60, " ".join(run)), (61, "  ".join(run)), (62, " ".join(run[:12])), (63, " ".join(run[:12]))]
    rows += [(70, "lonely " * 90), (71, " ".join(f"k{i}" for i in range(30))), (71, " ".join(f"k{i}" for i in range(30))), (71, " ".join(f"k{i}" for i in range(40)))]
    if shared_ids:
        rows += [(5, " ".join(run[3:80])), (72, " ".join(run[:70])), (72, " ".join(run[20:150])), (72, " ".join(run[20:150]) + " end"), (-1, " ".join(run[:90])), (-1, " ".join(run[30:]))]
    rows += [(None, " ".join(run)), (None, None), (80, ""), (81, None)]
    got = repeats.cut_repeats(docs(rows), length=length).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.longest) for r in got) == longest_brute(rows, length)
    assert sorted((r.doc_id is None, r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == repeats_brute(rows, length)
    assert {r.longest for r in got} > {0, length, 4 * length}


def test_repeats_limits(docs):
    with pytest.raises(ValueError):
        repeats.cut_repeats(docs([]), length=5)
    assert repeats.cut_repeats(docs([])).collect() == []


def test_repeats_extends_survivors_only():
    """A doubled window comes from two survivors of the same row, one length apart; one of them alone gives none."""
    places = np.array([0, 1, 4, 9])
    digests = np.frombuffer(b"".join(bytes([p]) * 16 for p in places), repeats.DIGEST)
    doubled, joined = repeats.extend(places, digests, 4)
    assert doubled.tolist() == [0] and joined == hashlib.blake2b(bytes(16) + bytes([4]) * 16, digest_size=16).digest()
    assert [len(x) for x in repeats.extend(places[:0], digests[:0], 4)] == [0, 0]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:800], rng.integers(0, 1 << 63, 100, dtype=np.uint64)]))
    s = near.signatures([a, b, a[:0]])
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.15 and (s[2] == 0xFFFFFFFF).all()
