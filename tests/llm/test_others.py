import base64
import gzip
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waymeter.functions.binomial import binomial_tail
from waymeter.llm import archives, bpe, mixing, quality, queries, secrets, shards, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# --- byte pair encoding


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(open(VOCABULARY, encoding="utf-8").read())


def test_bpe_on_odd_rows(docs, odd_rows):
    rows = [*odd_rows, (77, "a<|endoftext|> b<|endoftext|>"), (78, "it's  'll\n\n x1²½ 😀é" * 9), (79, "z" * 300), (80, "<|endoftext|>")]
    theirs = Tokenizer.from_file(VOCABULARY)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for doc, text in rows:
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        decoded = theirs.decode(ids, skip_special_tokens=False)
        want.append((doc, len(ids), ids, decoded, sha(",".join(map(str, ids))), sha(decoded)))
    got = bpe.encode(docs(rows), VOCABULARY).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids, r.decoded, r.ids_sha256, r.decoded_sha256) for r in got), key=repr) == sorted(want, key=repr)
    assert bpe.encode(docs([]), VOCABULARY).collect() == []


def test_bpe_one_word_and_many_agree(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    rng = random.Random(3)
    words = ["".join(rng.choice("abthe in") for _ in range(rng.randrange(2, 66))).encode() for _ in range(400)]
    for size in (1, 2, 4, 8, 16, 32, 64):
        fits = [w for w in words if size // 2 + 1 < len(w) <= size + 1]
        assert vocabulary.merge_many(fits, size) == [vocabulary.merge(w) for w in fits] if fits else True
    theirs = Tokenizer.from_file(VOCABULARY)
    texts = ["".join(rng.choice("abc 's\nTé1.<|endoftext|>") for _ in range(rng.randrange(80))) for _ in range(500)]
    assert vocabulary.encode_many(texts) == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]


# --- secrets


def spans_brute(text):
    found = []
    for kind, pattern, group, least in (
        ("assign", r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24),
    ):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    order = ["assign", "access", "hex"]
    return sorted(found, key=lambda s: (s[0], order.index(s[1])))


SECRETS = [
    (1, "éé password = 'hunter22' and token:abc secret: token : abcdefghi"), (2, "AKIA" + "A1" * 9 + " AKIAAKIA" + "Z" * 11 + " AKIA123"), (3, "deadbeef" * 3 + " " + "0" * 23 + " x" + "a1" * 20),
    (4, None), (5, ""), (6, "paſſword=abcdefgh toKen=abcdefgh API_KEY=\"abc.def-1"), (7, "😀api_key:abcdefg, passwd=abcdef"), (8, "eyJhbGciOi.eyJzdWIiOiIx.abcdefghijklmnopqrstuvwxyz http://bob:pa55word@host/"), (8, "token=aaaaaaa"),
    (None, "secret=zzzzzzzz"), (9, "-----BEGIN RSA PRIVATE KEY-----"),
]


def test_secrets(docs, odd_rows):
    got = secrets.summary(docs(SECRETS + odd_rows)).collect()
    by_id = {}
    for doc, text in SECRETS + odd_rows:
        by_id.setdefault(doc, set()).add(text or "")
    assert len(got) == len(SECRETS) + len(odd_rows)
    for r in got:
        spans = sorted((s for t in by_id[r.doc_id] for s in spans_brute(t)), key=lambda s: (s[0], ["assign", "access", "hex"].index(s[1]), s[2]))
        listed = ",".join(f"{k}:{a}:{b}" for a, k, b in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in ("assign", "access", "hex")), r
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), r
        assert [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")] == [s for s in listed.split(",") if s]
    spans = {r.doc_id: r.spans for r in got}
    assert "jwt:0:" in spans[8] and "url:" in spans[8] and spans[9].startswith("pem:0:")
    assert secrets.summary(docs([])).collect() == []


def test_ledger_scans_only_the_unseen(docs, tmp_path):
    only = lambda *names: {n: secrets.RULES[n] for n in names}
    path, spark = str(tmp_path / "ledger"), docs([]).sparkSession
    first = [(1, "token=abcdefg"), (2, "token=abcdefg"), (3, "nothing")]
    assert secrets.scan(docs(first), path, rules=only("assign")).count() == 2
    pairs = lambda: secrets.read_ledger(spark, path).select("blob", "rule").collect()
    assert len(pairs()) == 2
    # A version with one new blob, under a path that has moved; the old blobs are joined back without a scan.
    assert {(r.doc_id, r.kind) for r in secrets.scan(docs([(9, "token=abcdefg"), (10, "secret=qqqqqqq")]), path, rules=only("assign")).collect()} == {(9, "assign"), (10, "assign")}
    assert len(pairs()) == 3
    # Another rule meets all blobs anew, the known pairs stay.
    secrets.scan(docs(first), path, rules=only("assign", "hex"))
    assert len(pairs()) == 5 == len(set(pairs()))
    secrets.scan(docs(first), path, rules={"assign": (secrets.RULES["assign"][0], 2, 5)})
    assert len(pairs()) == 7


def test_secrets_of_each_row(docs, odd_rows, tmp_path):
    folder, n = str(tmp_path / "in"), 40
    rows = SECRETS + odd_rows + [(None, f"{'x ' * (i % 7)}token=abcdef{i}") for i in range(n)] + [(8, "clean"), (None, "clean"), (None, "secret=zzzzzzzz")]
    docs(rows).write.parquet(f"{folder}/documents.parquet")
    got = queries.op2_blob_ledger_secrets(docs([]).sparkSession, folder).collect()
    want = []
    for doc, text in rows:
        spans = spans_brute(text or "")
        listed = ",".join(f"{k}:{a}:{b}" for a, k, b in spans)
        want.append((doc, *(sum(s[1] == k for s in spans) for k in ("assign", "access", "hex")), hashlib.sha256(listed.encode()).hexdigest()))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert sum(len(r.spans) for r in got if r.doc_id is None) < 40 * (n + 5)
    blobs = {(r.doc_id, r.blob.hex()) for r in secrets.scan(docs(SECRETS)).collect() if r.doc_id == 8}
    assert blobs == {(8, hashlib.sha256(t.encode()).hexdigest()) for d, t in SECRETS if d == 8}


LONG_SECRETS = [
    (1, f"redis://:{'p' * 300}@h and postgres://{'u' * 200}:{'q' * 500}@db/x amqp://u:ab@h"), (2, f"-----BEGIN {'A B ' * 40}PRIVATE KEY-----\n-----BEGIN PRIVATE KEY-----"), (3, "http://h:80/a@b ftp://:@h x://u:pw1@h"),
]


def test_secrets_have_no_upper_bounds(docs):
    patterns = {"pem": "-----BEGIN [A-Z ]*PRIVATE KEY-----", "url": "[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0d:/@]*:[^\x20\x09-\x0d:/@]{3,}@"}
    got = sorted((r.doc_id, r.kind, r.start, r.end) for r in secrets.scan(docs(LONG_SECRETS)).collect() if r.kind in patterns)
    want = sorted((i, kind, m.start(), m.end()) for i, text in LONG_SECRETS for kind, p in patterns.items() for m in re.finditer(p, text))
    assert got == want and len(got) == 4


def test_repeated_rows_are_scanned_once(spark, docs, monkeypatch):
    """The same row many times, and one text under null ids: each blob is one row of the scan, by either plan."""
    rows = [(5, "token=abcdefg")] * 40 + [(None, "secret=qqqqqqq")] * 40
    usual, seen, real = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), [], secrets._one_each
    monkeypatch.setattr(secrets, "_one_each", lambda *a: seen.append(real(*a).collect()) or real(*a))
    try:
        for limit in ("10m", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            assert [r.n_assign for r in secrets.by_row(docs(rows)).collect()] == [1] * 80
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert [len(s) for s in seen] == [2, 2]


# --- shards


@pytest.mark.parametrize("most", [1 << 17, 40])
def test_shards(docs, odd_rows, most):
    rng = random.Random(5)
    rows = odd_rows + [(500 + i, "hot copy of one text") for i in range(300)] + [(1000 + i, "w " * rng.randrange(60)) for i in range(300)]
    got = shards.shards(docs(rows), most=most).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows), key=repr)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    total, longest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in range(8):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 8) <= longest
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.text_crc32 for r in order] == sorted(r.text_crc32 for r in got)
    upto = 0
    for r in order:
        assert r.shard == min(7, (2 * upto + r["size"]) * 8 // (2 * total))
        upto += r["size"]


@pytest.mark.parametrize("giants", [1, 10])
def test_shards_of_few_giants(docs, giants):
    """Records that hold nearly all bytes among many small ones, or all of one key: the ranges still get small."""
    rows = [(i, "same" if i % 2 else f"t{i}") for i in range(300)] + [(1000 + i, "g" * (2_000_000 + i)) for i in range(giants)]
    got = shards.shards(docs(rows), most=20).collect()
    total, longest = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert len(got) == len(rows)
    for s in range(8):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own))) and abs(sum(r["size"] for r in own) - total / 8) <= longest


def test_shards_always_sample(docs, monkeypatch):
    """The method runs on a table of any size, with the default limit too."""
    rounds, real = [], shards._divide
    monkeypatch.setattr(shards, "_divide", lambda *a: rounds.append(real(*a)) or rounds[-1])
    shards.shards(docs([(i, f"t{i}") for i in range(500)])).collect()
    assert rounds[0].select("rng").distinct().count() == shards.RANGES and rounds[1:] == [None]


def test_shards_small(docs):
    assert shards.shards(docs([])).collect() == []
    assert [(r.shard, r.slot) for r in shards.shards(docs([(1, None)])).collect()] == [(4, 0)]


# --- mixing


def fill_brute(caps, weights, budget):
    """One token level at a time, with whole shares as the operator has them."""
    live = sorted((n for n in caps if weights[n] > 0), key=lambda n: (caps[n] / weights[n], n))
    out, left = {n: 0 for n in caps}, budget
    while live:
        n, whole = live[0], sum(weights[m] for m in live)
        if caps[n] * whole > weights[n] * left:
            return out | {m: weights[m] * left // whole for m in live}
        out[n] = caps[n]
        left -= caps[n]
        live.pop(0)
    return out


def mix_brute(rows, levels, weights, share, epochs, seed):
    tokens = [len(WORD.findall(t or "")) for _, t, *_ in rows]
    leaf = [tuple(f(r) or "" for f in levels) for r in rows]
    names, total = ["domain", "lang", "source"], sum(tokens)
    cap = {}
    for l, t in zip(leaf, tokens):
        cap[l] = cap.get(l, 0) + t * epochs
    budget = {(): total * share[0] // share[1]}
    for depth in range(3):
        below = {}
        for l, c in cap.items():
            below[l[: depth + 1]] = below.get(l[: depth + 1], 0) + c
        for parent in {l[:depth] for l in cap}:
            kids = {k: c for k, c in below.items() if k[:depth] == parent}
            budget |= fill_brute(kids, {k: weights.get(names[depth], {}).get(k[-1], 1) for k in kids}, budget[parent])
    out = []
    for l in cap:
        own = [i for i in range(len(rows)) if leaf[i] == l]
        have, got = sum(tokens[i] for i in own), budget[l]
        whole = got // have if have else 0
        key = lambda i: (hashlib.md5(f"{seed}:{whole}:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), tokens[i])
        upto = 0
        for i in sorted(own, key=key):
            upto += tokens[i]
            fits = got > 0 and upto <= got - whole * have
            border = 0 if fits or got <= 0 else max(0, got - whole * have - upto + tokens[i])
            out.append((rows[i][0], *l, tokens[i], have, got, whole + fits, border))
    return sorted(out, key=repr)


@pytest.mark.parametrize("share, epochs", [((1, 1), 4), ((1, 3), 1), ((2, 1), 1), ((7, 2), 3)])
def test_mix(docs, odd_rows, share, epochs, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)
    monkeypatch.setattr(mixing, "BLOCK_BUCKETS", 3)
    rng = random.Random(8)
    rows = [(i, "t " * rng.randrange(40), rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", "src2", None])) for i in range(200)]
    rows += [(d, t, "en", "src9") for d, t in odd_rows if t is None or len(t) < 6000]
    weights = {"domain": {"a": 3}, "lang": {"en": 5, "de": 2}, "source": {"src0": 7, "src2": 0}}
    levels = [lambda r: "a" if r[3] in ("src0", "src1") else "b", lambda r: r[2], lambda r: r[3]]
    domain = F.when(F.col("source").isin("src0", "src1"), "a").otherwise("b")
    out = mixing.mix(docs(rows), {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}, weights, share, epochs)
    got = sorted(((r.doc_id, r.domain, r.lang, r.source, r.tokens, r.leaf_tokens, r.leaf_budget, r.copies, r.border_tokens) for r in out.collect()), key=repr)
    assert got == mix_brute(rows, levels, weights, share, epochs, 17)
    given, budget, borders = {}, {}, {}
    for _, *leaf, tokens, have, wanted, copies, border in got:
        leaf = tuple(leaf)
        given[leaf] = given.get(leaf, 0) + tokens * copies + border
        borders[leaf] = borders.get(leaf, 0) + (border > 0)
        budget[leaf] = wanted
    assert given == budget and max(borders.values()) <= 1
    assert mixing.mix(docs([]), {"lang": F.col("lang")}, {}).collect() == []


# --- archives


def test_convert_pages(spark, tmp_path):
    rows = [(i, f"http://h/{i} x\n", f"<p>é{i}</p>\r\n\r\nbody\n") for i in range(40)] + [(100 + i, "http://h/copy", "same\n\npayload") for i in range(50)]
    rows += [(200, None, None), (201, "u", ""), (None, "http://h/none", "same\n\npayload"), (None, "v", "lone"), (5, "http://h/5", "<p>é5</p>\r\n\r\nbody\n"), (300, "big", "<b>" * 200_000), (301, "x", "WARC/1.1\r\n\r\nGET 3\n")]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame([(*r, "y", "z") for r in rows], "page_id long, url string, html string, record_id string, payload string").repartition(3)
    got = archives.convert_pages(frame, str(tmp_path / "a")).collect()
    groups = {}
    for page, _, html in rows:
        groups.setdefault(html or "", []).append(page)
    want = []
    for html, pages in groups.items():
        pages = sorted(pages, key=lambda p: (p is None, p))
        data = html.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want += [(p, len(data), digest, "revisit" if i else "response", pages[0] if i else None) for i, p in enumerate(pages)]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    again = archives.read_warc(spark, str(tmp_path / "a/warc"))
    assert again.where("record_type = 'response' and date = '2024-01-01T00:00:00Z'").count() == len(groups)
    assert {r.version for r in archives.read_arc(spark, str(tmp_path / "a/arc")).collect()} == {1, 2}
    assert archives.convert_pages(frame.limit(0), str(tmp_path / "b")).collect() == []


VERSIONS = {1: b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n", 2: b"2 0 x\n"}


def arc_head(version=1):
    block = VERSIONS[version]
    return archives.arc_line(version, "filedesc://x", "0.0.0.0", "20000101000000", "text/plain", len(block)) + block


def arc_page(page, payload, version=1):
    body = b"HTTP/1.1 200 OK\r\nX-Page-Id: %d\r\n\r\n" % page + payload
    return b"\n" + archives.arc_line(version, f"http://h/{page}", "1.1.1.1", "20000102030405", "text/html", len(body)) + body


def test_arc_records():
    head, dns = arc_head(), archives.arc_line(1, "dns:h", "1.1.1.1", "20000102030405", "text/dns", 3) + b"a\nb"
    assert [r[1:] for r in archives.arc_records(head + b"\n" + dns + b"\n\0")] == [("dns:h", "1.1.1.1", "20000102030405", "text/dns", 1, b"a\nb", None)]
    assert b"WARC-Date: 2000-01-02T03:04:05Z" in archives.warc_record("resource", "k", "dns:h", "1.1.1.1", "20000102030405", "text/dns", b"", b"a\nb", "D", None)
    for bad, good in ((dns, 0), (head + b"\n" + dns + dns[:-1], 1), (head.replace(b"1 0 x", b"3 0 x"), 0), (head + b"\nhttp://a b 3\nabc\n" + dns, 1), (head + b"\n" + dns + b"\nno length\n", 1), (head + dns + b"x", 1)):
        found = list(archives.arc_records(bad))
        assert sum(r[-1] is not None for r in found) == 1 and sum(r[-1] is None for r in found) == good, bad
    assert list(archives.arc_records(b"")) == []


def test_compressed_files():
    members = b"".join(gzip.compress(bytes([i]) * (i * 900)) for i in range(60)) + b"\0\0"
    whole = b"".join(bytes([i]) * (i * 900) for i in range(60))
    assert archives.inflate(members) == (whole, None) and archives.inflate(whole) == (whole, None) and archives.inflate(b"") == (b"", None)
    for broken in (members[:-40], members[:-30] + b"junk" + members[-30:]):
        data, error = archives.inflate(broken)
        assert error and whole.startswith(data) and len(data) > 50_000


BODIES = [b"caf\xe9 \xff\xfe", b"\0\0nul\0", gzip.compress(b"a compressed body", mtime=0), b"", b"\r\n\r\nGET\n", bytes(range(256)) * 50]


def test_real_archives(spark, tmp_path):
    """Bytes in any encoding, both versions, plain and compressed, with broken records and a file that ends early."""
    (tmp_path / "in/deep").mkdir(parents=True)
    one = arc_head() + b"".join(arc_page(i, b) for i, b in enumerate(BODIES))
    (tmp_path / "in/a.arc").write_bytes(one)
    two = [arc_head(2)] + [arc_page(10 + i, b, 2) for i, b in enumerate(BODIES)]
    (tmp_path / "in/deep/b.arc.gz").write_bytes(b"".join(map(gzip.compress, two)))
    (tmp_path / "in/c.arc").write_bytes(arc_head() + arc_page(20, b"kept") + b"\nhttp://bad 3\nabc" + arc_page(21, b"also kept") + arc_page(22, b"lost")[:-2])
    cut = gzip.compress(arc_head() + arc_page(30, b"whole")) + gzip.compress(arc_page(31, os.urandom(5000)))[:-2000]
    (tmp_path / "in/d.arc.gz").write_bytes(cut)
    (tmp_path / "in/e.arc").write_bytes(b"not an archive")
    wrong = archives.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    told = sorted((r.file.rsplit("/", 1)[1], r.error.split(" ")[0]) for r in wrong.collect())
    assert told == [("c.arc", "2"), ("c.arc", "2"), ("d.arc.gz", told[2][1]), ("d.arc.gz", "compressed"), ("e.arc", "no")]
    got = archives.read_warc(spark, str(tmp_path / "out")).collect()
    assert {r.page_id: bytes(r.payload) for r in got if r.record_type == "response"} == {**dict(enumerate(BODIES)), 20: b"kept", 21: b"also kept", 30: b"whole"}
    back = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in archives.resolve(spark, str(tmp_path / "out")).collect()}
    assert all(back[10 + i] == ("revisit", i, len(b)) for i, b in enumerate(BODIES)) and len(back) == 2 * len(BODIES) + 3
    for file in (tmp_path / "out").glob("part-*"):  # each record is a member of its own, for any gzip reader
        data = file.read_bytes()
        assert gzip.decompress(data) == archives.inflate(data)[0] and data.count(b"\x1f\x8b\x08") >= 1


def test_archives_are_read_once_a_step(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame([(i, "u", f"p{i % 7}") for i in range(50)], "page_id long, url string, html string")
    frames, real = [], archives._open
    monkeypatch.setattr(archives, "_open", lambda *a: frames.append(real(*a)) or frames[-1])
    archives.convert_pages(frame, str(tmp_path / "a"))
    assert len(frames) == 2  # the ARC files, used for facts and for the conversion, and the WARC files
    marks = archives.revisits(spark.createDataFrame([("f", 1, 1, 1, "d", None), ("f", 2, 2, 1, "d", None)], archives.FACTS))
    plan = archives.with_marks(frames[0], marks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("binaryFile") == 1
    out = archives.resolve(spark, str(tmp_path / "a/warc"))
    assert "binaryFile" not in out._jdf.queryExecution().optimizedPlan().toString()  # only the written facts


def test_archives_are_closed_by_size(spark, tmp_path, monkeypatch):
    pieces = list(archives._packed([(b"open", b"x" * (archives.ARCHIVE // 2))] * 5, b"\n"))
    assert len(pieces) == 3 and all(archives.inflate(p.column(0)[0].as_py())[0].startswith(b"open\nx") for p in pieces)


# --- quality rules


def measures_brute(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(docs, odd_rows, spark):
    rng = random.Random(9)
    rows = odd_rows + [(300 + i, rng.choice([" ", "\n"]).join(rng.choice(["a", "b#", "c|", "é"]) for _ in range(rng.randrange(60)))) for i in range(80)]
    rows += [(400, " ".join(["loop"] * 400)), (401, " ".join(f"k{i % 9}" for i in range(50))), (402, "x\nx\n \n \ny")]
    got = quality.judge(docs(rows), spark.createDataFrame([], "doc_id long, quality int")).collect()
    want = []
    for doc, text in rows:
        n, chars, symbols, dup, repeat = measures_brute(text)
        failed = n < 20 or 100 * repeat > 30 * n
        want.append((doc, n, chars, symbols, dup, repeat, failed, not failed))
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got), key=repr) == sorted(want, key=repr)


def tail_brute(k, n, p):
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


def test_binomial_tail(spark):
    cases = [(0, 10), (3, 900), (0, 3000), (7, 2500), (40, 10_000), (60, 10_000), (0, 0), (5, 5)]
    got = {(r.k, r.n): r.p for r in spark.createDataFrame(cases, "k long, n long").select("k", "n", binomial_tail(F.col("k"), F.col("n"), 0.005).alias("p")).collect()}
    for k, n in cases:
        want = 1.0 if k > n * 0.005 else tail_brute(k, n, 0.005)
        assert got[k, n] == pytest.approx(want, rel=1e-9), (k, n)


def test_quality_cutoffs_hold_on_fresh_texts(docs, spark):
    rng = random.Random(10)

    def text(bad):
        return " ".join((f"w{rng.randrange(10**6)}" + ("###" if bad and rng.random() < 0.7 else "#" if rng.random() < 0.01 else "")) for _ in range(30))

    rows = [(i, text(i % 4 == 0), rng.choice(["en", "de"])) for i in range(9000)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(6000)] + [(None, 1), (1, None)], "doc_id long, quality int")
    out = quality.judge(docs(rows), labels, stratum=F.col("lang")).collect()
    fresh = [r for r in out if r.doc_id >= 6000]
    good, bad = [r for r in fresh if r.doc_id % 4], [r for r in fresh if r.doc_id % 4 == 0]
    assert sum(not r.kept for r in good) <= 0.01 * len(good)
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad)
    assert {x for r in bad for x in r.failed_rules} == {"symbols"}
    # Too few labels certify nothing.
    few = quality.judge(docs(rows[:500]), labels.where("doc_id < 200"), stratum=F.col("lang"))
    assert few.where("not kept").count() == 0


def test_quality_has_no_python(docs, spark):
    measured = quality.measures(docs([(1, "a")]))
    rules = quality.cutoffs(measured, spark.range(3).selectExpr("id as doc_id", "1 as quality"))
    for frame in (measured, rules):
        assert not re.search("Python|Pandas|MapInArrow", frame._jdf.queryExecution().toString())


# --- toxicity


def test_toxicity_on_held_out_texts(docs, spark):
    rng = random.Random(12)
    mean = ["vilex", "grobn", "snarkt", "foulm"]

    def text(toxic):
        words = [f"n{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}o" for _ in range(rng.randrange(10, 80))]
        for _ in range(rng.randrange(1, 9) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(mean) + rng.choice(["", "e", "ing"]))
        return " ".join(words)

    rows = [(i, text(i % 5 == 0)) for i in range(1500)] + [(None, "x"), (3000, None), (3001, ""), (3002, "nao " * 40_000), (3003, " ".join(mean * 2))]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(800)] + [(None, 1), (7, None), (8, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs(rows), labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r.doc_id: r for r in toxicity.grade(docs(rows), model).collect()}
    fresh = [got[i] for i in range(800, 1500)]
    assert sum(r.toxic != (r.doc_id % 5 == 0) for r in fresh) <= 7
    assert all(got[i].kept and got[i].expected_severity < model.cutoff for i in (None, 3000, 3001, 3002))
    assert got[3003].grade >= 2 and 0 <= got[3003].expected_severity <= 3
    again = toxicity.train(docs(rows, 7), labels)
    assert (again.weights == model.weights).all() and again.cutoff == model.cutoff


def test_toxicity_without_a_model(docs, spark):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs([(1, "a b")]), labels)
    assert model is None
    assert [(r.expected_severity, r.kept) for r in toxicity.grade(docs([(1, "a b")]), model).collect()] == [(0.0, True)]
    assert toxicity.fit([], np.array([], int)) is None
    assert toxicity.grade(docs([]), model).collect() == []


def test_features_do_not_cross_texts():
    row, hashes = toxicity.features(pa.array(["ab,cd", None, "CD"]))
    assert sorted(row.tolist()) == [0, 0, 0, 0, 2, 2] and set(hashes[row == 2].tolist()) < set(hashes[row == 0].tolist())
