"""Hard negatives and whitening against brute force, on odd vectors, and in many blocks."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymeter.llm import negatives, whitening

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    *[T.StructField(n, T.StringType()) for n in ("id", "row", "block", "score", "n", "x", "component", "rank")],
])


@pytest.fixture(scope="module")
def table(spark):
    def make(rows, parts=3):
        return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], VECTORS).repartition(parts)

    return make


def some(n, dims=6, seed=1, labels=3):
    rng = random.Random(seed)
    return [(i, [round(rng.gauss(0, 0.3), 2) for _ in range(dims)], rng.randrange(labels)) for i in range(n)]


ODD = [
    (1000, None, 1), (1001, [0.1] * 6, None), (1002, [0.1, None, 0.2, 0.1, 0.1, 0.1], 1), (1003, [math.nan] + [0.1] * 5, 1), (1010, [math.inf] + [0.1] * 5, 2),
    (20, [0.5] * 6, 1), (20, [0.5] * 6, 1), (21, [0.5] * 6, 2), (22, [0.5] * 6, 2), (None, [0.5] * 6, 2), (None, [0.4] * 6, 1), (40, [0.0] * 6, 1), (41, [0.3, 0.2], 1), (50, [], 2), (-60, [-0.5] * 6, 1), (30, [0.25] * 9, 0),
]


def mine_brute(rows, every, k=5, low=(80, 100)):
    rows = [(i, v, lab) for i, v, lab in rows if v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(256 * float(np.float32(x))) for x in v] for _, v, _ in rows]
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a, (i, _, lab) in enumerate(rows):
        if i is None or i % every:
            continue
        scores = [(sum(x * y for x, y in zip(whole[a], whole[b])), rows[b][0], rows[b][2]) for b in range(len(rows)) if b != a]
        near = sorted((s for s in scores if s[2] == lab), key=order)[:k]
        for score, other, _ in near:
            fits = sorted((s for s in scores if s[2] != lab and low[0] * score <= low[1] * s[0] <= low[1] * score), key=order)[:k]
            out += [(i, other, rank, n, score, s) for rank, (s, n, _) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def mined(df, every, **sizes):
    out = negatives.mine(df, F.col("vec_id") % every == 0, **sizes)
    return sorted((tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"block": 40, "anchors": 7}])
def test_hard_negatives(table, sizes):
    rows = some(230) + ODD
    assert mined(table(rows), 10, **sizes) == mine_brute(rows, 10)


def test_hard_negatives_of_equal_vectors_and_none(table):
    rows = [(i, [0.5, -0.25], i % 2) for i in range(60)]
    assert mined(table(rows), 5, block=16) == mine_brute(rows, 5) != []
    assert mined(table([]), 5) == [] and mined(table([(1, [0.1], 0)]), 5) == [] and mined(table([(5, [0.1], 0)]), 5) == []


def test_hard_negatives_of_huge_components(table):
    rows = [(i, [10.0 ** (i % 8) * (1 + i / 100), 1e30 if i == 7 else 0.5], i % 3) for i in range(80)]
    plain = [r for r in rows if r[0] != 7]
    got = mined(table(plain), 4)
    assert got == mine_brute(plain, 4) and len(got) > 50
    # The held component only matters to anchors of its own label: elsewhere its score is above all windows.
    assert [r for r in mined(table(rows), 4) if r[0] % 3 != 1] == [r for r in got if r[0] % 3 != 1] != []


def candidates(vectors, labels):
    n = len(vectors)
    orders = np.argsort(vectors, axis=0, kind="stable").T
    return negatives.Candidates(np.arange(n), np.zeros(n, bool), np.arange(n), labels, vectors, orders)


def test_the_search_stops_at_its_threshold():
    rng = np.random.default_rng(3)
    vectors = np.floor(256 * rng.standard_normal((4000, 4)) ** 3).astype(np.int64)
    block, looked = candidates(vectors, np.zeros(4000, np.int64)), []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            looked.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    anchor = np.array([300, -200, 100, 0])
    kind = block.exact(anchor)
    block.forms = {kind.dtype.type: kind.view(Counted)}
    top = block.search(anchor, np.ones(4000, bool), [(negatives.LEAST, negatives.MOST)], 5)[0]
    scores = vectors @ anchor
    assert [s for s, _ in top] == sorted(scores.tolist(), reverse=True)[:5]
    assert sum(looked) < 1000  # most candidates were never looked up
    low, high = int(np.quantile(scores, 0.9)), int(np.quantile(scores, 0.95))
    inside = sorted((-s, i) for i, s in enumerate(scores.tolist()) if low <= s <= high)[:5]
    assert [(-s, i) for s, i in block.search(anchor, np.ones(4000, bool), [(low, high)], 5)[0]] == inside


def test_the_search_in_any_numbers():
    rng = np.random.default_rng(5)
    for scale in (10, 1 << 20, 1 << 40):
        vectors = rng.integers(-scale, scale, (300, 5))
        anchor = rng.integers(-scale, scale, 5)
        exact = vectors.astype(object) @ anchor.astype(object)
        top = candidates(vectors, np.zeros(300, np.int64)).search(anchor, np.ones(300, bool), [(-(1 << 90), 1 << 90)], 7)[0]
        assert [s for s, _ in top] == sorted(exact.tolist(), reverse=True)[:7]


def test_matrix_of_ragged_lists():
    assert negatives.matrix(pa.array([[1, 2], [], [3]], pa.list_(pa.int64()))).tolist() == [[1, 2], [0, 0], [3, 0]]
    assert negatives.matrix(pa.array([], pa.list_(pa.int64()))).shape == (0, 0)


# --- whitening


def whitened(df, components=32, scale=64, shift=1_000_000):
    vector = F.when(negatives.usable(F.col("embedding")), whitening.fixed_point("embedding", scale, shift))
    return whitening.whiten(df, vector, components).collect()


def whiten_brute(rows, components, scale=64, shift=1_000_000):
    rows = [(i, v) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max(len(v) for _, v in rows)
    x = [[math.floor(scale * float(np.float32(c))) + shift for c in v] + [0] * (dims - len(v)) for _, v in rows]
    n, total = len(x), [sum(c) for c in zip(*x)]
    far = [[n * a - s for a, s in zip(row, total)] for row in x]
    centred = np.array([[a / n for a in row] for row in far])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = [j for j in range(min(components, dims)) if values[j] > 1e-10 * values[0]]
    return [i for i, _ in rows], [sum(a * a for a in row) for row in far], centred @ vectors[:, kept] / np.sqrt(values[kept]), values[kept] / values.sum()


def compare(rows, got, components, **kind):
    ids, deviations, want, shares = whiten_brute(rows, components, **kind)
    k = want.shape[1]
    assert len(got) == len(ids) * k and {r.n for r in got} == {len(ids)} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6
    assert sorted({(str(r.vec_id), r.deviation) for r in got}) == sorted({(str(i), d) for i, d in zip(ids, deviations)})
    z = {}
    for r in got:
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-6)
        z.setdefault((str(r.vec_id), r.deviation), {}).setdefault(r.component, r.whitened)
    for j in range(k):
        mine = np.array([z[str(i), d][j + 1] for i, d in zip(ids, deviations)])
        assert min(np.abs(mine - want[:, j]).max(), np.abs(mine + want[:, j]).max()) < 1e-6


@pytest.mark.parametrize("components", [3, 32])
def test_whitening(table, components):
    rows = some(150, dims=20, seed=4)
    compare(rows, whitened(table(rows), components), components)


def test_whitening_on_odd_vectors(table):
    rows = some(60, dims=9, seed=6) + [r for r in ODD if r[0] != 22]
    compare(rows, whitened(table(rows), 9, shift=0), 9, shift=0)
    assert whitened(table([])) == [] and whitened(table([(1, [0.5, 0.25], 0)])) == [] and whitened(table([(1, [], 0), (2, None, 1)])) == []
    assert whitened(table([(i, [0.5, 0.25], 0) for i in range(9)])) == []


def test_whitening_leaves_out_what_does_not_vary(table):
    rows = [(i, [float(i % 7), 3.0, float(i % 7), float(i % 5)], 0) for i in range(70)]
    got = whitened(table(rows), 4)
    assert {r.component for r in got} == {1, 2}
    compare(rows, got, 4)


@pytest.mark.parametrize("spectrum", ["flat", "steep", "tied", "short"])
def test_subspace_iteration(spectrum):
    rng, dims, passes = np.random.default_rng(8), 80, []
    values = {
        "flat": 1 + 0.1 * rng.random(dims), "steep": 10.0 ** -np.linspace(0, 9, dims), "tied": np.r_[[5.0] * 10, [2.0] * 30, [1.0] * 40], "short": np.r_[rng.random(20) + 1, np.zeros(60)],
    }[spectrum]
    basis = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    v = (basis * values) @ basis.T
    found, vectors, residual = whitening.leading(lambda q: passes.append(1) or v @ q, dims, 24)
    want = np.sort(values)[::-1][:24]
    assert np.abs(found - want).max() < 1e-11 * want[0] and residual < 1e-11 * want[0] and len(passes) < 200
    assert np.abs(vectors.T @ vectors - np.eye(24)).max() < 1e-12


def test_the_lower_end_is_below_the_spectrum():
    rng = np.random.default_rng(9)
    for _ in range(20):
        values = 3 + rng.random(50)
        basis = np.linalg.qr(rng.standard_normal((50, 50)))[0]
        v = (basis * values) @ basis.T
        assert 2 < whitening.lower_end(lambda q, v=v: v @ q, 50) <= values.min() + 1e-9


def test_deviation_beyond_a_long():
    fit = whitening.Sums(10**9, [5 * 10**8, 0], np.array([0, 0]))
    assert whitening._deviation(np.array([[1, 0], [10, 3]]), fit) == [25 * 10**16, None]
    fit = whitening.Sums(3, [10, 1], np.array([3, 0]))
    assert whitening._deviation(np.array([[0, 0], [-2, 1]]), fit) == [2, 53]
