"""Embedding whitening: leading eigenvectors of the covariance by Chebyshev-filtered subspace iteration.

Vectors of whole numbers are packed once into blocks: their differences from the rounded mean, in the narrowest type
that holds them. A pass over the blocks gives V Q for a narrow matrix Q, V being the covariance: each
task centres its rows, multiplies, and adds up Xᵀ(XQ); Spark adds the tasks' sums. The covariance itself is never
formed.

A round applies a Chebyshev polynomial of V to the subspace, by the three-term recurrence, one pass a
degree. It stays within one on the unwanted spectrum and grows fast above it. The result is made
orthonormal (QR), and a Rayleigh-Ritz step turns it to eigenvectors of V inside the subspace. Rounds go
on until the residuals of all wanted pairs certify them. The subspace is wider than wanted, so that the filter
has room between the last wanted value and the unwanted ones; a few Lanczos steps find their lower end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymeter.llm.negatives import matrix, smallest, usable
from waymeter.session import pin

ROWS = 4096  # vectors of a block
CERTIFIED = 2e-14  # residual of a wanted pair, against the largest eigenvalue
SETTLED = 1e-11  # one that is accepted where rounding keeps it from falling further
NOTHING = 1e-10  # eigenvalues below this share of the largest have no direction of their own
STEEP = 1e8  # how much more a round may raise the first wanted direction than the last
FURTHEST, ROUNDS, LANCZOS, SEED = 30, 60, 8, 12
MOST = 1 << 53  # entries are held to this


def fixed_point(vector: Column | str, scale: int, shift: int = 0) -> Column:
    """floor(scale * c) + shift for each component, as whole numbers."""
    return F.transform(vector, lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale).cast("double"), F.lit(float(MOST))), F.lit(float(-MOST))).cast("long") + shift)


class Sums(NamedTuple):
    """Of the fit list: rows, and for each dimension the exact sum and the whole number nearest to the mean."""

    n: int
    total: list[int]
    near: np.ndarray

    @property
    def rest(self) -> np.ndarray:
        """What the mean has beyond the rounded one; the difference is taken in whole numbers."""
        return np.array([(s - self.n * int(r)) / self.n for s, r in zip(self.total, self.near)])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one task: ``pos, n, total``; each position also counts the rows, which are shorter or not."""
    n, total = 0, np.zeros(0, object)
    for batch in batches:
        x = matrix(batch.column(0))
        if x.shape[1] > len(total):
            total = np.r_[total, np.zeros(x.shape[1] - len(total), object)]
        safe = float(np.abs(x.astype(float)).max(initial=0)) * len(x) < 1 << 62
        total[: x.shape[1]] += (x if safe else x.astype(object)).sum(axis=0)
        n += len(x)
    if n:
        places = [-1, *range(len(total))]
        yield pa.RecordBatch.from_arrays([
            pa.array(places, pa.int32()), pa.array([n, *[0] * len(total)], pa.int64()), pa.array([Decimal(int(t)) for t in [0, *total]], pa.decimal128(38, 0)),
        ], ["pos", "n", "total"])


def sums(vectors: DataFrame) -> Sums:
    """Exact sums; one row per dimension reaches the driver."""
    parts = vectors.mapInArrow(_add, "pos int, n long, total decimal(38,0)")
    found = {r["pos"]: r for r in parts.groupBy("pos").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")).collect()}
    n = found[-1]["n"] if found else 0
    total = [int(found[i]["total"]) for i in range(len(found) - 1)]
    return Sums(n, total, np.array([(2 * t + n) // (2 * n) for t in total], np.int64))


def _pack(near: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                x = matrix(part.column(1))
                x = smallest(np.pad(x, ((0, 0), (0, len(near) - x.shape[1]))) - near)
                ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.dtype.str]), pa.array([x.tobytes()], pa.binary())], ["ids", "kind", "data"])

    return run


def _opened(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Identifiers and differences from the rounded mean of each block."""
    ids, kinds, data = (batch.column(batch.schema.get_field_index(c)) for c in ("ids", "kind", "data"))
    for i in range(len(batch)):
        yield ids[i].values, np.frombuffer(data[i].as_buffer(), kinds[i].as_py()).reshape(-1, dims)


def _total(blocks: DataFrame, dims: int, size: int, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``work(block)``, ``size`` numbers, over all blocks. No more than these reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            for _, x in _opened(batch, dims):
                out += work(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(out)], ["pos", "value"])

    rows = blocks.select("ids", "kind", "data").mapInArrow(run, "pos int, value double").groupBy("pos").agg(F.sum("value").alias("value"))
    found = rows.toArrow()
    out = np.zeros(size)
    out[found["pos"].to_numpy()] = found["value"].to_numpy()
    return out


def multiplier(blocks: DataFrame, fit: Sums) -> Callable[[np.ndarray], np.ndarray]:
    """Q to V Q, by one pass over the blocks."""
    dims, rest, n = len(fit.total), fit.rest, fit.n

    def times(q: np.ndarray) -> np.ndarray:
        def work(x: np.ndarray) -> np.ndarray:
            centred = x - rest
            return (centred.T @ (centred @ q)).ravel()

        return _total(blocks, dims, q.size, work).reshape(q.shape) / n

    return times


def lower_end(times: Callable[[np.ndarray], np.ndarray], dims: int, steps: int = LANCZOS) -> float:
    """A number below the spectrum, near its end, by Lanczos steps from a random vector; 0 at least, as V has no negative values."""
    v = np.random.default_rng(SEED).standard_normal(dims)
    basis, alphas, betas = [v / np.linalg.norm(v)], [], []
    for _ in range(min(steps, dims)):
        w = times(basis[-1][:, None])[:, 0]
        alphas.append(float(basis[-1] @ w))
        held = np.array(basis)
        w -= held.T @ (held @ w)
        w -= held.T @ (held @ w)
        betas.append(float(np.linalg.norm(w)))
        if betas[-1] <= 1e-12 * max(map(abs, alphas)):
            break
        basis.append(w / betas[-1])
    m = len(alphas)
    inside = np.linalg.eigvalsh(np.diag(alphas) + np.diag(betas[: m - 1], 1) + np.diag(betas[: m - 1], -1))
    return max(0.0, float(inside[0]) - betas[m - 1])


def _growth(x: float, degree: int) -> float:
    """log of the Chebyshev polynomial of a degree at x, for x of at least 1."""
    t = degree * np.arccosh(max(x, 1.0))
    return t + np.log1p(np.exp(-2 * t)) - np.log(2)


def _degree(values: np.ndarray, k: int, low: float, cut: float, residual: float) -> int:
    """As high as certifying the last wanted pair takes, but no higher than keeps all wanted directions apart in double precision."""
    middle, half = (cut + low) / 2, (cut - low) / 2
    first, last = ((values[i] - middle) / half for i in (0, k - 1))
    for degree in range(1, FURTHEST + 1):
        if degree > 2 and _growth(first, degree) - _growth(last, degree) > np.log(STEEP):
            return degree - 1
        if _growth(last, degree) > np.log(max(10.0, 10 * residual / (CERTIFIED * values[0]))):
            return degree
    return FURTHEST


def _filtered(times: Callable, q: np.ndarray, vq: np.ndarray, degree: int, low: float, cut: float, top: float) -> np.ndarray:
    """The scaled Chebyshev polynomial of V on [low, cut], applied to q; ``vq`` is V q."""
    middle, half = (cut + low) / 2, (cut - low) / 2
    sigma = first = half / (top - middle)
    before, now = q, (vq - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (times(now) - middle * now) * (2 * after / half) - sigma * after * before
        sigma = after
    return now


def leading(times: Callable[[np.ndarray], np.ndarray], dims: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenvalues, falling, their unit eigenvectors as columns, and the largest residual.

    A vector's largest entry is positive. Values that differ by less than the residual may stand for any basis of
    their common space. Raises an error where the rounds end before the pairs are certified.
    """
    k = min(k, dims)
    wide = min(dims, k + max(8, k // 2))
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, wide)))[0]
    vq, low, best, stuck = times(q), None, np.inf, 0
    for _ in range(ROUNDS):
        inner = q.T @ vq
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residual = float(np.linalg.norm(vq[:, :k] - q[:, :k] * values[:k], axis=0).max(initial=0))
        stuck = 0 if residual < best / 2 else stuck + 1
        best = min(best, residual)
        top = max(float(values[0]), 0.0)
        if residual <= CERTIFIED * top or wide == dims or stuck >= 3 and residual <= SETTLED * top:
            break
        cut = float(values[-1])  # not above the largest unwanted value, and rising to it
        if cut > NOTHING * top:
            low = lower_end(times, dims) if low is None else low
            below = min(low, 0.9 * cut)
            q = _filtered(times, q, vq, _degree(values, k, below, cut, residual), below, cut, top)
        else:  # fewer directions vary than the subspace has: V q holds them all
            q = vq
        q = np.linalg.qr(q)[0]
        vq = times(q)
    else:
        raise RuntimeError(f"after {ROUNDS} rounds the residual is {residual / top:.1e} of the largest eigenvalue")
    q = q[:, :k]
    signs = np.sign(q[np.abs(q).argmax(axis=0), np.arange(k)])
    return values[:k], q * np.where(signs < 0, -1.0, 1.0), residual


def _deviation(x: np.ndarray, fit: Sums) -> list[int | None]:
    """Sum of (n*x - S)^2 in whole numbers; null beyond a long."""
    off = np.array([s - fit.n * int(r) for s, r in zip(fit.total, fit.near)], object)
    most = fit.n * (float(np.abs(x.astype(float)).max(initial=0)) + 1)
    if most * most * max(1, len(off)) < 1 << 62:
        far = fit.n * x.astype(np.int64) - off.astype(np.int64)
        return (far * far).sum(axis=1).tolist()
    far = fit.n * x.astype(object) - off
    return [d if d < 1 << 63 else None for d in map(int, (far * far).sum(axis=1))]


def whiten(df: DataFrame, vector: Column, components: int = 32, id_col: str = "vec_id") -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component.

    ``vector`` gives whole numbers (see :func:`fixed_point`); rows where it is null or holds a null take no part, which also
    leaves out what :func:`~waymeter.llm.negatives.usable` refuses if the caller asks for it. All others are the fit list, repeated rows and null ids
    too. Shorter vectors count as ending in zeros. Components are numbered from 1 by falling eigenvalue; there are at most as many as dimensions, and
    those whose variance is below 1e-10 of the largest are left out, since they have no direction. So one row alone, or equal
    rows, give none, and an empty table no rows. ``deviation`` is null beyond a long. Other columns are ignored.

    Runs jobs when called: one for the sums, one that packs the blocks, one per pass, and one that measures how far the whitened
    vectors' own covariance is from the identity. Matrices of dimensions x components are all that the driver holds.
    """
    kind = df.select(F.col(id_col).alias("id")).schema[0].dataType
    rows = df.select(F.col(id_col).alias("id"), vector.alias("x")).where(F.col("x").isNotNull() & F.forall("x", lambda e: e.isNotNull()))
    fit = sums(rows.select("x"))
    dims, n = len(fit.total), fit.n
    names = f"`{id_col}` {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n * dims:
        return df.sparkSession.createDataFrame([], names)
    blocks = pin(rows.mapInArrow(_pack(fit.near), f"ids array<{kind.simpleString()}>, kind string, data binary"), "blocks")
    rest = fit.rest
    values, vectors, _ = leading(multiplier(blocks, fit), dims, components)
    trace = float(_total(blocks, dims, 1, lambda x: np.array([np.square(x - rest).sum()]))[0]) / n
    kept = int((values > max(NOTHING * max(float(values[0]), 0.0), 0.0)).sum())
    values, turn = values[:kept], vectors[:, :kept] / np.sqrt(values[:kept])
    if not kept:
        return df.sparkSession.createDataFrame([], names)

    def spread(x: np.ndarray) -> np.ndarray:
        z = (x - rest) @ turn
        return np.r_[z.sum(axis=0), (z.T @ z).ravel()]

    measured = _total(blocks, dims, kept + kept * kept, spread) / n
    centre = measured[:kept]
    error = float(np.abs(measured[kept:].reshape(kept, kept) - np.outer(centre, centre) - np.eye(kept)).max())
    shares = values / trace

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in _opened(batch, dims):
                m = len(x)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.repeat(np.arange(m), kept))), pa.array(np.tile(np.arange(1, kept + 1), m), pa.int32()), pa.array(np.full(m * kept, n), pa.int64()),
                    pa.array(_deviation(x, fit), pa.int64()).take(pa.array(np.repeat(np.arange(m), kept))), pa.array(((x - rest) @ turn).ravel()),
                    pa.array(np.tile(shares, m)), pa.array(np.full(m * kept, error)),
                ], [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.mapInArrow(rows_of, names)
