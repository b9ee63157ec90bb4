"""Words of Arrow text columns as numpy arrays.

A word is a longest run of bytes other than ``\\x20`` and ``\\x09`` to ``\\x0D``. These are single
bytes in UTF-8, so words are cut in the text's own buffer, without a Python object for each.
Hashes are 64 bits wide: equal words and equal runs of words always agree, and two different
ones agree with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20  # bytes of text worked on at once, unless a single text is longer
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


class Words(NamedTuple):
    buf: np.ndarray  # the bytes of all texts
    start: np.ndarray  # first byte of each word
    end: np.ndarray
    row: np.ndarray  # the text that a word is in
    first: np.ndarray  # index of each text's first word, and the number of words at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def blocks(texts: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, pa.Array]]:
    """Runs of consecutive texts of at most ``most`` bytes (a longer text alone), and where each begins."""
    sizes = pc.binary_length(texts).fill_null(0).to_pylist()
    at, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield at, texts.slice(at, i - at)
            at, held = i, 0
        held += size
    if at < len(texts):
        yield at, texts.slice(at)


def split(texts: pa.Array, lower: bool = False, apart: np.ndarray = _SPACE) -> Words:
    """The words of each text (none in a null one), on request with A-Z lower-cased.

    ``apart`` marks the bytes between words.
    """
    texts = pa.concat_arrays([texts.cast(pa.large_binary()).fill_null(b"")])
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    if lower:
        buf = _LOWER[buf]
    space = apart[buf]
    starts, ends = ~space, ~space
    if len(buf):
        cuts = edges[(edges > 0) & (edges < len(buf))]
        before, after = np.r_[True, space[:-1]], np.r_[space[1:], True]
        before[cuts] = True
        after[cuts - 1] = True
        starts, ends = starts & before, ends & after
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, edges)
    return Words(buf, start, end, np.repeat(np.arange(len(texts)), np.diff(first)), first)


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd number and of its inverse modulo 2**64."""
    for b in (base, pow(base, -1, 1 << 64)):
        if len(_powers.get(b, ())) < n:
            grown = np.full(n + n // 8 + 4096, b, np.uint64)
            grown[0] = 1
            _powers[b] = np.multiply.accumulate(grown)
    return _powers[base][:n], _powers[pow(base, -1, 1 << 64)][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: Words) -> np.ndarray:
    """A hash for each word, made in blocks so that the working memory is bounded."""
    out = np.zeros(len(words.start), np.uint64)
    at = 0
    while at < len(out):
        upto = max(at + 1, int(np.searchsorted(words.end, words.start[at] + BLOCK, "right")))
        low, high = words.start[at], words.end[upto - 1]
        power, inverse = _powers_of(_BASE, high - low + 1)
        run = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[words.buf[low:high]] * power[:-1], out=run[1:])
        s, e = words.start[at:upto] - low, words.end[at:upto] - low
        out[at:upto] = mix((run[e] - run[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = upto
    return out


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash for each run of ``length`` consecutive words; runs over a text's end are the caller's to drop."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, np.uint64)
    power, inverse = _powers_of(_WORD_BASE, n)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * power, out=run[1:])
    return mix((run[length:] - run[: n - length + 1]) * inverse[: n - length + 1])
