"""Byte-level BPE: texts to token ids and back, for any vocabulary file of the tokenizers library's kind.

A text is cut at special tokens, then by the vocabulary's word pattern. A word's bytes are its first
symbols. A segment tree holds the rank of every adjacent pair with its position, so that its root is
the leftmost pair of lowest rank; merging it changes three leaves, each repaired up to the root,
until no pair can be merged. Tasks remember the words they have merged, up to a fixed number.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymeter.llm.words import blocks

#: Fixed value: the public pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII letters only, where the standard library's engine will do.
ASCII_PATTERN = r" ?[A-Za-z]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
REMEMBERED = 250_000  # words of at most LONG letters that a task's process keeps, twice
LONG = 64
NONE = 1 << 62
AT = (1 << 32) - 1


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: itself if visible, else the next free one."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return [chr(b) if b in set(seen) else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """Ranks, ids and bytes of tokens, from the text of a vocabulary file."""

    def __init__(self, source: str):
        data = json.loads(source)
        kind = data["pre_tokenizer"] or {}
        plain = all(data.get(k) is None for k in ("normalizer", "post_processor", "truncation", "padding"))
        if not plain or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or data["model"]["type"] != "BPE":
            raise ValueError("a byte-level BPE vocabulary without normalizer and prefix space is expected")
        ids, letters = data["model"]["vocab"], byte_letters()
        value = {letter: b for b, letter in enumerate(letters)}
        self.bytes = {i: bytes(value[c] for c in token) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.first = [ids[letter] for letter in letters]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        #: (left id, right id) as one number: the pair's rank above 32 bits, and the merged id
        self.ranks = {ids[a] << 32 | ids[b]: (rank << 32, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.pairs, order = np.unique(np.array([*self.ranks], np.int64), return_index=True)
        self.pair_rank = order.astype(np.int64)  # ranks count the merges in their order in the file
        self.merged = np.array([new for _, new in self.ranks.values()], np.int64)
        self.first_of = np.array(self.first, np.int64)
        self.numbers = {i: str(i) for i in self.bytes}
        self.words, self.ascii = regex.compile(PATTERN), re.compile(ASCII_PATTERN, re.ASCII)
        specials = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.apart = regex.compile(f"({specials})") if specials else None
        self.known: dict[str, tuple[int, ...]] = {t: (i,) for t, i in self.special.items()}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        ids = [self.first[b] for b in word]
        n, ranks = len(ids), self.ranks
        if n < 2:
            return ids
        size = 1 << (n - 2).bit_length()
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            pair = ranks.get(ids[i] << 32 | ids[i + 1])
            if pair:
                tree[size + i] = pair[0] | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while (top := tree[1]) != NONE:
            i = top & AT
            j = after[i]
            ids[i] = ranks[ids[i] << 32 | ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            before[k] = i
            changed = [(j, None), (i, ranks.get(ids[i] << 32 | ids[k]) if k < n else None)]
            if (p := before[i]) >= 0:
                changed.append((p, ranks.get(ids[p] << 32 | ids[i])))
            for at, pair in changed:
                node = size + at
                if node >= 2 * size:  # the last symbol starts no pair
                    continue
                value = pair[0] | at if pair else NONE
                if tree[node] == value:
                    continue
                tree[node] = value
                while node > 1:
                    node >>= 1
                    a, b = tree[2 * node], tree[2 * node + 1]
                    least = a if a < b else b
                    if tree[node] == least:
                        break
                    tree[node] = least
        return [i for i in ids if i >= 0]

    def merge_many(self, words: list[bytes], size: int) -> list[list[int]]:
        """:meth:`merge` for many words of 2 to ``size + 1`` bytes at once: one tree of ``size`` leaves per row."""
        lengths = np.array([len(w) for w in words])
        inside = np.arange(size + 2) < lengths[:, None]
        ids = np.full(inside.shape, -1)
        ids[inside] = self.first_of[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(np.arange(1, size + 3), (len(words), 1))
        before = after - 2

        def value(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
            pair = left << 32 | right
            where = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            return np.where((self.pairs[where] == pair) & (right >= 0), self.pair_rank[where] * size + at, NONE)

        tree = np.full((len(words), 2 * size), NONE)
        tree[:, size:] = value(ids[:, :size], ids[:, 1 : size + 1], np.arange(size))
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        while len(rows := np.flatnonzero(tree[:, 1] != NONE)):
            rank, i = np.divmod(tree[rows, 1], size)
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i], ids[rows, j] = self.merged[rank], -1
            after[rows, i], before[rows, k] = k, i
            p = before[rows, i]
            led, ended = p >= 0, j < size
            tree[rows[ended], size + j[ended]] = NONE
            tree[rows, size + i] = value(ids[rows, i], ids[rows, k], i)
            tree[rows[led], size + p[led]] = value(ids[rows[led], p[led]], ids[rows[led], i[led]], p[led])
            rows, nodes = np.concatenate([rows[ended], rows, rows[led]]), size + np.concatenate([j[ended], i, p[led]])
            for _ in range(size.bit_length() - 1):
                nodes >>= 1
                tree[rows, nodes] = np.minimum(tree[rows, 2 * nodes], tree[rows, 2 * nodes + 1])
        flat, ends = ids[ids >= 0].tolist(), np.cumsum((ids >= 0).sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of words that were not used lately; short ones are remembered, in two generations."""
        out = {w: self.older[w] for w in words if w in self.older}
        new = [(w, w.encode()) for w in words if w not in out]
        for size in (1, 2, 4, 8, 16, 32, 64):
            fits = [(w, b) for w, b in new if size // 2 + 1 < len(b) <= size + 1]
            for at in range(0, len(fits), 4096):
                part = fits[at : at + 4096]
                out.update((w, tuple(ids)) for (w, _), ids in zip(part, self.merge_many([b for _, b in part], size)))
        out.update((w, tuple(self.merge(b))) for w, b in new if w not in out)
        if len(self.known) + len(out) > REMEMBERED:
            self.known, self.older = {t: (i,) for t, i in self.special.items()}, self.known
        self.known.update((w, ids) for w, ids in out.items() if len(w) <= LONG)
        return out

    def _cut(self, text: str) -> list[str]:
        words = (self.ascii if text.isascii() else self.words).findall
        if self.apart is None or not self.apart.search(text):
            return words(text)
        # No word is ever equal to a special token, whose signs and letters the pattern separates.
        return [w for part in self.apart.split(text) for w in ([part] if part in self.special else words(part))]

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        cut = [self._cut(t) for t in texts]
        found = [list(map(self.known.get, words)) for words in cut]
        missing = {w for words, ids in zip(cut, found) if None in ids for w, x in zip(words, ids) if x is None}
        if missing:
            learnt = self._learn(missing)
            found = [[x or learnt[w] for w, x in zip(words, ids)] if None in ids else ids for words, ids in zip(cut, found)]
        return [list(chain.from_iterable(ids)) for ids in found]

    def written(self, ids: list[int]) -> str:
        """The ids in decimal, with commas between them."""
        return ",".join(map(self.numbers.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _code(source, also: tuple[str, ...]):
    """``id, text`` batches to counts and digests, on request with the ids or the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _built(source.value)
        for batch in batches:
            for at, texts in blocks(batch.column(1)):
                coded = vocabulary.encode_many([t or "" for t in texts.to_pylist()])
                decoded = [vocabulary.decode(ids) for ids in coded]
                columns = {
                    "id": batch.column(0).slice(at, len(texts)),
                    "n": pa.array([len(ids) for ids in coded], pa.int64()),
                    "ids_sha": pa.array([hashlib.sha256(vocabulary.written(ids).encode()).hexdigest() for ids in coded]),
                    "decoded_sha": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
                }
                if "ids" in also:
                    columns["ids"] = pa.array(coded, pa.list_(pa.int32()))
                if "decoded" in also:
                    columns["decoded"] = pa.array(decoded, pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return run


_vocabularies: dict[int, Vocabulary] = {}


def _built(source: str) -> Vocabulary:
    key = hash(source)
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(source)
    return _vocabularies[key]


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` for each row, and the columns named in ``also``.

    ``vocabulary`` is the path of a vocabulary file, read on the driver and broadcast (its size does not
    depend on the data). Ids are those of the tokenizers library without added special tokens, truncation or
    padding; a special token's own text becomes its id. ``decoded`` is made from the ids again. Null texts count as
    empty and give no ids. Other columns are ignored. No shuffle: rows stay in their partitions.
    """
    with open(vocabulary, encoding="utf-8") as file:
        source = df.sparkSession.sparkContext.broadcast(file.read())
    schema = "id long, n long, ids_sha string, decoded_sha string" + ", ids array<int>" * ("ids" in also) + ", decoded string" * ("decoded" in also)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    names = {"id": id_col, "n": "n_tokens", "ids_sha": "ids_sha256", "decoded_sha": "decoded_sha256"}
    return rows.mapInArrow(_code(source, also), schema).withColumnsRenamed(names)
