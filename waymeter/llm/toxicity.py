"""Toxicity as severity grades, by cumulative-link ordinal regression.

A text's features are its distinct words and word beginnings (letters only, A-Z lower-cased), as
hashes. One weight per feature is shared by all grades; ordered thresholds part the score into grades 0 to 3:
P(grade <= k) = logistic(threshold_k - score). The result is the expected grade.

Labels tell toxic from not toxic only. Grade 0 is not toxic; toxic texts of the training sample are
graded 1 to 3 by thirds of how many features they hold that tell of toxicity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymeter.llm.words import blocks, split, word_hashes

SAMPLE = 2000  # labelled texts of each class that the model is fitted on, at most
HELD_OUT = 0.2  # of them only help to set the cutoff
FEATURES = 4096  # features with a weight, at most
SURE = 5.0  # standard errors by which a feature's split between the classes must differ from chance
BEGINNING = 4  # bytes of a word's beginning
GRADES = 4
STEPS, RATE, DECAY = 300, 0.1, 5e-3
_APART = np.ones(256, bool)
_APART[65:91] = _APART[97:123] = _APART[128:] = False


class Model(NamedTuple):
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades
    cutoff: float  # expected severity from which a text counts as toxic


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``row, hash`` of every word and every word's beginning, with repetitions."""
    words = split(texts, lower=True, apart=_APART)
    heads = words._replace(end=np.minimum(words.end, words.start + BEGINNING))
    # Beginnings are told from whole words by the last bit.
    whole, head = word_hashes(words) | np.uint64(1), word_hashes(heads) & ~np.uint64(1)
    return np.concatenate([words.row, words.row]), np.concatenate([whole, head])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in blocks(batch.column("text")):
            row, hashes = features(texts)
            each = [np.unique(hashes[row == i]).tobytes() for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(at, len(texts)), batch.column("toxic").slice(at, len(texts)), pa.array(each, pa.binary())], ["id", "toxic", "features"]
            )


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _beyond(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > k) in column k, with certainty before the first and none behind the last."""
    inner = _logistic(score[:, None] - thresholds)
    return np.hstack([np.ones((len(score), 1)), inner, np.zeros((len(score), 1))])


def _scores(rows: np.ndarray, columns: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights[columns], n) if len(rows) else np.zeros(n)


def fit(texts: list[np.ndarray], toxic: np.ndarray, seed: int = 3) -> Model | None:
    """The model of a sample given as distinct feature hashes; None unless both classes are there and some feature tells them apart."""
    if len(set(toxic.tolist())) < 2:
        return None
    train = np.random.default_rng(seed).random(len(texts)) >= HELD_OUT
    if len(set(toxic[train].tolist())) < 2:
        train[:] = True
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    names, column = np.unique(np.concatenate(texts), return_inverse=True)
    here = train[row]
    seen = [np.bincount(column[here & (toxic[row] == c)], minlength=len(names)) for c in (0, 1)]
    sizes = [max(1, int((toxic[train] == c).sum())) for c in (0, 1)]
    odds = np.log((seen[1] + 0.5) / (sizes[1] + 1)) - np.log((seen[0] + 0.5) / (sizes[0] + 1))
    # How far a feature's split between the classes is from chance: the root of its likelihood ratio.
    split_by = [seen[c] * np.log(np.maximum(seen[c], 1e-9) * sum(sizes) / (np.maximum(seen[0] + seen[1], 1) * sizes[c])) for c in (0, 1)]
    surprise = np.sqrt(np.maximum(0, 2 * (split_by[0] + split_by[1])))
    likely = np.argsort(-surprise, kind="stable")[:FEATURES]
    chosen = np.sort(likely[surprise[likely] >= SURE])
    if not len(chosen):
        return None
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[column] >= 0
    row, column, odds = row[keep], place[column[keep]], odds[chosen]

    telling = np.bincount(row, odds[column] > 2, len(texts))
    thirds = np.quantile(telling[train & (toxic == 1)], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + np.searchsorted(thirds, telling), 0)

    on = train[row]
    index = np.cumsum(train) - 1
    r, c, y, n = index[row[on]], column[on], grade[train], int(train.sum())
    # Weights, the first threshold and the logarithms of the gaps, by Adam on the whole sample.
    params = np.concatenate([np.zeros(len(chosen)), [1.0], np.zeros(GRADES - 2)])
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        weights, gaps = params[: len(chosen)], np.exp(params[len(chosen) + 1 :])
        thresholds = params[len(chosen)] + np.concatenate([[0], np.cumsum(gaps)])
        beyond = _beyond(_scores(r, c, weights, n), thresholds)
        low, high = beyond[np.arange(n), y], beyond[np.arange(n), y + 1]
        chance = np.maximum(low - high, 1e-12)
        by_low, by_high = low * (1 - low) / chance, high * (1 - high) / chance
        by_score = (by_high - by_low) / n
        by_threshold = np.array([(by_low[y == k + 1].sum() - by_high[y == k].sum()) / n for k in range(GRADES - 1)])
        by_gap = np.cumsum(by_threshold[::-1])[::-1]
        grad = np.concatenate([np.bincount(c, by_score[r], len(chosen)) + DECAY * weights, by_gap[:1], by_gap[1:] * gaps])
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        params = params - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    weights, gaps = params[: len(chosen)], np.exp(params[len(chosen) + 1 :])
    thresholds = params[len(chosen)] + np.concatenate([[0], np.cumsum(gaps)])

    # The cutoff halves the widest gap that the whole sample leaves with the fewest errors.
    severity = _beyond(_scores(row, column, weights, len(texts)), thresholds)[:, 1:-1].sum(1)
    order = np.argsort(severity, kind="stable")
    values, bad = severity[order], toxic[order]
    errors = np.concatenate([[0], np.cumsum(bad)]) + np.concatenate([np.cumsum((1 - bad)[::-1])[::-1], [0]])
    edges = np.concatenate([[0.0], values, [GRADES - 1.0]])
    gaps = np.diff(edges)
    gaps = np.where(errors == errors[gaps > 0].min(), gaps, -1)  # equal scores can't be parted
    cutoff = float(edges[gaps.argmax() : gaps.argmax() + 2].mean())
    return Model(names[chosen], weights, thresholds, cutoff)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """Fits on up to ``sample`` labelled texts of each class, those with the smallest hashes of their ids.

    Only ids are ordered, and no more than twice ``sample`` ids are broadcast and texts' features collected. Several
    labels of one id count as its largest; null ids and labels are left out.
    """
    known = labels.where(F.col(toxic_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(toxic_col).cast("int").alias("toxic"))
    parts = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(sample) for c in (0, 1)]
    picked = F.broadcast(parts[0].union(parts[1]))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(picked, "id").select("id", "toxic", "text")
    got = rows.mapInArrow(_distinct, "id long, toxic int, features binary").toArrow()
    # The order of collected rows may differ from run to run; the fit must not.
    held = [np.frombuffer(x.as_buffer(), np.uint64) for x in got["features"]]
    keys = [(i, t, hashlib.md5(f).digest()) for i, t, f in zip(got["id"].to_pylist(), got["toxic"].to_pylist(), held)]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    return fit([held[i] for i in order], np.array([keys[i][1] for i in order], int))


def _judge(model: Model | None, texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Expected severity, likeliest grade, chance of any toxicity, and whether it is toxic, for each text."""
    n = len(texts)
    if model is None:
        return np.zeros(n), np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
    row, hashes = features(texts)
    where = np.minimum(np.searchsorted(model.features, hashes), len(model.features) - 1)
    hit = model.features[where] == hashes
    held = np.unique(row[hit] * len(model.features) + where[hit])
    beyond = _beyond(_scores(held // len(model.features), held % len(model.features), model.weights, n), model.thresholds)
    severity = beyond[:, 1:-1].sum(1)
    return severity, (beyond[:, :-1] - beyond[:, 1:]).argmax(1), beyond[:, 1], severity >= model.cutoff


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in blocks(batch.column("text")):
                severity, grade, chance, toxic = _judge(model, texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, len(texts)), pa.array(severity), pa.array(grade, pa.int32()), pa.array(chance), pa.array(toxic)],
                    ["id", "expected_severity", "grade", "p_toxic", "toxic"],
                )

    return run


def _passed(model: Model | None, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in blocks(batch.column(text_col)):
                yield batch.slice(at, len(texts)).filter(pa.array(~_judge(model, texts)[3]))

    return run


def grade(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, expected_severity, grade, p_toxic, toxic, kept`` for each row, without a shuffle.

    Whole texts are read; a null or empty text has no features. Without a model (no labels, or of one class only) every
    row has severity 0 and is kept. The model is a few thousand weights, whatever the size of the data.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_score(model), "id long, expected_severity double, grade int, p_toxic double, toxic boolean")
    return out.withColumn("kept", ~F.col("toxic")).withColumnRenamed("id", id_col)


def without_toxic(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows that :func:`grade` keeps, with all their columns and in their partitions."""
    return df.mapInArrow(_passed(model, text_col), df.schema)
