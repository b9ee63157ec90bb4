"""The ordinal model against plain formulas: scores text by text, and a fit that is a minimum of its loss."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from waymeter.llm import toxicity

WORD = re.compile(rb"[A-Za-z\x80-\xff]+")


def hash_of(word, beginning):
    """A word's feature, taken alone: the word itself, or its beginning."""
    _, found = toxicity.features(pa.array([word], pa.binary()).cast(pa.string()))
    return int(found[1 if beginning else 0])


def feature_set(text):
    words = {w.lower() for w in WORD.findall((text or "").encode())}
    return {hash_of(w, False) for w in words if w.isascii()} | {hash_of(w, True) for w in words if w.isascii()}


def sample(n=400, seed=2):
    rng, bad, plain = random.Random(seed), ["vile", "scum", "trash", "hateful", "idiot"], [f"word{c}" for c in "abcdefghijkl"]
    rows = []
    for i in range(n):
        toxic = i % 2
        words = [rng.choice(plain) for _ in range(rng.randrange(3, 30))] + [rng.choice(bad) for _ in range(rng.randrange(1, 9) if toxic else rng.random() < 0.05)]
        rng.shuffle(words)
        rows.append((i, " ".join(w.upper() if rng.random() < 0.2 else w for w in words), toxic))
    return rows


@pytest.fixture(scope="module")
def fitted():
    rows = sample()
    texts = [np.array(sorted(feature_set(t)), np.uint64) for _, t, _ in rows]
    return rows, texts, toxicity.fit(texts, np.array([t for *_, t in rows]))


def test_scores_text_by_text(spark, docs, fitted):
    _, _, model = fitted
    weights = dict(zip(model.features.tolist(), model.weights.tolist()))
    rows = [(i, t) for i, t, _ in sample(60, 5)] + [(900, None), (901, ""), (902, "Vile, vile; VILE!"), (903, "clean"), (None, "scum idiot trash")]
    got = {(r.doc_id, round(r.expected_severity, 9)): r for r in toxicity.grade(docs(rows), model).collect()}
    for i, text in rows:
        score = sum(weights.get(f, 0.0) for f in feature_set(text))
        beyond = [1.0, *(1 / (1 + math.exp(t - score)) for t in model.thresholds), 0.0]
        chances = [a - b for a, b in zip(beyond, beyond[1:])]
        severity = sum(k * c for k, c in enumerate(chances))
        row = got[i, round(severity, 9)]
        assert row.p_toxic == pytest.approx(1 - chances[0]) and row.grade == max(range(4), key=chances.__getitem__) and row.toxic == (severity >= model.cutoff) != row.kept
    assert len(got) == len({(i, feature_set(t) and frozenset(feature_set(t)) or frozenset()) for i, t in rows})


def test_the_fit_is_a_minimum(monkeypatch, fitted):
    """With all texts in the training part, no direction lowers the loss, by differences of the loss itself."""
    monkeypatch.setattr(toxicity, "HELD_OUT", 0.0)
    monkeypatch.setattr(toxicity, "STEPS", 3000)
    monkeypatch.setattr(toxicity, "RATE", 0.02)
    rows, texts, _ = fitted
    toxic = np.array([t for *_, t in rows])
    model = toxicity.fit(texts, toxic)
    held = np.array([[f in set(t.tolist()) for f in model.features.tolist()] for t in texts], float)
    seen = {f: [sum(f in t for t, c in zip(map(set, (x.tolist() for x in texts)), toxic) if c == k) for k in (0, 1)] for f in model.features.tolist()}
    size = [int((toxic == k).sum()) for k in (0, 1)]
    odds = np.array([math.log((seen[f][1] + 0.5) / (size[1] + 1)) - math.log((seen[f][0] + 0.5) / (size[0] + 1)) for f in model.features.tolist()])
    telling = held @ (odds > 2)
    y = np.where(toxic == 1, 1 + np.searchsorted(np.quantile(telling[toxic == 1], [1 / 3, 2 / 3]), telling), 0)

    def loss(weights, thresholds):
        total = 0.0
        for x, k in zip(held, y):
            beyond = [1.0, *(1 / (1 + np.exp(np.clip(thresholds - x @ weights, -40, 40)))), 0.0]
            total -= math.log(max(beyond[k] - beyond[k + 1], 1e-12))
        return total / len(y) + toxicity.DECAY / 2 * float(weights @ weights)

    best, m = loss(model.weights, model.thresholds), len(model.weights)
    assert best < 0.5 * loss(np.zeros(m), np.array([-0.5, 0.5, 1.5])) and (np.diff(model.thresholds) > 0).all()
    step, slopes = 1e-4, []
    for k in range(m + 3):
        shift = np.zeros(m + 3)
        shift[k] = step
        slopes.append((loss(model.weights + shift[:m], model.thresholds + shift[m:]) - loss(model.weights - shift[:m], model.thresholds - shift[m:])) / (2 * step))
    assert max(map(abs, slopes)) < 2e-3
