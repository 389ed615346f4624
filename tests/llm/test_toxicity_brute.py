"""Toxicity features and scores against a version that compares every word with every term."""

import math
import random
import re

import numpy as np
import pytest

from meterspark.llm import toxicity
from test_llm import distance, frame, prose

TERMS = [("moron", False, 3.0), ("stupid", False, 2.5), ("worthless", False, 4.0), ("scum", False, 3.5), ("disgusting", False, 2.0), ("zorv", True, 1.5)]


def best_term(word):
    """(weight, exact) by edit distance: an exact one first, then the heaviest."""
    near = [(t in (word,) if not stem else True, w) for t, stem, w in TERMS
            if (word.startswith(t) if stem else distance(word, t) <= (len(t) >= 5) + (len(t) >= 9))]
    return (max(near)[1], max(near)[0]) if near else None


def plain_features(text):
    low = text.lower()
    tokens = list(re.finditer(r"\w+", low))
    words = [m.group() for m in tokens]
    hits = [(i, *hit) for i, hit in ((i, best_term(w)) for i, w in enumerate(words)) if hit]
    if not hits:
        return [0.0] * toxicity.FEATURES
    total = top = quoted = 0.0
    for i, weight, exact in hits:
        before = [m.start() for m in re.finditer("[\"“”«»„]", low) if m.start() < tokens[i].start()]
        after = [m.start() for m in re.finditer("[\"“”«»„]", low) if m.start() >= tokens[i].start()]
        inside = len(before) % 2 == 1 and bool(after) and tokens[i].start() - before[-1] <= 120
        told = any(w in toxicity.REPORTING for w in words[max(0, i - 5):i])
        meant = any(w in toxicity.ADDRESS for w in words[max(0, i - 10):i + 11])
        company = sum(j != i and abs(j - i) <= 10 for j, _, _ in hits)
        factor = (0.3 if inside else 1) * (0.6 if told else 1) * (1.3 if meant else 1) * (1 + 0.5 * min(3, company))
        total += weight * factor * (1 if exact else 0.6)
        top = max(top, weight * factor)
        quoted += inside
    exact = sum(h[2] for h in hits)
    return [1.0, math.log1p(exact), math.log1p(len(hits) - exact), math.log1p(total), math.log1p(top), 25.0 * len(hits) / len(words), quoted / len(hits), math.log1p(len(words)) / 8]


def mixed_texts(n):
    rng = random.Random(7)
    parts = [t for t, _, _ in TERMS] + ["mron", "stupidd", "wothles", "scun", "disgustng", "zorvxyz", "zorw", "you", "said", '"', "“", "”", "the", "of", "lamp", "chair", "Paper", "GLASS", "x.", "wrote"]
    return [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 80))) for _ in range(n)] + ["", "\"", "moron", '"moron" moron'] + [prose(i, 60) for i in range(20)]


def test_features_brute():
    lexicon = toxicity.Lexicon(TERMS)
    for text in mixed_texts(250) * 2:                       # the second time from what is remembered
        assert lexicon.features(text) == pytest.approx(plain_features(text)), text


def test_small_memory(monkeypatch):
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 3)
    monkeypatch.setattr(toxicity, "KNOWN_STATES", 5)
    lexicon = toxicity.Lexicon(TERMS)
    for text in mixed_texts(40):
        assert lexicon.features(text) == pytest.approx(plain_features(text))


def test_scores_brute(spark):
    weights = np.array([-2.0, 0.5, 0.7, 0.4, 0.9, 1.1, 0.3, -0.6, -0.2])
    texts = mixed_texts(60) + [None]
    got = toxicity.score_toxicity(frame(spark, [(i, t, "a") for i, t in enumerate(texts)]), (TERMS, weights)).collect()
    for r in got:
        want = 1 / (1 + math.exp(-(weights[0] + np.dot(weights[1:], plain_features(texts[r["doc_id"]] or "")))))
        assert r["score"] == pytest.approx(want) and r["predicted"] == int(want >= 0.7)


def test_lexicon_from_the_first_rows_by_hash(spark):
    """The bound takes labelled ids, the same ones however the table is dealt; every row of a chosen id counts."""
    rows = [(i, f"zorvak{'abcdefgh'[i % 8]} {prose(i, 8)}" if i % 2 else prose(i, 20), "a") for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id bigint, toxic int")
    monkey = toxicity.MIN_LIFT
    toxicity.MIN_LIFT = 1.5
    try:
        some = toxicity.train(frame(spark, rows), labels, train_rows=50, lexicon_rows=100)
        again = toxicity.train(frame(spark, rows[::-1]).repartition(7), labels.repartition(3), train_rows=50, lexicon_rows=100)
        every = toxicity.train(frame(spark, rows), labels, train_rows=50)
    finally:
        toxicity.MIN_LIFT = monkey
    assert some[0] == again[0] and some[0] and np.allclose(some[1], again[1]) and len(every[0]) >= len(some[0])
