"""Ratios of many words at a time, the grid of cells, and the whole match over the given tables, against one pair at a time."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.functions.similarity import ratio
from tessitura.operators import textmatch as M
from tessitura.operators import wordmatch as W
from tessitura.plans import registry, registry_text
from tessitura.plans.bind import Catalog

from .test_match_words import cleaned, plain

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("band", [0, 2, 5])
@pytest.mark.parametrize("least", [0.0, 60.0])
def test_best_ratios_equal_one_at_a_time(monkeypatch, band, least):
    rnd = random.Random(band)
    monkeypatch.setattr(W, "SLICE", 50)
    make = lambda: "".join(rnd.choice("aabcdé漢\U0001f600") for _ in range(rnd.choice([1, 2, 5, 6, 7, 8, 62, 63, 64, 70])))
    words, others, letters = [make() for _ in range(60)], [make() for _ in range(40)], {}
    a, b = W.Words(words, letters), W.Words(others, letters)
    x, y = np.array(rnd.sample(range(60), 45)), np.array(rnd.sample(range(40), 30))
    got = W.best_ratios(a, x, b, y, len(letters), band, least)
    for k, g in zip(x.tolist(), got.tolist(), strict=True):
        near = [ratio(words[k], others[j]) for j in y.tolist() if abs(len(others[j]) - len(words[k])) <= band]
        best = max(near, default=-1)
        assert math.isclose(g, best if best >= least or not near else 0.0), words[k]
    assert len(W.best_ratios(a, x[:0], b, y, len(letters), band, least)) == 0
    assert (W.best_ratios(a, x, b, y[:0], len(letters), band, least) == -1).all()


@pytest.mark.parametrize("block", [1, 3, 256])
def test_cells_of_any_size_give_the_same(spark, block):
    rnd = random.Random(4)
    texts = {k: [rnd.choice("lane line lines alone stone stones tone ten net tin".split()) for _ in range(rnd.randrange(1, 9))] for k in range(14)}
    words = spark.createDataFrame([(k, w, ws.count(w)) for k, ws in texts.items() for w in sorted(set(ws))], "id long, word string, count long")
    full = words.withColumns({"lemma": F.col("word"), "skeleton": F.lit(""), "phonetic": F.substring("word", 1, 3)})
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts if (a + b) % 3], "a long, b long")
    level = lambda w, o: 3 if w in o else 2 if any(x[:3] == w[:3] for x in o) else max([2 if (r := ratio(w, x)) >= 80 else 1 if r >= 60 else 0 for x in o if abs(len(x) - len(w)) <= 2], default=0)
    got = {(r["a"], r["b"]): (r["coverage"], r["rate"]) for r in W.word_scores(pairs, full, full, block=block).collect()}
    assert len(got) == pairs.count()
    for (a, b), (coverage, rate) in got.items():
        s = [level(w, texts[b]) for w in texts[a]]
        assert math.isclose(coverage, sum(x >= 2 for x in s) / len(s)) and math.isclose(rate, sum(s) / (3 * len(s)))
    lost = {(r["a"], r["b"]): (r["words"], r["occurrences"], r["found"]) for r in W.lacking_words(pairs, full, full, block=block).collect()}
    want = {}
    for a, b in got:
        gone = set(texts[a]) - set(texts[b])
        if gone:
            want[a, b] = len(gone), sum(texts[a].count(w) for w in gone), sum(any(x[:3] == w[:3] for x in texts[b]) for w in gone)
    assert lost == want
    best = {(r["a"], r["b"], r["word"]): r["best"] for r in W.fuzzy_words(pairs, words.select("id", "word"), words.select("id", "word"), block=block).collect()}
    assert best.keys() == {(a, b, w) for a, b in got for w in texts[a] if any(abs(len(x) - len(w)) <= 2 for x in texts[b])}
    assert all(math.isclose(v, max(ratio(w, x) for x in texts[b] if abs(len(x) - len(w)) <= 2)) for (a, b, w), v in best.items())


def test_no_pairs(spark):
    none = spark.createDataFrame([], "a long, b long")
    words = spark.createDataFrame([(1, "x")], "id long, word string")
    assert W.fuzzy_words(none, words, words).count() == 0


def test_the_match_query_equals_the_rules_on_the_given_tables(spark):
    """Every score of the requests of the smallest tables, pair by pair."""
    c = Catalog(spark, SF)
    texts = {r["id"]: cleaned(r["text"] or "") for r in registry_text.candidates(c).collect()}
    pairs = [(r["request_id"], r["candidate_id"]) for r in registry_text.pairs(c).collect()]
    pool = {a: [b for x, b in pairs if x == a] for a, _ in pairs}
    scores = {(r["request_id"], r["candidate_id"]): r["score"] for r in M.match_words(registry_text.pairs(c), registry_text.requests(c), registry_text.candidates(c)).collect()}
    assert scores.keys() == set(pairs) and pairs
    for a in sorted(pool)[:8]:
        for b in pool[a][:3]:
            assert math.isclose(scores[a, b], plain(texts[a], texts[b], [texts[x] for x in pool[a]]), abs_tol=1e-8), (a, b)
    best = {r["request_id"] for r in registry.queries()["q07_match_words"](spark, SF).collect()}
    assert best == set(pool)
