"""Pairs and their measures from cells of any size, against one pair at a time."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessitura.operators import paircells
from tessitura.operators import textmatch as M
from tessitura.operators.wordmatch import lacking_words

PLAIN = ("coverage_request", "coverage_candidate", "ngram", "length")


def runs(w, n):
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def corpus():
    rnd = random.Random(3)
    stock = [f"s{k}" for k in range(9)]
    texts = {}
    for k in range(40):
        own = [f"w{rnd.randrange(30)}" for _ in range(rnd.randrange(3, 25))]
        at = rnd.randrange(len(own))
        texts[k] = " ".join(own[:at] + (stock if k % 3 else []) + own[at:])
    texts |= {40: texts[1], 45: texts[1].upper(), 50: texts[10], 55: "one two three four five six", 60: "one two three four five six", 65: "a b c d e", 70: "a b a b a b a b a b", 75: "", 80: None}
    return texts


def expected(asked, texts, least=3):
    w = {k: (t or "").lower().split() for k, t in texts.items()}
    pairs = [(a, b) for a in asked for b in texts if a != b and len(runs(w[a], 4) & runs(w[b], 4)) >= least]
    raw, out = {}, {}
    for a, b in pairs:
        pool = Counter(g for x, y in pairs if x == a for g in runs(w[y], 5))
        raw[a, b] = sum(1 / pool[g] for g in runs(w[a], 5) & runs(w[b], 5)) / max(len(runs(w[b], 5)), 1)
    for a, b in pairs:
        both, shared = set(w[a]) & set(w[b]), runs(w[a], 4) & runs(w[b], 4)
        most = max(r for (x, _), r in raw.items() if x == a)
        out[a, b] = {
            "shared": len(shared), "coverage_request": len(both) / len(set(w[a])), "coverage_candidate": len(both) / len(set(w[b])), "ngram": len(shared) / len(runs(w[a], 4) | runs(w[b], 4)),
            "length": min(1.0, abs(math.log(len(w[b]) / len(w[a])))), "anchor": raw[a, b] / most if most > 0 else 0.0,
        }
    return out


@pytest.mark.parametrize("block,places", [(None, 1 << 22), (7, 5)])
def test_pairs_of_cells_equal_one_at_a_time(spark, monkeypatch, block, places):
    for name in ("COUNTERS", "PLACES", "ROWS"):
        monkeypatch.setattr(paircells, name, places)
    texts = corpus()
    frame = spark.createDataFrame(list(texts.items()), "id long, text string")
    some = frame.filter("id % 5 = 0")
    want = expected([k for k in texts if k % 5 == 0], texts)
    assert len(want) > 100
    for got, names in ((M.whole_pairs(some, frame, block=block), ("shared",)), (M.whole_measures(some, frame, block=block), PLAIN), (M.whole_anchors(some, frame, block=block), ("anchor",))):
        rows = got.collect()
        assert sorted((r["request_id"], r["candidate_id"]) for r in rows) == sorted(want)
        for r in rows:
            for c in names:
                assert math.isclose(r[c], want[r["request_id"], r["candidate_id"]][c], abs_tol=1e-9), (c, r)
    best = {r["request_id"]: (r["candidate_id"], r["score"], r["gap"]) for r in M.top_two(M.whole_best(some, frame, block=block)).collect()}
    pairs = spark.createDataFrame(list(want), "request_id long, candidate_id long")
    plain = {r["request_id"]: (r["candidate_id"], r["score"], r["gap"]) for r in M.top_two(M.scored(pairs, some, frame)).collect()}
    assert best.keys() == plain.keys()
    for a in best:
        assert best[a][0] == plain[a][0] and math.isclose(best[a][1], plain[a][1], abs_tol=2e-9) and (best[a][2] is None) == (plain[a][2] is None)


def test_no_row_is_a_pair_before_the_result(spark):
    """300 texts with one stock phrase: the plan's only rows below the cells are classes, blocks and n-grams."""
    texts = [(k, f"a{k} b{k} the same stock phrase of more than eight words here c{k}") for k in range(300)]
    frame = spark.createDataFrame(texts, "id long, text string")
    got = M.whole_pairs(frame, frame)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 300 * 299
    assert plan.index("InArrow") < min([plan.index(x) for x in ("Join", "Aggregate") if x in plan], default=len(plan))
    assert "request_class" not in plan and "Join Inner, (gram" not in plan


@pytest.mark.parametrize("block,places", [(None, 1 << 22), (7, 5)])
def test_lacking_words_of_cells_equal_those_of_given_pairs(spark, monkeypatch, block, places):
    for name in ("COUNTERS", "PLACES", "ROWS"):
        monkeypatch.setattr(paircells, name, places)
    rnd = random.Random(6)
    texts = {k: " ".join([rnd.choice("lane line lines alone stone stones tone ten net tin 12 漢字".split()) for _ in range(rnd.randrange(12))] + [*"the same stock phrase here now".split()][: rnd.choice([5, 6, 6])]) for k in range(30)}
    frame = spark.createDataFrame(list(texts.items()), "id long, text string")
    some = frame.filter("id % 3 = 0")
    pairs = spark.createDataFrame([p for p in expected([k for k in texts if k % 3 == 0], texts)], "a long, b long")
    words = M.word_rows(frame)
    want = {(r["a"], r["b"]): (r["words"], r["occurrences"], r["found"]) for r in lacking_words(pairs, words, words).collect()}
    got = M.whole_lacking(some, frame, block=block).collect()
    assert len(got) == len(want) > 50 and {(r["request_id"], r["candidate_id"]): (r["words"], r["occurrences"], r["found"]) for r in got} == want
    assert any(f for _, _, f in want.values())


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_only_classes_that_can_be_pairs_stay(spark, monkeypatch, few):
    """However few the requests: n-grams that no request has keep no text, nor do copies among candidates alone."""
    monkeypatch.setattr(paircells, "FEW", few)
    texts = {1: "a b c d e f g", 2: "x a b c d e f g", 3: "k l m n o p q", 4: "k l m n o p q", 5: "k l m n o p q r", 6: "u v w x y z a", 7: "u v w x y z a"}
    frame = spark.createDataFrame(list(texts.items()), "id long, text string")
    grid = paircells.Grid(frame.filter("id IN (1, 6)"), frame)
    assert sorted(r["text"] for r in grid.rows.join(grid.texts.select("class", "text"), "class").collect()) == ["a b c d e f g", "u v w x y z a", "x a b c d e f g"]
    assert {(r["request_id"], r["candidate_id"], r["shared"]) for r in grid.pairs().collect()} == {(1, 2, 4), (6, 7, 4)}
    best = {(r["request_id"], r["candidate_id"], r["token"]) for r in M.whole_fuzzy(frame.filter("id IN (1, 6)"), frame).collect()}
    assert best == {(a, b, w) for a, b in ((1, 2), (6, 7)) for w in texts[a].split()}


def cell_of(rnd, lists, n_left, n_right):
    side = lambda asks, n: [{"asks": asks, "class": k, "is_held": False, "ids": [k], "n_grams": 0, "grams": (v := lists(rnd)), "grams_n": [1] * len(v)} for k in range(n)]
    return paircells.Cell(iter(pa.Table.from_pylist(side(True, n_left) + [r | {"class": 1000 + r["class"]} for r in side(False, n_right)]).to_batches()), 3)


@pytest.mark.parametrize("limit", [1 << 22, 7])
def test_sums_over_common_values_equal_one_pair_at_a_time(monkeypatch, limit):
    for name in ("COUNTERS", "PLACES"):
        monkeypatch.setattr(paircells, name, limit)
    passage = list(range(100, 150))
    cell = cell_of(random.Random(4), lambda rnd: rnd.sample(range(60), rnd.randrange(12)) + (passage if rnd.random() < 0.5 else []), 9, 14)
    left, right = cell.r["grams"].to_pylist(), cell.c["grams"].to_pylist()
    sums, (r, c) = paircells.Sums(cell, "grams"), np.divmod(np.arange(9 * 14), 14)
    assert len(sums.lists) <= 61  # the passage is one group
    weights = np.arange(sum(map(len, left))) + 0.5
    at = np.cumsum([0, *map(len, left)])
    assert sums.of(r, c).tolist() == [len(set(left[a]) & set(right[b])) for a, b in zip(r, c, strict=True)]
    want = [sum(weights[at[a] + k] for k, v in enumerate(left[a]) if v in right[b]) for a, b in zip(r, c, strict=True)]
    assert np.allclose(sums.of(r, c, weights), want)
    some = (r + c) % 3 > 0
    got = np.zeros(len(weights), np.int64)
    sums.members(r[some], c[some], got)
    assert got.tolist() == [sum(v in right[b] for b in range(14) if (a + b) % 3) for a in range(9) for v in left[a]]
    for bits in (2048, 64, 1):
        assert paircells.Common(cell, "grams", bits).of(r[some], c[some]).tolist() == sums.of(r[some], c[some]).tolist()


def test_leading_pairs_hold_each_rows_best_levels():
    r, scores = np.array([2, 2, 2, 2, 2, 5, 7, 7]), np.array([0.1, 0.9, 0.5, 0.9, 0.3, 0.2, 0.4, 0.4])
    assert paircells._leading(r, scores, 3).tolist() == [1, 2, 3, 4, 5, 6, 7]
    assert paircells._leading(r, scores, 1).tolist() == [1, 3, 5, 6, 7]
    assert not len(paircells._leading(r[:0], scores[:0], 3))


def test_ngrams_that_the_same_texts_have_are_one_value(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    texts = {1: f"a b {passage} c", 2: f"{passage} d e f", 3: f"{passage}", 4: f"x {passage} p0 p1 p2 p3 p4", 6: "p0 p1 p2 p3 p4 p5"}
    frame = spark.createDataFrame(list(texts.items()), "id long, text string")
    grid = paircells.Grid(frame.filter("id IN (1, 4)"), frame)
    rows = grid.rows.join(grid.texts.select("class", "text"), "class").collect()
    assert {r["text"]: sorted(r["grams_n"]) for r in rows} == {t: [3] if k == 6 else [3, 34] for k, t in texts.items()}
    shared = {(r["request_id"], r["candidate_id"]): r["shared"] for r in grid.pairs().collect()}
    assert shared == {(a, b): 3 if b == 6 else 37 for a in (1, 4) for b in texts if a != b}


def test_packed_rows_come_back_and_hold_each_value_once():
    big = 1 << 60
    rows = [{"block": k % 3, "class": k, "asks": k < 4, "words": None if k == 5 else [big + v for v in range(k % 4 * 500)], "names": ["a", None][: k % 3], "named": [{"id": k, "name": "n"}]} for k in range(40)]
    kind = pa.schema([("block", pa.int32()), ("class", pa.int64()), ("asks", pa.bool_()), ("words", pa.list_(pa.int64())), ("names", pa.list_(pa.string())), ("named", pa.list_(pa.struct([("id", pa.int64()), ("name", pa.string())])))])
    table = pa.Table.from_pylist(rows, kind)
    pieces = [r for b in paircells._packed(iter([*table.slice(0, 7).to_batches(), *table.slice(7).to_batches()])) for r in b.to_pylist()]
    assert [r["block"] for r in pieces] == [0, 1, 2]
    got = [r | {"block": p["block"]} for p in pieces for r in paircells._unpacked(pa.py_buffer(p["packed"])).to_pylist()]
    assert sorted(got, key=lambda r: r["class"]) == rows
    assert sum(len(r["packed"]) for r in pieces) < table["words"].nbytes / 3
