from __future__ import annotations

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from tessitura.llm import neardup, queries

from .helpers import ODD, SF, documents, texts
from .test_katz import words


def brute(rows, size, part, whole):
    """doc_id -> (set size, smallest id in its component), by all pairs."""
    sets = {}
    for d, t in rows:
        ws = words(t)
        sets[d] = {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and both and whole * both >= part * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_copies(seed, groups, size):
    """Groups of edited copies, as far from each other as their edits make them: chains through some of the group only."""
    rnd = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([30, 80, 150]))]
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.randrange(0, max(2, len(w) // 25))):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(1000)}"
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "groups", "size", "block"), [(1, 12, 6, 1024), (2, 2, 60, 8)])
def test_components_equal_all_pairs(spark, seed, groups, size, block):
    rows = near_copies(seed, groups, size)
    got = neardup.near_duplicates(documents(spark, rows), block=block).collect()
    want = brute(rows, 5, 80, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert len({c for _, c in want.values()}) < len(rows)


def test_query_equals_all_pairs(spark):
    want = brute(list(texts(spark).items()), 3, 85, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op6_minhash_neardup(spark, SF).collect()} == want


def test_odd_texts(spark):
    rows = [*ODD, (30, "a b c d e f"), (31, "A B c d  e\nf"), (None, "a b c d e f")]
    got = {r["doc_id"]: r for r in neardup.near_duplicates(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert (got[31]["component_id"], got[13]["component_id"], got[2]["n_shingles"], got[2]["kept"]) == (30, 4, 0, True)
    assert (got[None]["component_id"], got[None]["kept"]) == (None, True)
    assert neardup.near_duplicates(documents(spark, [])).count() == 0


def test_bit_estimate_is_near_the_similarity(spark):
    a = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows = []
    for k, shift in enumerate((0, 50, 200, 1000)):
        b = (np.arange(1000, dtype=np.uint64) + np.uint64(shift)) * np.uint64(0x9E3779B97F4A7C15)
        m = neardup.minima([a, b], 1024)
        s = neardup.signatures(m, 4).view(np.int64)
        rows.append((k, s[0].tolist(), s[1].tolist(), max(0.0, (1000 - shift) / (1000 + shift))))
    df = spark.createDataFrame(rows, "k long, a array<long>, b array<long>, want double")
    for r in df.select("want", neardup.estimate(df["a"], df["b"], 64, 4).alias("got")).collect():
        assert abs(r["got"] - r["want"]) < 0.06


def test_components_of_a_path(spark):
    n = 60
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(100, 102), (102, 101)], "a long, b long")
    got = defaultdict(set)
    for r in neardup.components(edges).collect():
        got[r["label"]].add(r["id"])
    assert got == {0: set(range(n + 1)), 100: {100, 101, 102}}
