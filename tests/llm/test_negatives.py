"""Hard negatives against brute force over whole numbers; bounds of the vertical scan; odd rows, ties, repeats, hot labels."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.llm import negatives, queries

from .helpers import SF

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def table(spark, rows):
    clashing = {c: F.lit("x") for c in ("id", "block", "row", "i", "j", "k", "payload", "anchors", "score", "vector")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(clashing)


def mine(df, **more):
    return negatives.hard_negatives(negatives.usable(df, F.col("vec_id"), F.col("label"), F.col("embedding")), **more)


def brute(rows, every=50, scale=256):
    sound = [(i, [math.floor(scale * float(np.float32(x))) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, a, y) in enumerate(sound):
        if i is None or i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(a, v, strict=False)), j is None, j or 0, j, z) for m, (j, v, z) in enumerate(sound) if m != n)
        for s, _, _, j, _ in [x for x in scored if x[4] == y][:5]:
            fit = [x for x in scored if x[4] != y and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(i, j, k, x[3], -s, -x[0]) for k, x in enumerate(fit[:3], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("block", "anchors"), [(8192, 1024), (37, 2), (5, 1)])
def test_equals_brute_force_with_any_grid(spark, block, anchors):
    rnd = random.Random(block)
    rows = [(k * 5, [rnd.gauss(0, 0.3) for _ in range(12)], rnd.choice([0, 0, 0, 1, 2])) for k in range(160)]
    rows += [(1000, rows[0][1], 0)] * 3 + [(7, rows[0][1], 1), (8, rows[0][1], 1), (9, [0.5 * x for x in rows[0][1]], 2), (None, [0.6 * x for x in rows[10][1]], 2)]
    assert got(mine(table(spark, rows).repartition(3), block=block, anchors=anchors)) == brute(rows)


def test_odd_rows(spark):
    rows = [(50, [1.0, 2.0], 1), (51, [1.0, 2.0], 1), (52, [0.9, 1.0], 2), (53, [1.0], 2), (54, [], 2), (55, None, 2), (56, [None, 1.0], 2), (57, [float("nan"), 1.0], 2), (58, [float("inf"), 1.0], 2), (59, [1.0, 1.0], None)]
    rows += [(60, [0.9, 1.0, 9.0], 3), (100, [-1.0, 0.0], 1), (150, [0.0, 0.0], 4), (151, [0.0, 0.0], 4), (200, [1.0], 99), (None, [0.9, 1.0], 2)]
    assert got(mine(table(spark, rows))) == brute(rows)
    assert mine(table(spark, [])).count() == 0
    assert mine(table(spark, [(50, [1.0], 1)])).count() == 0


def test_large_components_and_one_label_for_nearly_all(spark):
    rnd = random.Random(3)
    rows = [(k, [rnd.choice([-9000.0, 9000.0, 1e-3, 0.0]) for _ in range(40)], int(k % 97 == 0)) for k in range(300)]
    assert got(mine(table(spark, rows), block=64)) == brute(rows)
    assert mine(table(spark, [(50, [1e30], 1), (51, [1e30], 1), (52, [-1e30], 2)])).count() == 0


def test_bounds_hold_and_candidates_shrink():
    rnd = np.random.default_rng(1)
    values = (rnd.standard_normal((3000, 64)) * 30).astype(np.int32)
    payload = negatives.packed(np.array([3000]), np.arange(3000), np.zeros(3000, np.uint8), np.zeros(3000, np.int64), values.T.ravel(), values.min(0), values.max(0))
    x = negatives.Block(1, payload)
    q = values[7]
    exact, left = values @ q, []

    def may_count(lower, upper):
        left.append(len(lower))
        assert len(left) > 1 or ((lower <= exact) & (exact <= upper)).all()
        return upper >= np.partition(lower, len(lower) - 5)[-5]

    at, score = negatives.vertical_scan(q, x, np.ones(3000, bool), may_count)
    assert (score == exact[at]).all() and set(np.argsort(-exact)[:5]) <= set(at.tolist())
    assert left[-1] < 100 and left == sorted(left, reverse=True)


def test_query_takes_moved_labels(spark):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got(queries.op11_hard_negatives(spark, SF)) == brute(rows)
