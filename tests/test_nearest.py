"""Nearest rows by blocks, against all products."""

from __future__ import annotations

import numpy as np
import pytest

from tessitura.operators import vectors as V
from tessitura.plans import registry, registry_updates  # noqa: F401  the second adds its queries
from tessitura.plans.bind import BIND, Catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("on", [None, ["cluster_id"]])
@pytest.mark.parametrize("block", [1 << 14, 7])
def test_nearest_equals_all_products(spark, on, block):
    rnd = np.random.default_rng(5)
    v = rnd.normal(size=(60, 5))
    v[30:40] = v[3]  # equal scores: the smaller id first
    v /= np.linalg.norm(v, axis=1)[:, None]
    cluster = [k % 3 for k in range(60)]
    corpus = spark.createDataFrame([(k, cluster[k], v[k].tolist()) for k in range(60)], "track_id long, cluster_id int, vector array<double>")
    queries = corpus.filter("track_id % 4 = 0").selectExpr("track_id AS query_id", "cluster_id", "vector AS query")
    got = {}
    for r in V.nearest(queries if on else queries.drop("cluster_id"), corpus, 6, on, block).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["track_id"], r["score"]
    for q in range(0, 60, 4):
        want = sorted((-round(float(v[k] @ v[q]), 9), k) for k in range(60) if not on or cluster[k] == cluster[q])[:6]
        assert [(got[q][i + 1][0]) for i in range(6)] == [k for _, k in want]
        assert all(abs(got[q][i + 1][1] + s) < 1e-8 for i, (s, _) in enumerate(want))
    assert len(got) == 15


def test_only_the_best_leave_a_cell(spark):
    corpus = spark.createDataFrame([(k, [float(np.cos(k)), float(np.sin(k))]) for k in range(200)], "track_id long, vector array<double>")
    queries = corpus.selectExpr("track_id AS query_id", "vector AS query")
    plan = V.nearest(queries, corpus, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapGroupsInArrow" in plan.split("Window")[-1]


@pytest.mark.parametrize("block", [1 << 14, 7])
def test_nearest_without_some_pairs(spark, block):
    rnd = np.random.default_rng(6)
    v = rnd.normal(size=(60, 5))
    v /= np.linalg.norm(v, axis=1)[:, None]
    corpus = spark.createDataFrame([(k, k % 3, v[k].tolist()) for k in range(60)], "track_id long, cluster_id int, vector array<double>")
    queries = corpus.filter("track_id < 6").selectExpr("track_id % 2 AS query_id", "cluster_id", "vector AS query")  # an id under several keys
    out = [(q, k) for q in range(2) for k in range(60) if (k + q) % 4 == 0] + [(0, 999)] + [(1, k) for k in range(0, 60, 3)]  # 1 keeps none of cluster 0
    rows = V.nearest(queries, corpus, 5, ["cluster_id"], block, spark.createDataFrame(out, "query_id long, track_id long")).collect()
    got = {(r["query_id"], r["cluster_id"], r["rank"]): r["track_id"] for r in rows}
    want = {}
    for t in range(6):
        free = [k for k in range(60) if k % 3 == t % 3 and (t % 2, k) not in out]
        for rank, k in enumerate(sorted(free, key=lambda k: (-round(float(v[k] @ v[t]), 9), k))[:5], 1):  # noqa: B023
            want[t % 2, t % 3, rank] = k
    assert got == want and len(want) == 25


def test_centroids_take_a_row_for_each_key_only(spark):
    rows = [(1, [1.0, 2.0]), (1, [3.0]), (2, [None, 4.0]), (2, [6.0, 8.0]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "k long, vector array<double>")
    want = [(1, [2.0, 2.0], 2), (2, [6.0, 6.0], 2)]
    for dimension in (None, 2):
        got = V.centroids(df, ["k"], dimension)
        assert sorted((r["k"], r["centroid"], r["n"]) for r in got.collect()) == want
        assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_scores_that_differ_beyond_nine_decimals_are_ties():
    scores = np.array([[0.5, 0.5 + 2e-10, 0.5 + 3e-10, 0.1, 0.5 - 3e-10], [0.1, 0.2, 0.3, 0.4, -np.inf]])
    r, c = V.best(scores, np.array([7, 9, 8, 1, 3]), 2)
    assert r.tolist() == [0, 0, 1, 1] and c.tolist() == [4, 0, 3, 2]


@pytest.mark.parametrize(("name", "kind", "k"), [("j11_knn", "audio", 10), ("j11_knn_in_cluster", "lyrics", 10), ("w06_top2_gap", "lyrics", 2)])
def test_every_vector_is_a_query(spark, name, kind, k):
    rows = Catalog(spark, SF).vectors(kind).collect()
    got = {}
    for r in registry.queries()[name](spark, SF).collect():
        got.setdefault(r["query_id"], []).append(r)
    assert got.keys() == {r["track_id"] for r in rows} and "% 20" not in registry.SQL[name].removeprefix(BIND)
    v, ids = np.array([r["vector"] for r in rows]), np.array([r["track_id"] for r in rows])
    cluster = np.array([r["cluster_id"] for r in rows])
    for q, scores in zip(rows, np.round(v @ v.T, 9), strict=True):
        some = cluster == q["cluster_id"] if "cluster" in name else np.full(len(ids), True)
        top = np.lexsort((ids[some], -scores[some]))[:k]
        mine = got[q["track_id"]]
        if name == "w06_top2_gap":
            best, second = scores[some][top]
            assert abs(mine[0]["best"] - best) < 2e-6 and abs(mine[0]["gap"] - (best - second)) < 2e-6
        else:
            assert sorted(r["track_id"] for r in mine) == sorted(ids[some][top].tolist())
