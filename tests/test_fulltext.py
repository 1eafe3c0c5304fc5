"""A stored index: many searches, new batches, status, pages, and the partitions that a search reads."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tessitura.operators import fulltext as FT
from tessitura.sources.shared import shared_dir

COLUMNS = "track_id long, status string, artist string, title string, lyrics_text string"


def cut(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def plain(tracks, q, status="ready"):
    words, out = set(cut(q)), []
    for i, s, *fields in tracks:
        if s == status and words:
            weight = {w: sum(x * cut(f).count(w) for x, f in zip((1.0, 0.4, 0.1), fields, strict=True)) for w in words}
            if all(weight.values()):
                out.append((round(sum(weight.values()), 6), i))
    return [(i, s) for s, i in sorted(out, key=lambda x: (-x[0], x[1]))]


def test_searches_equal_plain_ones(spark):
    rnd = random.Random(1)
    words = "don't stop the music a b c d e night Léa 1999 x_y".split()
    text = lambda n: None if rnd.random() < 0.05 else " ".join(rnd.choice(words) for _ in range(rnd.randrange(n)))
    tracks = [(k * 7 - 300, rnd.choice(["ready", "ready", "processing"]), text(3), text(5), text(40)) for k in range(400)]
    tracks.append((10**9, "ready", "Don't", "Don't Stop", None))
    frame = spark.createDataFrame(tracks, COLUMNS)
    index = FT.Index(spark, shared_dir(spark), 64)
    for part in ("track_id < 0", "track_id >= 0 AND track_id % 2 = 0", "track_id > 0 AND track_id % 2 = 1"):
        index.add(frame.filter(part))
    asked = ["don't", "Don't Stop", "stop", "STOP the the", "a b c", "léa", "nowhere", "", "?!", "night 1999", "x y"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, q string")
    want = {k: plain(tracks, q) for k, q in enumerate(asked)}
    got = {k: [] for k in want}
    for r in index.matches(queries).orderBy("query_id", F.desc("score"), "track_id").collect():
        got[r["query_id"]].append((r["track_id"], r["score"]))
    assert got == want and (10**9, 1.5 * 2 + 0.3) not in got[0]
    assert (10**9) in [i for i, _ in got[1]]
    for limit, offset in ((5, 0), (3, 4), (1, 0), (1000, 2)):
        page = {k: [] for k in want}
        for r in index.top(queries, limit, offset).orderBy("query_id", "rank").collect():
            page[r["query_id"]].append((r["track_id"], r["score"]))
        assert page == {k: v[offset : offset + limit] for k, v in want.items()}
    assert [r["track_id"] for r in index.matches(queries.filter("query_id = 2"), "processing").orderBy(F.desc("score"), "track_id").collect()] == [i for i, _ in plain(tracks, "stop", "processing")]


def test_a_search_reads_its_partitions_only(spark):
    rows = [(k, "ready", f"artist{k}", f"title{k}", f"word{k} common") for k in range(300)]
    index = FT.Index(spark, shared_dir(spark)).add(spark.createDataFrame(rows, COLUMNS))
    queries = spark.createDataFrame([(1, "word7 common")], "query_id long, q string")
    _, lists = index.asked(queries, "ready")
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*status[^]]*bucket[^]]*\]", plan.replace("\n", " "))
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(lists) <= 2 < files(index.lists())


def test_ranges_below_a_page_are_not_opened(spark):
    """Only one range has a heavy match: the others stay closed."""
    rows = [(k, "ready", "x x x x" if k < 3 else "", "x" if k >= 3 else "", "") for k in range(0, 3000)]
    index = FT.Index(spark, shared_dir(spark), 100).add(spark.createDataFrame(rows, COLUMNS))
    queries = spark.createDataFrame([(1, "x")], "query_id long, q string")
    opened = []
    hits = index._hits
    index._hits = lambda ranges, lists: opened.append(ranges.count()) or hits(ranges, lists)
    assert [(r["track_id"], r["score"]) for r in index.top(queries, 3).orderBy("rank").collect()] == [(0, 4.0), (1, 4.0), (2, 4.0)]
    assert opened == [1, 1]


def test_any_status_is_searched_where_none_is_named(spark):
    rows = [(k, ("ready", "processing", "error")[k % 3], "the brand", None, "x") for k in range(9)]
    index = FT.Index(spark, shared_dir(spark), 4).add(spark.createDataFrame(rows, COLUMNS))
    queries = spark.createDataFrame([(1, "Brand the")], "query_id long, q string")
    assert sorted(r["track_id"] for r in index.matches(queries, None).collect()) == list(range(9))
    assert [r["track_id"] for r in index.top(queries, 4, 2, None).orderBy("rank").collect()] == [2, 3, 4, 5]


def test_lists_are_moved_once_for_all_queries(spark):
    """No join makes a row of a list for each query: lists and queries meet in their range."""
    rows = [(k, "ready", f"artist{k % 5}", "x", "") for k in range(40)]
    index = FT.Index(spark, shared_dir(spark), 16).add(spark.createDataFrame(rows, COLUMNS))
    queries = spark.createDataFrame([(k, f"x artist{k % 2}") for k in range(30)], "query_id long, q string")
    seen = []
    hits = index._hits
    index._hits = lambda ranges, lists: seen.append((ranges.select("query_id").distinct().count(), lists.count())) or hits(ranges, lists)
    assert len(index.top(queries, 3).collect()) == 90
    assert {q for q, _ in seen} == {2} and all(n == 9 for _, n in seen)
