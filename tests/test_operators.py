"""Properties of operators that the SQL comparison doesn't reach."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tessitura.functions import text as X
from tessitura.functions import vectors as V
from tessitura.operators import lyrics, recommend, relational, search, timing
from tessitura.plans import registry
from tessitura.plans.bind import Catalog
from tessitura.sources import pages
from tessitura.streaming import progress

SF = "/root/testdata/sf0.001"


def value(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert value(spark, V.normalized(v(3.0, 4.0))) == pytest.approx([0.6, 0.8])
    assert value(spark, V.normalized(v(0.0, 0.0))) == [0.0, 0.0]
    assert value(spark, V.finite(v(1.0, float("nan"), float("-inf")))) == [1.0, 0.0, 0.0]
    assert value(spark, V.zscore(v(3.0, 5.0), v(1.0, 5.0), v(2.0, 0.0))) == [1.0, 0.0]


def test_text(spark):
    t = lambda f, *x: value(spark, f(*map(F.lit, x)))
    assert t(X.clean_for_match, "Don't [Verse 1] STOP (live) 42, now42!") == "don't stop now42"
    assert t(X.skeleton, "Crème") == "crm"
    assert t(X.harmonic_mean, 0.0, 0.0) == 0.0
    assert t(X.decision, 0.7, 0.01, False) == "medium"
    assert t(X.decision, 0.7, 0.01, True) == "high"
    assert t(X.decision, 0.4, 0.3, False) == "reject"
    assert t(X.clean_lyrics, " [x\ny]\na b\n, c (\nd\n)\n  e\n\n\n\nf") == "a b, c (d)   e\n\nf"
    assert t(X.quoted_phrase_too_long, 'say "one two three four"') and not t(X.quoted_phrase_too_long, '"one two"')
    assert value(spark, X.merge_json(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))) == {"a": "1", "b": "3"}
    assert value(spark, X.ngrams(F.array(*map(F.lit, "abc")), 2)) == ["a b", "b c"]
    assert value(spark, X.ngrams(F.array(F.lit("a")), 2)) == []


def test_pages(spark):
    html = "<html><head><script>x<y</script></head><body><nav>n</nav><p>One &amp; <b>two</b></p><!-- c --><p>&lt;three&gt;</p></body></html>"
    assert value(spark, pages.page_text(F.lit(html))) == "One &\ntwo\n<three>"
    assert value(spark, pages.page_text(F.lit("<p>" + "a" * 50 + "</p>"), 10)) == "a" * 10 + "…"
    block = '<div data-lyrics-container="true">Song Lyrics\nline<br/>two</div><div data-lyrics-container="true">three</div>'
    assert value(spark, pages.lyrics_blocks(F.lit(block))) == "line\ntwo\nthree"
    assert value(spark, pages.embedded_json(F.lit('so {"a": 1} it is'))) == '{"a": 1}'
    assert value(spark, pages.embedded_json(F.lit("no json"))) is None


def test_safe_filename_and_filters(spark):
    assert value(spark, relational.safe_filename(F.lit("A/B"), F.lit("c?. "))) == "A_B - c_.mp3"
    assert len(value(spark, relational.safe_filename(F.lit("é" * 200), F.lit("t")))) == 85
    rows = spark.createDataFrame([(1,), (None,), (2,)], "x long")
    assert relational.filter_not_in(rows, "x", []).count() == 3
    assert relational.filter_not_in(rows, "x", [1]).count() == 2


def test_timing_of_single_rows(spark):
    one = spark.createDataFrame([(1, 0, 5.0, 5.5)], "track_id long, n long, start double, end double")
    assert timing.gap_percentile(one).count() == 0
    assert [tuple(r) for r in timing.gap_intervals(one).collect()] == [(1, 0.0, 5.0)]


def test_recommendations_keep_their_rules(spark):
    c = Catalog(spark, SF)
    limit = 7
    sessions = c.table("customer").select(F.col("c_custkey").alias("session_id"))
    everything = recommend.recommend(c.play_history(), c.tracks(), c.vectors("audio"), c.vectors("lyrics"), limit, sessions).toPandas()
    got, rest = (everything[everything["strategy"] == x] for x in ("cluster", "popular"))
    assert not set(got["session_id"]) & set(rest["session_id"]) and len(set(everything["session_id"])) == sessions.count()
    assert (rest.groupby("session_id").size() <= limit).all() and not rest.duplicated(["session_id", "track_id"]).any()
    history, tracks = c.play_history().toPandas(), c.tracks().toPandas().set_index("track_id")
    assert len(got)
    for session, mine in got.groupby("session_id"):
        played = set(history[history["session_id"] == session]["track_id"])
        artists = {tracks["artist"].get(t) for t in played}
        assert len(mine) <= limit and mine["artist"].is_unique
        assert not artists & set(mine["artist"]) and not played & set(mine["track_id"])
        assert (tracks.loc[mine["track_id"], "status"] == "ready").all()
        assert sorted(mine["position"]) == list(range(1, len(mine) + 1))
        assert all(-1 <= s <= 1 and math.isfinite(s) for s in mine["score"])


def test_streams_equal_their_batch_twins(spark):
    stream = progress.event_stream(spark, SF).select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), "ts")
    got = progress.run(progress.inactivity(stream, late="1 seconds")).collect()
    want = {(r["job_id"], r["started"]): (r["timed_out"], r["n"]) for r in progress.inactivity(Catalog(spark, SF).progress()).collect()}
    assert got and all(want[r["job_id"], r["started"]] == (r["timed_out"], r["n"]) for r in got)


def test_nearest_has_no_shuffle_of_the_corpus_beyond_the_top(spark):
    plan = registry.queries()["j11_knn"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_hits_of_both_sides_equal_brute_force(spark):
    """Similarities, both cuts, their sum and the order, for every session and cluster over plain lists."""
    c, limit = Catalog(spark, SF), 6
    ready = {r["track_id"]: r["popularity_category"] for r in c.tracks("track_id", "status", "popularity_category").filter("status = 'ready'").collect()}
    a, l = ({r["track_id"]: (r["cluster_id"], r["vector"]) for r in c.vectors(k).collect()} for k in ("audio", "lyrics"))
    history = c.play_history().select("session_id", "track_id", "played_at").collect()
    want = {}
    for s in {r["session_id"] for r in history}:
        mine = sorted((r for r in history if r["session_id"] == s), key=lambda r: r["played_at"])
        clusters: dict = {}
        for r in mine:
            if r["track_id"] in a:
                clusters.setdefault(a[r["track_id"]][0], []).append(r["track_id"])
        firsts = sorted(clusters, key=lambda k: (min(r["played_at"] for r in mine if r["track_id"] in clusters[k]), k))
        for n, k in enumerate(firsts):
            slots = limit // len(firsts) + (n < limit % len(firsts))
            if not slots:
                continue
            unit = lambda vs: (lambda m: [x / math.sqrt(sum(y * y for y in m)) for x in m])([sum(x) / len(vs) for x in zip(*vs, strict=True)])
            qa, ql = (unit([v[t][1] for t in clusters[k]]) for v in (a, l))
            free = [t for t in ready if t in a and a[t][0] == k and t not in {r["track_id"] for r in mine}]
            sims = {t: tuple(round(sum(x * y for x, y in zip(q, v[t][1], strict=True)), 9) for q, v in ((qa, a), (ql, l))) for t in free}
            best = [set(sorted(free, key=lambda t, i=i: (-sims[t][i], t))[: 3 * slots]) for i in (0, 1)]
            score = {t: round(0.7 * sims[t][0] * (t in best[0]) + 0.3 * sims[t][1] * (t in best[1]), 9) for t in best[0] | best[1]}
            near = sorted(score, key=lambda t: (-score[t], t))[: 3 * slots]
            order = sorted(near, key=lambda t: (0 if ready[t] in ("eternal_hit", "current_hit", "artist_best") and score[t] >= 0.5 else 1, -score[t], t))
            for rank, t in enumerate(order, 1):
                want[s, n + 1, t] = (rank, round(score[t], 6))
    rows = recommend.cluster_hits(c.play_history(), c.tracks(), c.vectors("audio"), c.vectors("lyrics"), limit).collect()
    got = {(r["session_id"], r["cluster_rank"], r["track_id"]): (r["rank"], round(r["score"], 6)) for r in rows}
    assert got.keys() == want.keys()
    assert sum(got[k] != want[k] for k in got) == 0


def test_hostile_repeat_counts(spark):
    sheet = spark.createDataFrame([(1, "la (99999999999x)\nna x2 ×3"), (2, "[Chorus 99999999999999999999x]\nho")], "id long, text string")
    got = {r["id"]: r["text"] for r in lyrics.expand_repeats(sheet).collect()}
    assert got[1].count("la") == lyrics.MOST and got[2].count("ho") == lyrics.MOST


def test_sections_are_cut_in_their_row(spark):
    """Odd ends and empty sheets; before the bodies are dealt by id nothing is shuffled or sorted."""
    texts = ["[A]\nx\r\n y (2x) \n\n[B x2]\r[a]\n[C]", "no header\rat all ×2\nend (3x)\x0b", "\n[A]\n\n", "", None, "[A][B]\n[ D ]\n(x2)\n \u2028", "[x] y\nla (2 times)\x85\nlo (2x) (3x)"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = lyrics.sections(frame)
    assert not any(x in rows._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "Window", "Sort"))
    assert sorted((r["id"], r["section"], r["label"], r["count"], r["body"]) for r in rows.collect() if r["id"] < 4) == [
        (0, 1, "a", 1, "x\n y (2x)"), (0, 2, "b", 2, ""), (0, 3, "a", 1, ""), (0, 4, "c", 1, ""), (1, 0, None, 1, "no header\nat all ×2\nend (3x)"), (2, 0, None, 1, ""), (2, 1, "a", 1, ""), (3, 0, None, 1, ""),
    ]
    got = {r["id"]: r["text"] for r in lyrics.expand_repeats(frame).collect()}
    assert got == {0: "x\n y\n y\n\nx\n y\n y", 1: "no header\nat all\nat all\nend\nend\nend", 2: "", 3: "", 4: "", 5: "[A][B]\n\n\u2028\n\u2028", 6: "[x] y\nla\x85\nla\x85\nlo (2x)\nlo (2x)\nlo (2x)"}


def test_cascade_reads_each_stage_once(spark):
    """Whatever is null or repeated: a request has the rows of the first stage that doesn't reject it."""
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "x" * 20), (4, None), (5, "e"), (None, " y ")], "id long, text string")
    kind = "request_id long, candidate_id long, decision string"
    one = spark.createDataFrame([(1, 10, "high"), (1, 11, "medium"), (2, 12, "reject"), (5, None, "high"), (None, 9, "high"), (4, 8, None)], kind)
    two = spark.createDataFrame([(1, 20, "high"), (2, 21, "medium"), (2, 22, "high"), (5, 23, "high"), (7, 24, "high")], kind)
    out = search.cascade(asked, one, two)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([
        (1, 10, "high", "stage_1"), (1, 11, "medium", "stage_1"), (2, 21, "medium", "stage_2"), (2, 22, "high", "stage_2"), (3, None, "low", "asr_fallback"),
        (4, None, "none", "not_found"), (5, None, "high", "stage_1"), (None, None, "none", "not_found"),
    ], key=str)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_missing_side_documents_are_empty(spark, tmp_path):
    assert [x.count() for x in pages.catalog_json(spark, f"file://{tmp_path}/none.json")] == [0, 0]
    assert pages.centroids_json(spark, f"file://{tmp_path}/none.json").count() == pages.stats_json(spark, f"file://{tmp_path}/none.json").count() == 0
    (tmp_path / "s.json").write_text('{"mean": [1.0, 2.0],\n "std": [0.0, 3.0]}')
    assert [tuple(r) for r in pages.stats_json(spark, f"file://{tmp_path}/s.json").collect()] == [(0, 1.0, 1.0), (1, 2.0, 3.0)]
    (tmp_path / "c.json").write_text('{"centroids": [[1.0, 0.0],\n [0.0, 1.0]]}')
    assert [tuple(r) for r in pages.centroids_json(spark, f"file://{tmp_path}/c.json").collect()] == [(0, [1.0, 0.0]), (1, [0.0, 1.0])]


def test_json_in_prose(spark):
    for text, want in (('here {"a":{"b":1}} end', '{"a":{"b":1}}'), ('x {"s": "}{\\" ["} y } z', '{"s": "}{\\" ["}'), ('[{"a":[{"b":1}]}] (2 items)', '[{"a":[{"b":1}]}]'), ("{ never", None), ("", None)):
        assert value(spark, pages.embedded_json(F.lit(text))) == want, text
