"""Text, page, matching, recommendation and stream queries. Importing this module adds them to the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.similarity import nfkc
from ..functions.stems import metaphone, stem
from ..functions.vectors import normalized, weighted_concat
from ..operators import fulltext as FT
from ..operators import recommend as Q
from ..operators import relational as R
from ..operators import textmatch as M
from ..operators import vectors as V
from ..sources import pages as P
from ..sources.shared import shared_dir
from ..streaming import progress as Z
from ..streaming import sinks as S
from ..streaming import timers as T
from .bind import BIND, Catalog
from .registry import SQL, query

WS = r"list_filter(regexp_split_to_array({t}, '\s+'), lambda x: x <> '')"
GRAMS = "(SELECT DISTINCT id, array_to_string(ws[i:i + {m}], ' ') AS gram FROM (SELECT id, ws, unnest(range(1, len(ws) - {m} + 1)) AS i FROM (SELECT {id} AS id, " + WS.format(t="lower(text)") + " AS ws FROM {table})))"
D4, B4, R4 = (GRAMS.format(m=3, id=i, table=t) for i, t in (("doc_id", "documents"), ("item_id", "benchmark"), ("doc_id", "documents WHERE doc_id % 5 = 0")))
PAIRS = "(SELECT r.id AS request_id, c.id AS candidate_id, count(*) AS shared FROM {r} r JOIN {c} c USING (gram) WHERE r.id <> c.id GROUP BY ALL HAVING count(*) >= 3)"


def requests(c: Catalog) -> DataFrame:
    return candidates(c).filter("id % 5 = 0")


def candidates(c: Catalog) -> DataFrame:
    return c.table("documents").select(F.col("doc_id").alias("id"), "text")


def items(c: Catalog) -> DataFrame:
    return c.table("benchmark").select(F.col("item_id").alias("id"), "text")


def pairs(c: Catalog) -> DataFrame:
    """All pairs, however frequent their n-grams are."""
    return M.whole_pairs(requests(c), candidates(c))


query("x07_tokenize", f"SELECT doc_id, len({WS.format(t='text')}) AS n, array_to_string({WS.format(t='text')}[1:5], '|') AS head FROM documents")(
    lambda c: c.table("documents").select("doc_id", F.size(X.tokenize(F.col("text"))).cast("long").alias("n"), F.array_join(F.slice(X.tokenize(F.col("text")), 1, 5), "|").alias("head"))
)
_gone = "lower(text)"
for _p, _b in ((r"\[[^\]]*\]", " "), (r"\([^)]{1,30}\)", " "), *[(r"(^|[^\p{L}\p{N}_])\p{N}+([^\p{L}\p{N}_]|$)", r"\1 \2")] * 2, (r"[^\p{L}\p{N}_''\s]", " "), (r"\s+", " ")):
    _gone = f"regexp_replace({_gone}, '{_p}', '{_b}', 'g')"
query("x06_clean_for_match", f"SELECT doc_id, md5(trim({_gone})) AS digest FROM documents")(lambda c: c.table("documents").select("doc_id", F.md5(X.clean_for_match(F.col("text"))).alias("digest")))
# With compatibility composition before, which DuckDB lacks.
query("x06_clean_all")(lambda c: c.table("documents").select("doc_id", F.md5(X.clean_for_match(nfkc(F.col("text")))).alias("digest")))
query("x08_skeleton", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z]', '', 'g'), '[aeiouy]', '', 'g') AS skeleton FROM part")(lambda c: c.table("part").select("p_partkey", X.skeleton(F.col("p_name")).alias("skeleton")))
query("x13_harmonic_mean", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount + l_tax > 0 THEN round(2 * l_discount * l_tax / (l_discount + l_tax), 6) ELSE 0 END AS mean FROM lineitem")(
    lambda c: c.table("lineitem").select("l_orderkey", "l_linenumber", F.round(X.harmonic_mean(F.col("l_discount"), F.col("l_tax")), 6).alias("mean"))
)
query("x14_length_penalty", "SELECT p_partkey, round(least(1, abs(ln(p_size / p_retailprice * 30))), 6) AS penalty FROM part")(lambda c: c.table("part").select("p_partkey", F.round(X.length_penalty(F.col("p_size") * 30, F.col("p_retailprice")), 6).alias("penalty")))
query("x21_content_key", "SELECT sha256(text) AS key, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")(
    lambda c: c.table("documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
)
query("x30_scale_timeout", "SELECT track_id, 30 * greatest(duration_sec / 180, 0.5) AS seconds FROM tracks")(lambda c: c.tracks("track_id", "duration_sec").select("track_id", X.scaled_timeout(F.col("duration_sec"), 30.0).alias("seconds")))
query("x32_db_linear", "SELECT event_id, round(20 * log10(abs(value) + 1e-10), 6) AS db, round(value * pow(10, -3.0), 9) AS low FROM events")(
    lambda c: c.table("events").select("event_id", F.round(X.linear_to_db(F.abs("value")), 6).alias("db"), F.round(X.db_to_linear(F.lit(60), F.col("value")), 9).alias("low"))
)
query("x28_timestamps", "SELECT id, strftime(date_trunc('month', created_at), '%Y-%m-%d') AS month, strftime(created_at - INTERVAL 90 SECOND, '%Y-%m-%dT%H:%M:%S') AS before FROM jobs")(
    lambda c: c.jobs().select("id", F.date_format(F.date_trunc("month", "created_at"), "yyyy-MM-dd").alias("month"), F.date_format(F.col("created_at") - F.expr("INTERVAL 90 SECOND"), "yyyy-MM-dd'T'HH:mm:ss").alias("before"))
)
query("s02_syllables_json", """SELECT track_id, count(*) AS n, round(sum("end" - start), 6) AS total FROM syllables GROUP BY 1""")(
    lambda c: c.syllables().groupBy("track_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("syllable", "start", "end")))).alias("j"))
    .select("track_id", P.syllable_array(F.col("j")).alias("s")).select("track_id", F.size("s").cast("long").alias("n"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["end"] - x["start"]), 6).alias("total"))
)
query("s03_vector_json", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")(
    lambda c: c.table("embeddings").select("vec_id", F.round(F.aggregate(P.vector_array(F.to_json("embedding")), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))
)
query("a11_document_frequency", f"SELECT gram, count(*) AS df FROM {GRAMS.format(m=4, id='doc_id', table='documents')} GROUP BY 1 HAVING count(*) > 2")(lambda c: M.document_frequency(candidates(c), 5, 3))
query("w05_token_ngrams", f"SELECT id, count(*) AS n FROM {B4} GROUP BY 1")(lambda c: M.grams(c.table("benchmark").select(F.col("item_id").alias("id"), "text"), 4).groupBy("id").agg(F.count("*").alias("n")))
# Each of these has two names: the second one dates from when the first had a bound on how many candidates hold an n-gram.
for _name in ("q07_candidate_pairs_benchmark", "q07_whole_pairs_benchmark"):
    query(_name, f"SELECT request_id, candidate_id, shared FROM {PAIRS.format(r=B4, c=D4)}")(lambda c: M.whole_pairs(items(c), candidates(c)))
for _name in ("q07_candidate_pairs_documents", "q07_whole_pairs_documents"):
    query(_name, f"SELECT request_id, candidate_id, shared FROM {PAIRS.format(r=R4, c=D4)}")(pairs)
TOKENS = "(SELECT doc_id AS id, len(ws) AS n, len(list_distinct(ws)) AS d, list_distinct(ws) AS ws FROM (SELECT doc_id, " + WS.format(t="lower(text)") + " AS ws FROM documents))"
MEASURES = f"""(SELECT request_id, candidate_id, common / r.d AS coverage_request, common / c.d AS coverage_candidate, shared / (rg + cg - shared) AS ngram, least(1, abs(ln(c.n / r.n))) AS length
  FROM (SELECT p.request_id, p.candidate_id, len(list_intersect(r.ws, c.ws)) AS common, (SELECT count(*) FROM d4 x JOIN d4 y USING (gram) WHERE x.id = p.request_id AND y.id = p.candidate_id) AS shared
        FROM prs p JOIN tok r ON r.id = request_id JOIN tok c ON c.id = candidate_id) JOIN tok r ON r.id = request_id JOIN tok c ON c.id = candidate_id
  JOIN (SELECT id, count(*) AS rg FROM d4 GROUP BY 1) a ON a.id = request_id JOIN (SELECT id, count(*) AS cg FROM d4 GROUP BY 1) b ON b.id = candidate_id)"""
CTES = f", d4 AS MATERIALIZED {D4}, d5 AS MATERIALIZED {GRAMS.format(m=4, id='doc_id', table='documents')}, tok AS MATERIALIZED {TOKENS}, prs AS MATERIALIZED {PAIRS.format(r=R4, c='d4')}"
for _name in ("a16_u02_pair_measures", "a16_u02_whole_pair_measures"):
    query(_name, f"{CTES} SELECT request_id, candidate_id, round(coverage_request, 6) AS coverage_request, round(coverage_candidate, 6) AS coverage_candidate, round(ngram, 6) AS ngram, round(length, 6) AS length FROM {MEASURES}")(
        lambda c: M.whole_measures(requests(c), candidates(c)).select("request_id", "candidate_id", *(F.round(x, 6).alias(x) for x in ("coverage_request", "coverage_candidate", "ngram", "length")))
    )
ANCHOR = """(SELECT request_id, candidate_id, CASE WHEN max(raw) OVER (PARTITION BY request_id) > 0 THEN raw / max(raw) OVER (PARTITION BY request_id) ELSE 0 END AS anchor
  FROM (SELECT p.request_id, p.candidate_id, coalesce(s / size, 0) AS raw FROM prs p
  LEFT JOIN (SELECT h.request_id, h.candidate_id, sum(1 / df) AS s FROM held h JOIN (SELECT request_id, gram, count(*) AS df FROM held GROUP BY ALL) USING (request_id, gram) JOIN d5 q ON q.id = h.request_id AND q.gram = h.gram GROUP BY ALL) USING (request_id, candidate_id)
  LEFT JOIN (SELECT id, count(*) AS size FROM d5 GROUP BY 1) z ON z.id = p.candidate_id))"""
CTES2 = CTES + ", held AS (SELECT request_id, candidate_id, gram FROM prs JOIN d5 ON d5.id = candidate_id)"
for _name in ("x16_rare_anchor", "x16_whole_rare_anchor"):
    query(_name, f"{CTES2} SELECT request_id, candidate_id, round(anchor, 6) AS anchor FROM {ANCHOR}")(
        lambda c: M.whole_anchors(requests(c), candidates(c)).select("request_id", "candidate_id", F.round("anchor", 6).alias("anchor"))
    )
SCORES = f"""(SELECT request_id, candidate_id, round(greatest(0, least(1, 0.55::DOUBLE * CASE WHEN coverage_request + coverage_candidate > 0 THEN 2 * coverage_request * coverage_candidate / (coverage_request + coverage_candidate) ELSE 0 END
  + 0.15::DOUBLE * coverage_request + 0.10::DOUBLE * ngram + 0.20::DOUBLE * anchor - 0.10::DOUBLE * length)), 9) AS score FROM {MEASURES} JOIN {ANCHOR} USING (request_id, candidate_id))"""
for _name in ("q07_lyrics_match", "q07_whole_lyrics_match"):
    query(
        _name,
        f"""{CTES2} SELECT request_id, candidate_id, round(score, 6) AS score, CASE WHEN score >= 0.65 AND (gap IS NULL OR gap >= 0.05) THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'reject' END AS decision
        FROM (SELECT *, round(score - lead(score) OVER w, 9) AS gap, row_number() OVER w AS k FROM {SCORES} WINDOW w AS (PARTITION BY request_id ORDER BY score DESC, candidate_id)) WHERE k = 1""",
    )(lambda c: M.decide(M.top_two(M.whole_best(requests(c), candidates(c)))).select("request_id", "candidate_id", F.round("score", 6).alias("score"), "decision"))
_tok = r"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
TOKEN_WEIGHTS = f"""(SELECT track_id, token, sum(w) AS w FROM (
  SELECT track_id, unnest({_tok.format(c="artist")}) AS token, 1.0::DOUBLE AS w FROM tracks WHERE status = 'ready' UNION ALL SELECT track_id, unnest({_tok.format(c="title")}), 0.4::DOUBLE FROM tracks WHERE status = 'ready'
  UNION ALL SELECT track_id, unnest({_tok.format(c="lyrics_text")}), 0.1::DOUBLE FROM tracks WHERE status = 'ready') GROUP BY ALL)"""
SEARCH = f"""(SELECT track_id, round(sum(w), 6) AS score FROM (
  SELECT track_id, unnest({_tok.format(c="artist")}) AS token, 1.0::DOUBLE AS w FROM tracks UNION ALL SELECT track_id, unnest({_tok.format(c="title")}), 0.4::DOUBLE FROM tracks
  UNION ALL SELECT track_id, unnest({_tok.format(c="lyrics_text")}), 0.1::DOUBLE FROM tracks) WHERE token IN ('the', 'brand') GROUP BY track_id HAVING count(DISTINCT token) = 2)"""
_ASKED = """(SELECT track_id AS query_id, artist || ' (' || title || ')' AS q FROM tracks WHERE track_id % 20 = 0
  UNION ALL SELECT -1 - track_id, 'THE, ' || split_part(title, ' ', 1) || '''s' FROM tracks WHERE track_id % 20 = 0)"""


def text_index(c: Catalog, batches: int = 1) -> FT.Index:
    """A stored index of all tracks, added in some batches."""
    tracks, index = c.tracks("track_id", "status", "artist", "title", "lyrics_text"), FT.Index(c.spark, shared_dir(c.spark), 1024, 16)
    for k in range(batches):
        index.add(tracks.filter(F.col("track_id") % batches == k))
    return index


def one_query(c: Catalog, q: str) -> DataFrame:
    return c.spark.createDataFrame([(1, q)], "query_id long, q string")


def _searches(c: Catalog) -> DataFrame:
    t = c.tracks("track_id", "artist", "title").filter("track_id % 20 = 0")
    return t.select(F.col("track_id").alias("query_id"), F.concat("artist", F.lit(" ("), "title", F.lit(")")).alias("q")).unionAll(
        t.select(-1 - F.col("track_id"), F.concat(F.lit("THE, "), F.split_part("title", F.lit(" "), F.lit(1)), F.lit("'s")))
    )


query("t10_text_search", f"SELECT track_id, score FROM {SEARCH} ORDER BY score DESC, track_id LIMIT 20 OFFSET 5")(
    lambda c: text_index(c).top(one_query(c, "the Brand"), 20, 5, None).select("track_id", "score")
)
query("t10_many_searches", f"""SELECT query_id, rank, track_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, track_id))::INT AS rank FROM (
  SELECT query_id, track_id, round(sum(w), 6) AS score FROM (SELECT query_id, len(ws) AS n, unnest(ws) AS token FROM (SELECT query_id, list_distinct({_tok.format(c='q')}) AS ws FROM {_ASKED}))
  JOIN {TOKEN_WEIGHTS} USING (token) GROUP BY query_id, n, track_id HAVING count(*) = n)) WHERE rank <= 5""")(lambda c: text_index(c, 2).top(_searches(c), 5))
query("a01_count_matches", f"SELECT count(*) AS n FROM {SEARCH}")(lambda c: text_index(c).matches(one_query(c, "brand the"), None).agg(F.count("*").alias("n")))
query("q09_recommend")(
    lambda c: Q.recommend(
        c.play_history(), c.tracks("track_id", "artist", "status", "popularity_category", "play_count", "language"), c.vectors("audio"), c.vectors("lyrics"), 20, c.table("customer").select(F.col("c_custkey").alias("session_id"))
    )
)
query("q12_rotate", "SELECT id, session_id, track_id FROM queue_entries q WHERE NOT EXISTS (SELECT 1 FROM (SELECT session_id, track_id FROM play_history GROUP BY ALL HAVING count(*) >= 2) h WHERE h.session_id = q.session_id AND h.track_id = q.track_id)")(
    lambda c: c.queue_entries().select("id", "session_id", "track_id").join(c.play_history().groupBy("session_id", "track_id").count().filter("count >= 2"), ["session_id", "track_id"], "left_anti").select("id", "session_id", "track_id")
)


def messages(c: Catalog) -> DataFrame:
    """A message for each job; some are broken, some lack their key."""
    good = F.to_json(F.struct(F.col("id").alias("job_id"), "mp3_key"))
    return c.jobs().select("id", F.when(F.col("id") % 7 == 0, F.concat(F.lit("{"), good)).otherwise(good).alias("value"))


query("z01_good_messages", "SELECT id, id AS job_id, mp3_key FROM jobs WHERE id % 7 <> 0 AND mp3_key IS NOT NULL")(lambda c: Z.good(Z.parsed(messages(c))))
query("z01_dead_letters", "SELECT id, CASE WHEN id % 7 = 0 THEN 'broken' ELSE 'missing' END AS error FROM jobs WHERE id % 7 = 0 OR mp3_key IS NULL")(lambda c: Z.dead_letters(Z.parsed(messages(c))).select("id", "error"))
query(
    "z05_inactivity_timeout",
    """SELECT job_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts) + INTERVAL 300 SECOND, '%Y-%m-%d %H:%M:%S') AS timed_out, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts - before < INTERVAL 300 SECOND THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY ts, id) AS s
    FROM (SELECT *, lag(ts) OVER (PARTITION BY job_id ORDER BY ts, id) AS before FROM progress)) GROUP BY job_id, s""",
)(lambda c: Z.inactivity(c.progress()).select("job_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), F.date_format("timed_out", "yyyy-MM-dd HH:mm:ss").alias("timed_out"), "n"))
query("z12_play_counts_stream", "SELECT track_id, count(*) AS plays FROM play_history WHERE completed GROUP BY 1")(
    lambda c: Z.run(
        Z.play_counts(Z.event_stream(c.spark, c.sf_dir).filter("event_type = 'view'").select(F.get_json_object("props", "$.k").cast("long").alias("track_id"), (F.col("value") > 5).alias("completed"))), "complete"
    )
)
query("z02_progress_latest_stream", "SELECT job_id, arg_max(step, (ts, id)) AS step, arg_max(progress, (ts, id)) AS progress FROM progress GROUP BY 1")(
    lambda c: Z.run(
        Z.latest(
            Z.event_stream(c.spark, c.sf_dir).select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.lit("running").alias("status"), F.col("event_type").alias("step"), F.get_json_object("props", "$.k").cast("long").alias("progress"), "ts")
        ), "complete",
    ).select("job_id", "step", "progress")
)
query("z06_idempotent_claim_stream", "SELECT DISTINCT user_id AS job_id FROM events")(
    lambda c: Z.run(Z.claims(Z.event_stream(c.spark, c.sf_dir).select(F.col("user_id").alias("job_id"), "ts")).select("job_id"))
)
query("f12_sessions_by_user", "SELECT session_id, count(*) AS n FROM play_history GROUP BY 1")(lambda c: c.play_history().groupBy("session_id").agg(F.count("*").alias("n")))
query("w17_spread_pick", "SELECT track_id, i, round_even(i * (max_n / 4.0), 0)::BIGINT AS n FROM (SELECT track_id, max(n) AS max_n FROM syllables GROUP BY 1), (SELECT unnest(range(0, 5)) AS i)")(
    lambda c: c.syllables().groupBy("track_id").agg(F.max("n").alias("m")).select("track_id", "m", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select("track_id", F.col("i").cast("long").alias("i"), F.bround(F.col("i") * (F.col("m") / 4.0)).cast("long").alias("n"))
)
query("k06_enrich_payloads", "SELECT track_id, artist, title, language, popularity_category FROM audio_vectors JOIN tracks USING (track_id) WHERE status = 'ready'")(
    lambda c: c.vectors("audio").select("track_id").join(R.ready(c.tracks()), "track_id").select("track_id", "artist", "title", "language", "popularity_category")
)


def progress_stream(c: Catalog) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("running")
    return Z.event_stream(c.spark, c.sf_dir).select(
        F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), status.alias("status"), F.col("event_type").alias("step"), F.get_json_object("props", "$.k").cast("long").alias("progress"), "ts"
    )


#: The stream forgets a job that is quiet for so long.
KEEP = 7 * 86400
query("z03_emit_on_change_stream", "SELECT id FROM (SELECT *, lag(step) OVER w AS s, lag(progress) OVER w AS p, lag(ts) OVER w AS before FROM progress WINDOW w AS (PARTITION BY job_id ORDER BY ts, id)) WHERE s IS NULL OR s <> step OR p <> progress OR ts - before >= INTERVAL 7 DAY")(
    lambda c: Z.run(T.emit_on_change(progress_stream(c), KEEP)).select("id")
)
query("z04_terminal_event_stream", "SELECT job_id, arg_min(id, (ts, id)) AS id, arg_min(status, (ts, id)) AS status FROM progress WHERE status <> 'running' GROUP BY 1")(
    lambda c: Z.run(T.terminal_events(progress_stream(c), 3650 * 86400)).select("job_id", "id", "status")
)
# The watermark ends at the last event, and so do the time-outs that have fired.
query(
    "z05_inactivity_stream",
    """SELECT job_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts) + INTERVAL 300 SECOND, '%Y-%m-%d %H:%M:%S') AS timed_out, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts - before < INTERVAL 300 SECOND THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY ts, id) AS s
    FROM (SELECT *, lag(ts) OVER (PARTITION BY job_id ORDER BY ts, id) AS before FROM progress)) GROUP BY job_id, s HAVING max(ts) + INTERVAL 300 SECOND < (SELECT max(ts) FROM progress)""",
)(lambda c: Z.run(T.inactivity(progress_stream(c))).select("job_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), F.date_format("timed_out", "yyyy-MM-dd HH:mm:ss").alias("timed_out"), "n"))


def _indexed(c: Catalog) -> DataFrame:
    """Index messages as a stream into the two vector tables, answers and dead letters; then the points, the dead by error, and plays a cluster."""
    key, k = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("up/"), "event_id")), F.get_json_object("props", "$.k").cast("long")
    body = F.to_json(F.struct(k.alias("track_id"), key.alias("mp3_key")))
    messages = Z.event_stream(c.spark, c.sf_dir).select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 11 == 0, F.lit("{broken")).otherwise(body).alias("value"))
    audio, lyrics, tables = c.vectors("audio"), c.vectors("lyrics"), S.Tables(c.spark, shared_dir(c.spark))
    means = V.centroids(audio, ["cluster_id"]).select("cluster_id", F.col("centroid").alias("a")).join(V.centroids(lyrics, ["cluster_id"]).select("cluster_id", F.col("centroid").alias("l")), "cluster_id")
    centroids = means.select("cluster_id", normalized(weighted_concat(F.col("a"), F.col("l"), (0.3 / 0.7) ** 0.5)).alias("centroid"))
    S.drive(messages, shared_dir(c.spark), tables, S.index_messages(audio, lyrics, centroids, c.tracks("track_id", "popularity_category")))
    points = [S.newest(tables.read(t, S.POINT), "track_id").select(F.lit(t).alias("kind"), "track_id", "rec_cluster_id", F.col("popularity_category").alias("detail"), F.lit(1).cast("long").alias("n")) for t in ("audio", "lyrics")]
    dead = tables.read("dead", S.DEAD).groupBy("error").agg(F.count("*").alias("n")).select(F.lit("dead").alias("kind"), F.lit(-1).cast("long").alias("track_id"), F.lit(-1).cast("long").alias("rec_cluster_id"), F.col("error").alias("detail"), "n")
    base = audio.groupBy(F.col("cluster_id").cast("long").alias("rec_cluster_id")).agg(F.count("*").alias("n"))
    counted = S.counters(base, tables.read("indexed", S.INDEXED).groupBy("rec_cluster_id").agg(F.count("*").alias("n")), "rec_cluster_id")
    return points[0].unionByName(points[1]).unionByName(dead).unionByName(counted.select(F.lit("count").alias("kind"), F.lit(-1).cast("long").alias("track_id"), "rec_cluster_id", F.lit("").alias("detail"), "n"))


_J12 = SQL["j12_assign_cluster"].removeprefix(BIND)
query("k07_index_stream", f""", msg AS (SELECT event_id AS id, (props::JSON ->> '$.k')::BIGINT AS track_id, CASE WHEN event_id % 11 = 0 THEN 'broken' WHEN event_id % 5 = 0 THEN 'missing' ELSE '' END AS error FROM events),
  pts AS (SELECT DISTINCT m.track_id, j.cluster_id::BIGINT AS rec_cluster_id, coalesce(popularity_category, 'regular') AS detail FROM msg m JOIN ({_J12}) j USING (track_id) LEFT JOIN tracks USING (track_id) WHERE error = '')
  SELECT 'audio' AS kind, track_id, rec_cluster_id, detail, 1::BIGINT AS n FROM pts UNION ALL SELECT 'lyrics', track_id, rec_cluster_id, detail, 1 FROM pts
  UNION ALL SELECT 'dead', -1, -1, error, count(*) FROM msg WHERE error <> '' GROUP BY error
  UNION ALL SELECT 'dead', -1, -1, 'no vectors', count(*) AS n FROM (SELECT DISTINCT track_id FROM msg WHERE error = '' AND track_id NOT IN (SELECT track_id FROM pts)) HAVING count(*) > 0
  UNION ALL SELECT 'count', -1, rec_cluster_id, '', sum(n)::BIGINT FROM (SELECT rec_cluster_id, 1 AS n FROM pts UNION ALL SELECT cluster_id, 1 FROM audio_vectors) GROUP BY rec_cluster_id""")(_indexed)
query("j15_fuzzy_tokens")(lambda c: M.whole_fuzzy(items(c), candidates(c)))
query("x11_x12_hints")(lambda c: M.hints(c.tracks("artist", "title").select(F.col("artist").alias("hint"), F.col("title").alias("name"))))

# --- words that look or sound alike ----------------------------------------------------------------------------------------

FOLDED = f"regexp_replace(translate(lower(word), '{X.FOLD[0]}', '{X.FOLD[1]}'), '[^\\p{{L}}]', '', 'g')"
BONES = f"translate({FOLDED}, '{X.LATIN_VOWELS + X.CYRILLIC_VOWELS}', '')"
_classes = f"regexp_replace(translate({FOLDED}[2:], '{X.SOUNDS[0]}', '{X.SOUNDS[1]}'), '[a-z]', '', 'g')"
for _k in "123456":
    _classes = f"regexp_replace({_classes}, '{_k}+', '{_k}', 'g')"
SOUND = f"CASE WHEN regexp_matches({FOLDED}, '^[a-z]+$') THEN {FOLDED}[1] || {_classes} ELSE '' END"
WORDS = f"(SELECT id, word, count, {BONES} AS skeleton, {SOUND} AS phonetic FROM (SELECT id, word, count(*) AS count FROM (SELECT doc_id AS id, unnest({WS.format(t='lower(text)')}) AS word FROM documents) GROUP BY ALL))"


def lower_words(c: Catalog) -> DataFrame:
    return M.word_rows(candidates(c).select("id", F.lower("text").alias("text")))


query("x09_word_features", f"SELECT DISTINCT word, skeleton, phonetic FROM {WORDS}")(lambda c: lower_words(c).select("word", "skeleton", "phonetic").distinct())
query("j14_token_match", f""", prs AS MATERIALIZED (SELECT request_id AS a, candidate_id AS b FROM {PAIRS.format(r=R4, c=D4)}), wds AS MATERIALIZED {WORDS},
  ks AS MATERIALIZED (SELECT DISTINCT id, k FROM (SELECT id, 'l' || word AS k FROM wds UNION ALL SELECT id, 's' || skeleton FROM wds WHERE skeleton <> '' UNION ALL SELECT id, 'p' || phonetic FROM wds WHERE phonetic <> '')),
  lk AS (SELECT a, b, w.word, w.count, skeleton, phonetic FROM prs JOIN wds w ON w.id = a WHERE NOT EXISTS (SELECT 1 FROM wds o WHERE o.id = b AND o.word = w.word))
  SELECT a, b, count(*) AS words, sum(count)::BIGINT AS occurrences, count(*) FILTER (s.k IS NOT NULL OR p.k IS NOT NULL) AS found FROM lk
  LEFT JOIN ks s ON s.id = b AND s.k = 's' || skeleton AND skeleton <> '' LEFT JOIN ks p ON p.id = b AND p.k = 'p' || phonetic AND phonetic <> '' GROUP BY ALL""")(
    lambda c: M.whole_lacking(requests(c), candidates(c)).withColumnsRenamed({"request_id": "a", "candidate_id": "b"})
)
# Ratios have no SQL: tests hold it against the rules word by word.
query("q07_match_words")(
    lambda c: M.decide(M.top_two(M.whole_match(requests(c), candidates(c), c.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), language="en"))).select("request_id", "candidate_id", F.round("score", 6).alias("score"), "decision")
)


def _stems(c: Catalog) -> DataFrame:
    """Stems and sound codes of the words of all texts, cleaned as the match cleans them. Snowball's stemmer has no SQL here."""
    words = candidates(c).select(F.explode(X.tokenize(X.clean_for_match(nfkc(F.col("text"))))).alias("word")).distinct()
    return words.select("word", stem(F.col("word"), "en").alias("stem"), metaphone(F.translate("word", *X.FOLD)).alias("metaphone"))


query("x09_stems")(_stems)
