"""Update, timing and frame queries. Importing this module adds them to the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from ..operators import timing as T
from ..operators import search as S
from ..operators import updates as U
from ..operators import vectors as V
from ..sources.shared import shared_dir
from ..sources.tables import KeyedTable
from .bind import Catalog
from .registry import DOT, LINES, NEAR, NEAR_ALL, _every_query, _queries, query  # noqa: F401

NOW = "2001-08-02 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


query("k03_set_payload", "SELECT track_id, artist, CASE WHEN track_id % 4 = 0 THEN 'changed' ELSE status END AS status, CASE WHEN track_id % 4 = 0 THEN 'yes' END AS extra FROM tracks")(
    lambda c: U.set_payload(
        c.tracks("track_id", "artist", "status").select("track_id", F.create_map(F.lit("artist"), "artist", F.lit("status"), "status").alias("payload")),
        c.tracks("track_id", "status").filter("track_id % 4 = 0").select("track_id", F.create_map(F.lit("status"), F.lit("changed"), F.lit("extra"), F.lit("yes")).alias("payload")), "track_id",
    ).select("track_id", *(F.try_element_at("payload", F.lit(k)).alias(k) for k in ("artist", "status", "extra")))
)
query(
    "k04_upsert_artist",
    f"""SELECT coalesce(a.name, n.name) AS name, CASE WHEN n.name IS NOT NULL THEN 'new.jpg' ELSE a.image_path END AS image, CASE WHEN a.name IS NULL THEN '{NOW}' ELSE '2000-01-01 00:00:00' END AS created,
    CASE WHEN n.name IS NOT NULL THEN '{NOW}' ELSE '2000-01-01 00:00:00' END AS updated FROM artists a FULL JOIN (SELECT DISTINCT artist AS name FROM tracks WHERE track_id % 9 = 0) n ON a.name = n.name""",
)(
    lambda c: U.upsert_artist(
        c.artists().select("name", F.col("image_path").alias("image"), F.lit("seed").alias("source"), F.lit("2000-01-01").cast("timestamp_ntz").alias("created_at"), F.lit("2000-01-01").cast("timestamp_ntz").alias("updated_at")),
        c.tracks("track_id", "artist").filter("track_id % 9 = 0").select(F.col("artist").alias("name"), F.lit("new.jpg").alias("image"), F.lit("web").alias("source")).distinct(), now(),
    ).select("name", "image", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"), F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"))
)
query("k07_index_track", "SELECT track_id, 'ready' AS status, cluster_id AS rec_cluster_id, cluster_id AS catalog_cluster_id, popularity_category FROM tracks JOIN audio_vectors USING (track_id)")(
    lambda c: U.index_points(c.tracks(), c.vectors("audio").select("track_id", "cluster_id"))
)
query("k08_append_defaults", "SELECT id, 'pending' AS status, coalesce(artist_hint, 'Unknown') AS artist_hint FROM jobs")(lambda c: U.with_defaults(c.jobs().select("id", "artist_hint"), {"status": "pending", "artist_hint": "Unknown"}))
query("k05_export_catalog", """SELECT cluster_id, to_json({'id': cluster_id, 'track_count': n, 'tags': list({'id': tag_id, 'name': name} ORDER BY tag_id)})::VARCHAR AS document
  FROM (SELECT cluster_id, count(*) AS n FROM audio_vectors GROUP BY 1) JOIN mood_tags USING (cluster_id) GROUP BY cluster_id, n""")(
    lambda c: S.export_catalog(c.vectors("audio").groupBy("cluster_id").agg(F.count("*").alias("track_count")), c.mood_tags())
)
FIN = "(SELECT *, CASE WHEN id % 6 = 0 THEN 'done' ELSE status END AS s FROM queue_entries)"
query(
    "q13_finish_play",
    f"""SELECT id, session_id, s AS status, s IN ('playing', 'queued') AND row_number() OVER (PARTITION BY session_id ORDER BY CASE s WHEN 'playing' THEN 0 WHEN 'queued' THEN 1 ELSE 2 END, order_position, id) = 1 AS is_next FROM {FIN}""",
)(lambda c: U.finish_play(c.queue_entries(), c.queue_entries().filter("id % 6 = 0").select("id")).select("id", "session_id", "status", "is_next"))
query(
    "q14_skip_turn",
    """SELECT id, session_id, CASE WHEN id % 8 = 0 THEN 'skipped' ELSE status END AS status, order_position, false AS is_copy FROM queue_entries
    UNION ALL SELECT id, session_id, 'queued', last + row_number() OVER (PARTITION BY session_id ORDER BY order_position, id), true FROM queue_entries JOIN (SELECT session_id, max(order_position) AS last FROM queue_entries GROUP BY 1) USING (session_id) WHERE id % 8 = 0""",
)(lambda c: U.skip_turn(c.queue_entries(), c.queue_entries().filter("id % 8 = 0").select("id")).select("id", "session_id", "status", "order_position", "is_copy"))
query(
    "q15_status_change",
    f"""SELECT id, coalesce(n, status) AS status, CASE WHEN n = 'playing' THEN '{NOW}' END AS started, CASE WHEN n IN ('done', 'skipped') THEN '{NOW}' END AS finished
    FROM (SELECT *, CASE id % 4 WHEN 0 THEN 'playing' WHEN 1 THEN 'done' WHEN 2 THEN 'skipped' END AS n FROM queue_entries)""",
)(
    lambda c: U.set_status(c.queue_entries(), c.queue_entries().filter("id % 4 < 3").select("id", F.expr("CASE id % 4 WHEN 0 THEN 'playing' WHEN 1 THEN 'done' ELSE 'skipped' END").alias("new_status")), now()).select(
        "id", "status", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started"), F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss").alias("finished")
    )
)
query("q16_clear_clusters", "SELECT track_id, title, status, coalesce(rec_cluster_id, -1) AS before, true AS cleared, play_count FROM tracks")(
    lambda c: U.clear_clusters(c.tracks()).join(c.tracks("track_id", "rec_cluster_id").select("track_id", F.coalesce("rec_cluster_id", F.lit(-1)).alias("before")), "track_id")
    .select("track_id", "title", "status", "before", (F.col("rec_cluster_id").isNull() & F.col("catalog_cluster_id").isNull()).alias("cleared"), "play_count")
)
query("z08_indexed_to_tracks", "SELECT track_id, coalesce(CASE WHEN track_id % 2 = 0 THEN 77 ELSE rec_cluster_id END, -1) AS rec_cluster_id, track_id % 6 < 4 AS synced FROM (SELECT track_id, rec_cluster_id FROM tracks WHERE track_id % 6 < 4 AND track_id % 2 = 0 UNION ALL SELECT track_id, rec_cluster_id FROM tracks WHERE track_id % 2 = 1)")(
    lambda c: U.indexed_to_tracks(
        c.tracks("track_id", "rec_cluster_id").select("track_id", "rec_cluster_id").filter("track_id % 2 = 1 or track_id % 6 < 4"),
        c.tracks("track_id").filter("track_id % 6 < 4").select("track_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")).select("track_id", "seq", F.expr("CASE WHEN seq = 1 THEN 5 WHEN track_id % 2 = 0 THEN 77 END").alias("cluster_id")),
    ).withColumn("rec_cluster_id", F.coalesce("rec_cluster_id", F.lit(-1)))
)
query("z10_job_results", "SELECT id, CASE WHEN id % 3 = 0 THEN 'failed' WHEN id % 3 = 1 THEN 'completed' ELSE status END AS status, CASE WHEN id % 3 = 2 THEN locked_by END AS locked_by, CASE WHEN id % 3 = 1 THEN 'ok' END AS result, CASE WHEN id % 3 = 0 THEN 'bad' END AS error_message FROM jobs")(
    lambda c: U.job_results(c.jobs(), c.jobs().filter("id % 3 < 2").select("id", F.expr("CASE WHEN id % 3 = 1 THEN 'ok' END").alias("result"), F.expr("CASE WHEN id % 3 = 0 THEN 'bad' END").alias("error_message"))).select("id", "status", "locked_by", "result", "error_message")
)
query("z11_dead_letter_expiry", "SELECT id FROM jobs WHERE updated_at > (SELECT max(updated_at) FROM jobs) - INTERVAL 72 HOUR")(
    lambda c: U.unexpired(c.jobs().select("id", F.col("updated_at").alias("ts")).join(c.jobs().agg(F.max("updated_at").alias("last")).withColumn("one", F.lit(1)), F.lit(True)), F.col("last")).select("id")
)

GAPS = f"""(SELECT track_id, before AS start, start AS "end" FROM (SELECT *, coalesce(lag("end") OVER (PARTITION BY track_id ORDER BY line), 0) AS before FROM {LINES}) WHERE (line = 0 AND start > 0.1) OR (line > 0 AND start - before >= 5))"""
query("j17_gap_at", f"""SELECT q.track_id, q.t, round((t - start) / ("end" - start) * 100, 4) AS percent FROM (SELECT track_id, n * 1.3::DOUBLE AS t FROM syllables) q JOIN {GAPS} g ON g.track_id = q.track_id AND t >= start AND t < "end" """)(
    lambda c: T.gap_at(T.gap_intervals(c.syllables()), c.syllables().select("track_id", (F.col("n") * 1.3).alias("t"))).select("track_id", "t", F.round("percent", 4).alias("percent"))
)
query("x26_syllable_progress", """SELECT track_id, n, CASE WHEN "end" <= 9.8 THEN 'sung' WHEN start <= 9.8 THEN 'active' ELSE 'upcoming' END AS state FROM syllables""")(lambda c: T.syllable_progress(c.syllables(), 9.8).select("track_id", "n", "state"))
VOICED = """(SELECT track_id, n, rms > max(rms) OVER (PARTITION BY track_id) * pow(10, -1.0) AS voiced FROM rms_frames)"""
query(
    "q01_voiced_intervals",
    f"""SELECT track_id, start_n, end_n FROM (SELECT *, sum(end_n - start_n) OVER (PARTITION BY track_id) * 0.02 AS total FROM (SELECT track_id, min(n) AS start_n, max(n) + 1 AS end_n FROM
    (SELECT track_id, n, n - row_number() OVER (PARTITION BY track_id ORDER BY n) AS run FROM {VOICED} WHERE voiced) GROUP BY track_id, run)) WHERE total >= 1""",
)(lambda c: T.voiced_intervals(c.rms_frames(), 20.0))
query("j18_a15_frames_in_span", """SELECT s.track_id, s.n AS span, max(rms) AS peak, count(*) AS n_frames FROM syllables s JOIN rms_frames f ON f.track_id = s.track_id AND f.n >= 5 * s.n AND f.n < 5 * s.n + 3 + s.n % 9 GROUP BY ALL""")(
    lambda c: T.frames_in_span(c.rms_frames(), c.syllables().select("track_id", F.col("n").cast("long").alias("span"), (5 * F.col("n")).cast("long").alias("start_n"), (5 * F.col("n") + 3 + F.col("n") % 9).cast("long").alias("end_n")))
)
query("t05_hit_priority", f"""SELECT query_id, track_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN popularity_category IN ('eternal_hit', 'current_hit', 'artist_best') AND score >= 0.5 THEN 0 ELSE 1 END, score DESC, track_id) AS k
  FROM {NEAR.format(kind="audio", on="true", k=30)} JOIN tracks USING (track_id)) WHERE k <= 10""")(
    lambda c: _hit_priority(V.nearest(_queries(c, "audio"), c.vectors("audio"), 30).join(c.tracks("track_id", "popularity_category").select("track_id", "popularity_category"), "track_id"), 10)
)


def _hit_priority(hits: DataFrame, limit: int) -> DataFrame:
    first = F.when(F.col("popularity_category").isin(*R.HITS) & (F.col("score") >= 0.5), 0).otherwise(1)
    return hits.withColumn("k", F.row_number().over(R.by("query_id").orderBy(first, F.desc("score"), "track_id"))).filter(F.col("k") <= limit).select("query_id", "track_id")


query("x31_quoted_phrase", r"""SELECT doc_id, len(list_filter(regexp_extract_all(q, '"([^"]*)"', 1), lambda p: len(list_filter(regexp_split_to_array(p, '\s+'), lambda x: x <> '')) > 3)) > 0 AS too_long FROM (SELECT doc_id, '"' || text || '" by someone' AS q FROM documents)""")(
    lambda c: c.table("documents").select("doc_id", X.quoted_phrase_too_long(F.concat(F.lit('"'), F.col("text"), F.lit('" by someone'))).alias("too_long"))
)
query("x31_quoted_phrase_whole", r"""SELECT doc_id, len(list_filter(regexp_extract_all(text, '"([^"]*)"', 1), lambda p: len(list_filter(regexp_split_to_array(p, '\s+'), lambda x: x <> '')) > 3)) > 0 AS too_long FROM documents""")(
    lambda c: c.table("documents").select("doc_id", X.quoted_phrase_too_long(F.col("text")).alias("too_long"))
)
query("j20_variants_product", "SELECT user_id, a, b FROM (SELECT DISTINCT user_id, event_type AS a FROM events) JOIN (SELECT DISTINCT user_id, event_type AS b FROM events) USING (user_id)")(
    lambda c: c.table("events").groupBy("user_id").agg(F.collect_set("event_type").alias("v")).select("user_id", "v", F.explode("v").alias("a")).select("user_id", "a", F.explode("v").alias("b"))
)
query("w06_top2_gap", f"SELECT query_id, round(score, 6) AS best, round(score - second, 6) AS gap FROM (SELECT *, lead(score) OVER (PARTITION BY query_id ORDER BY score DESC, track_id) AS second FROM {NEAR_ALL.format(kind='lyrics', on='true', k=2)}) WHERE rank = 1")(
    lambda c: V.nearest(_every_query(c, "lyrics"), c.vectors("lyrics"), 2).withColumn("second", F.lead("score").over(R.by("query_id").orderBy(F.desc("score"), "track_id"))).filter("rank = 1")
    .select("query_id", F.round("score", 6).alias("best"), F.round(F.col("score") - F.col("second"), 6).alias("gap"))
)


def _committed(c: Catalog) -> DataFrame:
    """The tracks as a versioned table: ready ones put in, hits' counts patched, error ones put in and out again."""
    t = KeyedTable(c.spark, shared_dir(c.spark), "track_id long, artist string, status string, play_count long", "track_id", 16)
    tracks = c.tracks("track_id", "artist", "status", "play_count").select("track_id", "artist", "status", F.col("play_count").cast("long").alias("play_count"))
    t.upsert(tracks.filter("status = 'ready'"))
    t.patch(tracks.filter("track_id % 9 = 0").select("track_id", F.when(F.col("track_id") % 2 == 0, F.upper("artist")).alias("artist"), F.lit("patched").alias("status")))
    t.upsert(tracks.filter("status <> 'ready'"))
    t.delete(tracks.filter("status = 'error' OR track_id % 50 = 3"))
    return t.read()


query("k01_committed_table", """SELECT track_id, CASE WHEN status = 'ready' AND track_id % 9 = 0 AND track_id % 2 = 0 THEN upper(artist) ELSE artist END AS artist,
  CASE WHEN status = 'ready' AND track_id % 9 = 0 THEN 'patched' ELSE status END AS status, play_count FROM tracks WHERE status <> 'error' AND track_id % 50 <> 3""")(_committed)
