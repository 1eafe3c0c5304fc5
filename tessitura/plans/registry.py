"""The registered catalog queries. Each takes a Catalog; beside it stands the same query as SQL over the BIND tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.vectors import dot, finite, norm, normalized, weighted_concat, zscore
from ..operators import relational as R
from ..operators import timing as T
from ..operators import vectors as V
from .bind import BIND, Catalog

QUERIES: dict[str, Callable[[Catalog], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Catalog], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = BIND + sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Catalog(spark, sf_dir))) for name, f in QUERIES.items()}


# --- filters ---------------------------------------------------------------------------------------------------------------

query("f01_filter_status", "SELECT track_id, artist, title FROM tracks WHERE status = 'ready'")(lambda c: R.ready(c.tracks("track_id", "artist", "title", "status")).select("track_id", "artist", "title"))
query("f02_filter_in", "SELECT track_id, popularity_category FROM tracks WHERE popularity_category IN ('eternal_hit', 'artist_best')")(
    lambda c: c.tracks("track_id", "popularity_category").filter(F.col("popularity_category").isin("eternal_hit", "artist_best")).select("track_id", "popularity_category")
)
query("f03_filter_not_in", "SELECT track_id, coalesce(rec_cluster_id, -1) AS rec_cluster_id FROM tracks WHERE rec_cluster_id IS NULL OR rec_cluster_id NOT IN (1, 2, 3)")(
    lambda c: R.filter_not_in(c.tracks(), "rec_cluster_id", [1, 2, 3]).select("track_id", F.coalesce("rec_cluster_id", F.lit(-1)).alias("rec_cluster_id"))
)
query("f04_filter_optional", "SELECT track_id, language FROM tracks WHERE language = 'fr'")(lambda c: R.filter_optional(R.filter_optional(c.tracks(), "language", "fr"), "artist", None).select("track_id", "language"))
query("f05_filter_payload", "SELECT track_id FROM tracks WHERE status = 'ready' AND rec_cluster_id = 4 AND popularity_category = 'regular'")(
    lambda c: R.filter_payload(c.tracks(), {"status": "ready", "rec_cluster_id": 4, "popularity_category": "regular"}).select("track_id")
)
query("f06_scroll_filtered", "SELECT track_id, 0.0::DOUBLE AS score FROM tracks WHERE language = 'en' ORDER BY track_id LIMIT 50")(
    lambda c: R.filter_payload(c.tracks(), {"language": "en"}).select("track_id", F.lit(0.0).alias("score")).orderBy("track_id").limit(50)
)
query("f07_lookup_by_ids", "SELECT track_id, title FROM tracks WHERE track_id IN (SELECT DISTINCT track_id FROM play_history)")(
    lambda c: c.tracks().join(c.play_history().select("track_id").distinct(), "track_id", "left_semi").select("track_id", "title")
)
query(
    "f08_suggest",
    "SELECT artist || ' — ' || title AS suggestion FROM (SELECT DISTINCT artist, title FROM tracks WHERE status = 'ready' AND (artist ILIKE '%1%' OR title ILIKE '%1%')) ORDER BY artist, title LIMIT 20",
)(lambda c: R.suggest(c.tracks(), "1", 20))
query(
    "f09_missing_artist_images",
    "SELECT DISTINCT artist AS name FROM tracks LEFT JOIN artists ON name = artist WHERE status = 'ready' AND image_path IS NULL",
)(lambda c: R.missing_images(c.tracks(), c.artists()))
query(
    "f10_active_uploads",
    "SELECT id, status, coalesce(artist_hint, 'Unknown') AS artist, created_at FROM jobs WHERE mp3_key IS NOT NULL AND status IN ('pending', 'running')",
)(lambda c: R.active_uploads(c.jobs()))
query(
    "f11_stale_pending",
    "SELECT id, updated_at FROM jobs WHERE status = 'pending' AND mp3_key IS NOT NULL AND updated_at < TIMESTAMP '2001-08-02' - INTERVAL 600 SECOND",
)(lambda c: R.stale_pending(c.jobs(), "2001-08-02", 600).select("id", "updated_at"))
query(
    "f12_active_session",
    "SELECT session_id, id, played_at FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY played_at DESC, id DESC) AS k FROM play_history) WHERE k = 1",
)(lambda c: R.first_by(c.play_history(), ["session_id"], F.desc("played_at"), F.desc("id")).select("session_id", "id", "played_at"))
query("f13_search_item", "SELECT track_id, artist, title, duration_sec, status = 'ready' AS clip_ready FROM tracks")(
    lambda c: c.tracks("track_id", "artist", "title", "duration_sec", "status").select("track_id", "artist", "title", "duration_sec", (F.col("status") == "ready").alias("clip_ready"))
)
query("f14_image_url", "SELECT track_id, CASE WHEN image_path <> '' THEN 'https://media/' || image_path END AS image_url FROM tracks LEFT JOIN artists ON name = artist")(
    lambda c: R.with_image(c.tracks(), c.artists()).select("track_id", "image_url")
)
query("f15_inexact_text", "SELECT track_id, coalesce(lyrics_source = 'asr_fallback', false) AS inexact FROM tracks")(
    lambda c: c.tracks("track_id", "lyrics_source").select("track_id", F.coalesce(F.col("lyrics_source") == "asr_fallback", F.lit(False)).alias("inexact"))
)
query(
    "f16_partial_update",
    """SELECT t.track_id, coalesce(p.language, t.language) AS language, coalesce(p.duration_sec, t.duration_sec) AS duration_sec FROM tracks t
    LEFT JOIN (SELECT track_id, CASE WHEN track_id % 2 = 0 THEN 'xx' END AS language, CASE WHEN track_id % 3 = 0 THEN 1 END AS duration_sec FROM tracks WHERE track_id % 5 < 3) p USING (track_id)""",
)(
    lambda c: R.partial_update(
        c.tracks("track_id", "duration_sec", "language").select("track_id", "language", "duration_sec"),
        c.tracks("track_id", "duration_sec", "language").filter("track_id % 5 < 3").select("track_id", F.expr("CASE WHEN track_id % 2 = 0 THEN 'xx' END").alias("language"), F.expr("CASE WHEN track_id % 3 = 0 THEN 1 END").alias("duration_sec")),
        "track_id",
        ["language", "duration_sec"],
    )
)
query("f18_object_key", "SELECT track_id, 'instrumentals/' || track_id || '.mp3' AS mp3_key FROM tracks")(
    lambda c: c.tracks("track_id", "title", "mp3_key").select("track_id", R.object_key(F.concat(F.col("track_id").cast("string"), F.lit("_("), "title", F.lit(").mp3"))).alias("mp3_key"))
)
query("f19_safe_filename", r"""SELECT track_id, regexp_replace(regexp_replace(artist || ' - ' || title || '?.', '[\\/*?:"<>|]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') || '.mp3' AS name FROM tracks""")(
    lambda c: c.tracks("track_id", "artist", "title").select("track_id", R.safe_filename(F.col("artist"), F.concat("title", F.lit("?."))).alias("name"))
)

# --- joins -----------------------------------------------------------------------------------------------------------------

query("j01_queue_details", "SELECT q.id, q.participant_id, title, artist FROM queue_entries q LEFT JOIN tracks USING (track_id)")(
    lambda c: c.queue_entries().join(c.tracks("track_id", "artist", "title").select("track_id", "title", "artist"), "track_id", "left").select("id", "participant_id", "title", "artist")
)
query("j02_session_history", "SELECT h.id, h.session_id, title, CASE WHEN image_path <> '' THEN 'https://media/' || image_path END AS image_url, played_at FROM play_history h JOIN tracks USING (track_id) LEFT JOIN artists ON name = artist")(
    lambda c: R.with_image(c.play_history().join(c.tracks("track_id", "artist", "title").select("track_id", "title", "artist"), "track_id"), c.artists()).select("id", "session_id", "title", "image_url", "played_at")
)
query("j03_playback_start", "SELECT q.id, CASE WHEN t.track_id IS NOT NULL THEN 'https://media/' || mp3_key END AS url, title, lyrics_source FROM queue_entries q LEFT JOIN tracks t USING (track_id)")(
    lambda c: c.queue_entries().join(c.tracks(), "track_id", "left").select("id", F.when(F.col("title").isNotNull(), F.concat(F.lit("https://media/"), "mp3_key")).alias("url"), "title", "lyrics_source")
)
CURRENT = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY status <> 'playing', order_position, id) AS k FROM queue_entries WHERE status IN ('playing', 'queued')) WHERE k = 1)"
query("j04_next_performer", f"SELECT session_id, q.id, participant_id, title FROM {CURRENT} q LEFT JOIN tracks USING (track_id)")(
    lambda c: R.current_entry(c.queue_entries()).join(c.tracks("track_id", "title").select("track_id", "title"), "track_id", "left").select("session_id", "id", "participant_id", "title")
)
PROFILE = "(SELECT session_id, list_sort(list(DISTINCT artist)) AS artists, list_sort(list(DISTINCT rec_cluster_id) FILTER (rec_cluster_id IS NOT NULL)) AS clusters FROM play_history JOIN tracks USING (track_id) GROUP BY 1)"
query("j05_played_profile", f"SELECT session_id, array_to_string(artists, ',') AS artists, coalesce(array_to_string(clusters, ','), '') AS clusters FROM {PROFILE}")(
    lambda c: R.played_profile(c.play_history(), c.tracks()).select("session_id", F.array_join("artists", ",").alias("artists"), F.array_join(F.transform("clusters", lambda x: x.cast("string")), ",").alias("clusters"))
)
query("j06_both_vectors", "SELECT track_id FROM audio_vectors JOIN lyrics_vectors USING (track_id)")(lambda c: c.vectors("audio").select("track_id").join(c.vectors("lyrics").select("track_id"), "track_id"))
query("j08_exclude_seen", "SELECT q.id, q.session_id, q.track_id FROM queue_entries q WHERE NOT EXISTS (SELECT 1 FROM play_history h WHERE h.session_id = q.session_id AND h.track_id = q.track_id)")(
    lambda c: c.queue_entries().select("id", "session_id", "track_id").join(c.play_history().select("session_id", "track_id"), ["session_id", "track_id"], "left_anti").select("id", "session_id", "track_id")
)
query("j10_tag_cluster", "SELECT tag_id, track_id FROM mood_tags m JOIN tracks t ON t.rec_cluster_id = m.cluster_id")(
    lambda c: c.mood_tags().join(c.tracks("track_id", "rec_cluster_id").select("track_id", F.col("rec_cluster_id").alias("cluster_id")), "cluster_id").select("tag_id", "track_id")
)
query("j10_tag_cluster_all", "SELECT tag_id, track_id FROM mood_tags m JOIN tracks t ON t.rec_cluster_id = m.cluster_id")(
    lambda c: c.mood_tags().join(c.tracks("track_id", "rec_cluster_id").select("track_id", F.col("rec_cluster_id").alias("cluster_id")), "cluster_id").select("tag_id", "track_id")
)
query(
    "j13_verify_object_refs",
    "SELECT count(*) AS rows, count(mp3_key) AS with_key, count(*) FILTER (status = 'ready' AND mp3_key IS NULL) AS ready_without_key FROM tracks",
)(lambda c: c.tracks("status", "mp3_key").agg(F.count("*").alias("rows"), F.count("mp3_key").alias("with_key"), F.count(F.when((F.col("status") == "ready") & F.col("mp3_key").isNull(), 1)).alias("ready_without_key")))

# --- vectors ---------------------------------------------------------------------------------------------------------------

DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
NEAR = """(SELECT * FROM (SELECT q.track_id AS query_id, x.track_id, round(list_dot_product(x.vector, q.vector), 9) AS score,
  row_number() OVER (PARTITION BY q.track_id ORDER BY round(list_dot_product(x.vector, q.vector), 9) DESC, x.track_id) AS rank
  FROM {kind}_vectors x JOIN {kind}_vectors q ON {on} WHERE q.track_id % 20 = 0) WHERE rank <= {k})"""

#: The same with every vector as a query.
NEAR_ALL = NEAR.replace(" WHERE q.track_id % 20 = 0", "")


def _queries(c: Catalog, kind: str, *more: str) -> DataFrame:
    return _every_query(c, kind, *more).filter("query_id % 20 = 0")


def _every_query(c: Catalog, kind: str, *more: str) -> DataFrame:
    return c.vectors(kind).select(F.col("track_id").alias("query_id"), F.col("vector").alias("query"), *more)


query("j11_knn", f"SELECT query_id, track_id, round(score, 6) AS score FROM {NEAR_ALL.format(kind='audio', on='true', k=10)}")(
    lambda c: V.nearest(_every_query(c, "audio"), c.vectors("audio"), 10).select("query_id", "track_id", F.round("score", 6).alias("score"))
)
query("j11_knn_in_cluster", f"SELECT query_id, track_id, round(score, 6) AS score FROM {NEAR_ALL.format(kind='lyrics', on='x.cluster_id = q.cluster_id', k=10)}")(
    lambda c: V.nearest(_every_query(c, "lyrics", "cluster_id"), c.vectors("lyrics"), 10, ["cluster_id"]).select("query_id", "track_id", F.round("score", 6).alias("score"))
)
FUSED = f"""(SELECT query_id, track_id, round(0.7::DOUBLE * coalesce(a.score, 0) + 0.3::DOUBLE * coalesce(l.score, 0), 9) AS score
  FROM {NEAR.format(kind="audio", on="true", k=20)} a FULL JOIN {NEAR.format(kind="lyrics", on="true", k=20)} l USING (query_id, track_id))"""
query("j07_t07_fused_top", f"SELECT query_id, track_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, track_id) AS rank FROM {FUSED}) WHERE rank <= 10")(
    lambda c: V.fused(V.nearest(_queries(c, "audio"), c.vectors("audio"), 20), V.nearest(_queries(c, "lyrics"), c.vectors("lyrics"), 20), 10).select("query_id", "track_id", F.round("score", 6).alias("score"))
)
query("u04_union_of_ids", f"SELECT query_id, track_id FROM {FUSED}")(
    lambda c: V.fused(V.nearest(_queries(c, "audio"), c.vectors("audio"), 20), V.nearest(_queries(c, "lyrics"), c.vectors("lyrics"), 20), 40).select("query_id", "track_id")
)
CENTROIDS = "(SELECT cluster_id, list(x ORDER BY pos) AS centroid, max(n) AS n FROM (SELECT cluster_id, pos, avg(x) AS x, count(*) AS n FROM (SELECT cluster_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM {kind}_vectors) GROUP BY ALL) GROUP BY cluster_id)"
query("a07_cluster_table", f"SELECT cluster_id, n AS track_count, array_to_string(list_transform(centroid, lambda x: round(x, 4)::DECIMAL(9, 4)::VARCHAR), ' ') AS centroid FROM {CENTROIDS.format(kind='audio')}")(
    lambda c: V.centroids(c.vectors("audio"), ["cluster_id"]).select("cluster_id", F.col("n").alias("track_count"), F.array_join(F.transform("centroid", lambda x: F.round(x, 4).cast("decimal(9,4)").cast("string")), " ").alias("centroid"))
)
query(
    "a06_session_centroids",
    """SELECT session_id, cluster_id, pos, round(avg(x), 6) AS x FROM (SELECT session_id, cluster_id, unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS pos
    FROM play_history JOIN audio_vectors USING (track_id)) GROUP BY ALL""",
)(
    lambda c: V.centroids(c.play_history().select("session_id", "track_id").join(c.vectors("audio"), "track_id"), ["session_id", "cluster_id"])
    .select("session_id", "cluster_id", F.posexplode("centroid").alias("pos", "x"))
    .select("session_id", "cluster_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))
)
query("a08_fit_zscore", "SELECT pos, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS pos FROM audio_vectors) GROUP BY pos")(
    lambda c: c.vectors("audio").select(F.posexplode("vector").alias("pos", "x")).groupBy(F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"))
)
UNIT = "list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v})))"
query(
    "j12_assign_cluster",
    f"""SELECT track_id, arg_max(cluster_id, (sim, -cluster_id)) AS cluster_id FROM (SELECT track_id, c.cluster_id, round(list_dot_product(v, centroid), 9) AS sim
    FROM (SELECT track_id, {UNIT.format(v="w")} AS v FROM (SELECT a.track_id, list_transform(a.vector, lambda x: x * sqrt(0.3::DOUBLE / 0.7::DOUBLE)) || l.vector AS w FROM audio_vectors a JOIN lyrics_vectors l USING (track_id))),
    (SELECT cluster_id, {UNIT.format(v="w")} AS centroid FROM (SELECT a.cluster_id, list_transform(a.centroid, lambda x: x * sqrt(0.3::DOUBLE / 0.7::DOUBLE)) || l.centroid AS w
      FROM {CENTROIDS.format(kind="audio")} a JOIN {CENTROIDS.format(kind="lyrics")} l USING (cluster_id))) c) GROUP BY track_id""",
)(
    lambda c: V.assign_cluster(
        c.vectors("audio"),
        c.vectors("lyrics"),
        V.centroids(c.vectors("audio"), ["cluster_id"]).select("cluster_id", F.col("centroid").alias("a"))
        .join(V.centroids(c.vectors("lyrics"), ["cluster_id"]).select("cluster_id", F.col("centroid").alias("l")), "cluster_id")
        .select("cluster_id", normalized(weighted_concat(F.col("a"), F.col("l"), (0.3 / 0.7) ** 0.5)).alias("centroid")),
    )
)
query("x01_normalize_l2", "SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS one FROM (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))")(
    lambda c: c.table("embeddings").select("vec_id", normalized(F.transform("embedding", lambda x: x.cast("double"))).alias("v")).select("vec_id", F.round(dot(F.col("v"), F.col("v")), 6).alias("one"))
)
query("x02_cosine", "SELECT a.track_id, round(list_dot_product(a.vector, l.vector[1:16]) / sqrt(list_dot_product(l.vector[1:16], l.vector[1:16])), 6) AS cosine FROM audio_vectors a JOIN lyrics_vectors l USING (track_id)")(
    lambda c: c.vectors("audio").select("track_id", F.col("vector").alias("a")).join(c.vectors("lyrics").select("track_id", F.slice("vector", 1, 16).alias("l")), "track_id").select("track_id", F.round(dot(F.col("a"), F.col("l")) / norm(F.col("l")), 6).alias("cosine"))
)
query("x04_nan_to_zero", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x < 0 THEN 0 ELSE x END)), 6) AS total FROM embeddings")(
    lambda c: c.table("embeddings")
    .select("vec_id", finite(F.transform("embedding", lambda x: F.when(x < 0, F.lit(float("nan"))).otherwise(x.cast("double")))).alias("v"))
    .select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))
)

# --- aggregates ------------------------------------------------------------------------------------------------------------

query("a02_monthly_costs", "SELECT service, round(sum(cost_usd), 2) AS cost_usd FROM api_costs WHERE created_at >= TIMESTAMP '1997-05-01' GROUP BY 1")(lambda c: R.monthly_costs(c.api_costs(), "1997-05-17"))
query("a03_play_counts", "SELECT track_id, play_count + coalesce(n, 0) AS play_count FROM tracks LEFT JOIN (SELECT track_id, count(*) AS n FROM play_history WHERE completed GROUP BY 1) USING (track_id)")(
    lambda c: c.tracks().join(c.play_history().filter("completed").groupBy("track_id").agg(F.count("*").alias("n")), "track_id", "left").select("track_id", (F.col("play_count") + F.coalesce("n", F.lit(0))).alias("play_count"))
)
query("a04_tracks_played", "SELECT participant_id, count(*) AS tracks_played FROM play_history GROUP BY 1")(lambda c: c.play_history().groupBy("participant_id").agg(F.count("*").alias("tracks_played")))
query(
    "a05_next_position",
    """SELECT session_id, arrival, coalesce(last, 0) + row_number() OVER (PARTITION BY session_id ORDER BY arrival) AS order_position
    FROM (SELECT session_id, id AS arrival FROM play_history) LEFT JOIN (SELECT session_id, max(order_position) AS last FROM queue_entries GROUP BY 1) USING (session_id)""",
)(lambda c: R.next_positions(c.queue_entries(), c.play_history().select("session_id", F.col("id").alias("arrival"))))
query("a09_distinct_artists", "SELECT DISTINCT artist FROM tracks WHERE language = 'de'")(lambda c: c.tracks("artist", "language").filter("language = 'de'").select("artist").distinct())
query("a10_covered_clusters", "SELECT DISTINCT session_id, catalog_cluster_id FROM play_history JOIN tracks USING (track_id) WHERE catalog_cluster_id IS NOT NULL")(
    lambda c: c.play_history().join(c.tracks("track_id", "catalog_cluster_id").select("track_id", "catalog_cluster_id"), "track_id").filter("catalog_cluster_id is not null").select("session_id", "catalog_cluster_id").distinct()
)
query("a12_shown_twice", "SELECT session_id, track_id, count(*) AS shown FROM play_history GROUP BY ALL HAVING count(*) >= 2")(
    lambda c: c.play_history().groupBy("session_id", "track_id").agg(F.count("*").alias("shown")).filter("shown >= 2")
)
query("a13_gap_percentile", """SELECT track_id, round(quantile_cont(gap, 0.75), 6) AS gap FROM (SELECT track_id, start - lag("end") OVER (PARTITION BY track_id ORDER BY n) AS gap FROM syllables) WHERE gap IS NOT NULL GROUP BY 1""")(
    lambda c: T.gap_percentile(c.syllables())
)
query("a14_median_gap", """SELECT track_id, round(median(gap), 6) AS median_gap FROM (SELECT track_id, n, start - lag("end") OVER (PARTITION BY track_id ORDER BY n) AS gap FROM syllables) WHERE n > 1 GROUP BY 1""")(
    lambda c: T.median_inner_gap(c.syllables())
)
query("a17_sweep_summary", """SELECT action, count(*) AS n FROM (SELECT CASE WHEN TIMESTAMP '2001-08-02' - created_at >= INTERVAL 86400 SECOND THEN 'fail' ELSE 'republish' END AS action FROM jobs
  WHERE status = 'pending' AND mp3_key IS NOT NULL AND updated_at < TIMESTAMP '2001-08-02' - INTERVAL 600 SECOND) GROUP BY 1""")(lambda c: R.sweep(c.jobs(), "2001-08-02").groupBy("action").agg(F.count("*").alias("n")))
query("a20_catalog_counts", "SELECT count(*) AS rows, count(*) FILTER (status <> 'ready') AS skipped, count(*) FILTER (rec_cluster_id IS NULL) AS missing, count(mp3_key) AS with_key FROM tracks")(
    lambda c: c.tracks("status", "rec_cluster_id", "mp3_key").agg(F.count("*").alias("rows"), F.count(F.when(F.col("status") != "ready", 1)).alias("skipped"), F.count(F.when(F.col("rec_cluster_id").isNull(), 1)).alias("missing"), F.count("mp3_key").alias("with_key"))
)

# --- windows ---------------------------------------------------------------------------------------------------------------

query("w01_current_entry", f"SELECT session_id, id, status, order_position FROM {CURRENT}")(lambda c: R.current_entry(c.queue_entries()).select("session_id", "id", "status", "order_position"))
query("w02_queue_split", "SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY order_position, id) = 1 AS is_current FROM queue_entries WHERE status IN ('playing', 'queued')")(
    lambda c: R.queue_split(c.queue_entries()).select("session_id", "id", "is_current")
)
query("w03_claim_order", "SELECT id, priority FROM jobs WHERE status = 'pending' ORDER BY priority DESC, created_at, id LIMIT 25")(
    lambda c: c.jobs().filter("status = 'pending'").orderBy(F.desc("priority"), "created_at", "id").limit(25).select("id", "priority")
)
query("w04_gaps", """SELECT track_id, n, round(start - lag("end") OVER (PARTITION BY track_id ORDER BY n), 6) AS gap FROM syllables""")(lambda c: T.gaps(c.syllables()).select("track_id", "n", F.round("gap", 6).alias("gap")))
query("w07_first_per_key", "SELECT track_id FROM (SELECT track_id, row_number() OVER (PARTITION BY lower(trim(artist)), lower(trim(title)) ORDER BY track_id) AS k FROM tracks) WHERE k = 1")(
    lambda c: R.first_by(c.tracks().withColumn("a", F.lower(F.trim("artist"))).withColumn("t", F.lower(F.trim("title"))), ["a", "t"], "track_id").select("track_id")
)
query("w09_one_per_cluster", "SELECT tag_id, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY md5('7:' || tag_id), tag_id) AS k FROM mood_tags) WHERE k = 1 ORDER BY md5('7:' || tag_id), tag_id LIMIT 6")(
    lambda c: R.one_tag_per_cluster(c.mood_tags(), 6, 7).select("tag_id", "cluster_id")
)
LINES = """(SELECT track_id, line, min(start) AS start, max("end") AS "end", count(*) AS n_syllables FROM (SELECT *, sum(CASE WHEN gap > 1.0 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY n) AS line
  FROM (SELECT *, start - lag("end") OVER (PARTITION BY track_id ORDER BY n) AS gap FROM syllables)) GROUP BY ALL)"""
query("w12_line_ids", f"""SELECT track_id, line::BIGINT AS line, round(start, 6) AS start, round("end", 6) AS "end", n_syllables FROM {LINES}""")(
    lambda c: T.lines(c.syllables()).select("track_id", "line", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "n_syllables")
)
query("x25_gap_intervals", f"""SELECT track_id, round(before, 6) AS start, round(start, 6) AS "end" FROM (SELECT *, coalesce(lag("end") OVER (PARTITION BY track_id ORDER BY line), 0) AS before FROM {LINES})
  WHERE (line = 0 AND start > 0.1) OR (line > 0 AND start - before >= 5)""")(lambda c: T.gap_intervals(c.syllables()).select("track_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end")))
query("w10_islands", """SELECT track_id, min(n) AS first_n, max(n) AS last_n, count(*) AS length FROM (SELECT track_id, n, n - row_number() OVER (PARTITION BY track_id ORDER BY n) AS run FROM syllables WHERE syllable LIKE ' %') GROUP BY track_id, run""")(
    lambda c: T.islands(c.syllables(), "syllable LIKE ' %'")
)
query("w11_silent_runs", """SELECT track_id, min(a) AS first_n FROM (SELECT track_id, min(n) AS a, count(*) AS c FROM (SELECT track_id, n, n - row_number() OVER (PARTITION BY track_id ORDER BY n) AS run FROM syllables WHERE syllable NOT LIKE ' %') GROUP BY track_id, run) WHERE c >= 2 GROUP BY 1""")(
    lambda c: T.first_silent_run(c.syllables(), "syllable LIKE ' %'", 2)
)
query("w15_cumulative_time", """SELECT track_id, n, round(s + (e - s) * sum(length(syllable)) OVER (PARTITION BY track_id, word ORDER BY n) / sum(length(syllable)) OVER (PARTITION BY track_id, word), 6) AS part_end
  FROM (SELECT *, n // 4 AS word, min(start) OVER (PARTITION BY track_id, n // 4) AS s, max("end") OVER (PARTITION BY track_id, n // 4) AS e FROM syllables)""")(
    lambda c: T.cumulative_times(
        c.syllables().withColumn("word", F.floor(F.col("n") / 4)).withColumn("s", F.min("start").over(W.Window.partitionBy("track_id", "word"))).withColumn("e", F.max("end").over(W.Window.partitionBy("track_id", "word")))
        .select("track_id", "word", "n", F.col("syllable").alias("text"), F.col("s").alias("start"), F.col("e").alias("end")), 6
    ).select("track_id", "n", "part_end")
)
query("w18_slot_share", """SELECT session_id, cluster_id, rn, slots::BIGINT AS slots FROM (SELECT *, 20 // n + CASE WHEN rn <= 20 % n THEN 1 ELSE 0 END AS slots FROM
  (SELECT session_id, cluster_id, row_number() OVER (PARTITION BY session_id ORDER BY f, cluster_id) AS rn, count(*) OVER (PARTITION BY session_id) AS n
   FROM (SELECT session_id, rec_cluster_id AS cluster_id, min(played_at) AS f FROM play_history JOIN tracks USING (track_id) WHERE rec_cluster_id IS NOT NULL GROUP BY ALL))) WHERE slots > 0""")(
    lambda c: R.slot_share(
        c.play_history().join(c.tracks("track_id", "rec_cluster_id").select("track_id", F.col("rec_cluster_id").alias("cluster_id")), "track_id").filter("cluster_id is not null").groupBy("session_id", "cluster_id").agg(F.min("played_at").alias("first_played")), 20
    )
)
query("j16_line_at", f"""SELECT track_id, t, coalesce((SELECT max(line) FROM {LINES} l WHERE l.track_id = q.track_id AND l.start <= q.t), 0)::BIGINT AS line FROM (SELECT DISTINCT track_id, n * 1.7::DOUBLE AS t FROM syllables) q""")(
    lambda c: T.line_at(T.lines(c.syllables()), c.syllables().select("track_id", (F.col("n") * 1.7).alias("t"))).select("track_id", "t", "line")
)

# --- ranked lists and sets ---------------------------------------------------------------------------------------------------

query("t01_list_popular", "SELECT track_id, play_count FROM tracks WHERE status = 'ready' AND popularity_category IN ('eternal_hit', 'current_hit') ORDER BY play_count DESC, md5('3:' || track_id), track_id LIMIT 30")(
    lambda c: R.popular(c.tracks(), 30, 3, ("eternal_hit", "current_hit")).select("track_id", "play_count")
)
query("t02_list_random", "SELECT track_id FROM tracks WHERE status = 'ready' ORDER BY md5('5:' || track_id), track_id LIMIT 30")(lambda c: R.random_tracks(c.tracks(), 30, 5).select("track_id"))
TIER = "CASE popularity_category WHEN 'eternal_hit' THEN 0 WHEN 'current_hit' THEN 1 WHEN 'artist_best' THEN 2 WHEN 'former_hit' THEN 3 ELSE 4 END"
query("t03_tracks_by_cluster", f"SELECT track_id, popularity_category FROM tracks WHERE status = 'ready' AND rec_cluster_id = 2 AND track_id NOT IN (2, 12) ORDER BY {TIER}, md5('9:' || track_id), track_id LIMIT 20")(
    lambda c: R.tracks_by_cluster(c.tracks(), 2, [2, 12], 20, 9).select("track_id", "popularity_category")
)
query("t04_popular_mix", """SELECT track_id FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY part, pos) AS k FROM (
  SELECT track_id, language, 0 AS part, row_number() OVER (ORDER BY play_count DESC, md5('11:' || track_id), track_id) AS pos FROM tracks WHERE status = 'ready' AND popularity_category IN ('eternal_hit', 'current_hit', 'artist_best') QUALIFY pos <= 28
  UNION ALL SELECT track_id, language, 1, row_number() OVER (ORDER BY md5('12:' || track_id), track_id) AS pos FROM tracks WHERE status = 'ready' QUALIFY pos <= 40)
  WHERE language = 'en') WHERE k = 1 ORDER BY part, pos LIMIT 40""")(lambda c: R.popular_mix(c.tracks(), 40, 11, "en").select("track_id"))
query("t06_rerank_mood", f"""SELECT query_id, track_id, tier, round(score, 6) AS score FROM (SELECT *, CASE WHEN popularity_category IN ('eternal_hit', 'current_hit', 'artist_best') THEN 0 WHEN rec_cluster_id IN (1, 2) THEN 1 ELSE 2 END AS tier
  FROM {NEAR.format(kind="lyrics", on="true", k=50)} JOIN tracks USING (track_id) WHERE query_id = 0) ORDER BY tier, score DESC, track_id LIMIT 15""")(
    lambda c: R.rerank_mood(V.nearest(_queries(c, "lyrics"), c.vectors("lyrics"), 50).filter("query_id = 0").join(c.tracks("track_id", "popularity_category", "rec_cluster_id").select("track_id", "popularity_category", "rec_cluster_id"), "track_id"), [1, 2], 15).select(
        "query_id", "track_id", "tier", F.round("score", 6).alias("score")
    )
)
query("t09_artist_dedup", "SELECT track_id, artist FROM (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY play_count DESC, track_id) AS k FROM tracks WHERE status = 'ready') WHERE k = 1 ORDER BY play_count DESC, track_id LIMIT 15")(
    lambda c: R.artist_once(R.ready(c.tracks()).withColumn("rank", F.struct((-F.col("play_count")).alias("p"), "track_id")), 15).select("track_id", "artist")
)
query("t12_page", "SELECT track_id FROM tracks WHERE status = 'ready' ORDER BY play_count DESC, track_id LIMIT 20 OFFSET 40")(lambda c: R.ready(c.tracks()).orderBy(F.desc("play_count"), "track_id").offset(40).limit(20).select("track_id"))
query("t13_recent_history", "SELECT participant_id, id FROM (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY played_at DESC, id DESC) AS k FROM play_history) WHERE k <= 3")(
    lambda c: c.play_history().withColumn("k", F.row_number().over(R.by("participant_id").orderBy(F.desc("played_at"), F.desc("id")))).filter("k <= 3").select("participant_id", "id")
)
query("t14_tags_excluding", "SELECT tag_id, name FROM mood_tags WHERE cluster_id NOT IN (0, 1, 2) ORDER BY md5('4:' || tag_id), tag_id LIMIT 8")(
    lambda c: R.filter_not_in(c.mood_tags(), "cluster_id", [0, 1, 2]).orderBy(R.shuffled(4, "tag_id"), "tag_id").limit(8).select("tag_id", "name")
)
query("u01_union_candidates", "SELECT item_id AS id, length(text) AS n FROM benchmark UNION ALL SELECT doc_id, length(text) FROM documents")(
    lambda c: c.table("benchmark").select(F.col("item_id").alias("id"), F.length("text").cast("long").alias("n")).unionByName(c.table("documents").select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n")))
)
query("u03_q11_mood_tags", f"""SELECT session_id, tag_id, cluster_id FROM (SELECT s.session_id, m.tag_id, m.cluster_id, row_number() OVER (PARTITION BY s.session_id ORDER BY md5('6:' || s.session_id || ':' || tag_id), tag_id) AS k
  FROM (SELECT DISTINCT session_id FROM queue_entries) s, (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY md5('6:' || tag_id), tag_id) AS r FROM mood_tags) WHERE r = 1) m
  WHERE NOT EXISTS (SELECT 1 FROM {PROFILE} p WHERE p.session_id = s.session_id AND list_contains(p.clusters, m.cluster_id))) WHERE k <= 5""")(
    lambda c: R.mood_tags_for(c.queue_entries().select("session_id").distinct(), R.played_profile(c.play_history(), c.tracks()), c.mood_tags(), 5, 6).select("session_id", "tag_id", "cluster_id")
)
query("k01_upsert_points", "SELECT track_id, CASE WHEN track_id % 3 = 0 THEN 'new' ELSE artist END AS artist FROM tracks")(
    lambda c: R.upsert(c.tracks("track_id", "artist").select("track_id", "artist"), c.tracks("track_id", "artist").filter("track_id % 3 = 0").select("track_id", F.explode(F.array(F.lit("old"), F.lit("new"))).alias("artist")).withColumn("seq", F.when(F.col("artist") == "new", 2).otherwise(1).cast("long")), "track_id")
)
query("k02_delete_points", "SELECT track_id FROM audio_vectors WHERE track_id NOT IN (SELECT track_id FROM play_history)")(lambda c: c.vectors("audio").select("track_id").join(c.play_history().select("track_id").distinct(), "track_id", "left_anti"))
query("z07_sweep", """SELECT id, CASE WHEN TIMESTAMP '2001-08-02' - created_at >= INTERVAL 86400 SECOND THEN 'fail' ELSE 'republish' END AS action FROM jobs
  WHERE status = 'pending' AND mp3_key IS NOT NULL AND updated_at < TIMESTAMP '2001-08-02' - INTERVAL 600 SECOND""")(lambda c: R.sweep(c.jobs(), "2001-08-02"))
query("z09_reset_stale_running", """SELECT id, CASE WHEN status = 'running' AND locked_by = 'w1' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'running' AND locked_by = 'w1' THEN NULL ELSE locked_by END AS locked_by FROM jobs""")(
    lambda c: R.reset_stale(c.jobs(), "w1").select("id", "status", "locked_by")
)
query("z03_emit_on_change", "SELECT id FROM (SELECT *, lag(step) OVER w AS s, lag(progress) OVER w AS p FROM progress WINDOW w AS (PARTITION BY job_id ORDER BY ts, id)) WHERE s IS NULL OR s <> step OR p <> progress")(
    lambda c: c.progress().withColumn("s", F.lag("step").over(R.by("job_id").orderBy("ts", "id"))).withColumn("p", F.lag("progress").over(R.by("job_id").orderBy("ts", "id"))).filter("s is null or s <> step or p <> progress").select("id")
)
query("z02_progress_latest", "SELECT job_id, arg_max(step, (ts, id)) AS step, arg_max(progress, (ts, id)) AS progress, arg_max(status, (ts, id)) AS status FROM progress GROUP BY 1")(
    lambda c: c.progress().groupBy("job_id").agg(F.max_by(F.struct("step", "progress", "status"), F.struct("ts", "id")).alias("x")).select("job_id", "x.*")
)


@query(
    "x03_zscore_l2",
    """, m AS (SELECT list(mean ORDER BY pos) AS means, list(std ORDER BY pos) AS stds FROM (SELECT pos, avg(x) AS mean, stddev_pop(x) AS std FROM (SELECT unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM audio_vectors) GROUP BY pos)),
    z AS (SELECT track_id, list_transform(list_zip(vector, means, stds), lambda p: (p[1] - p[2]) / p[3]) AS v FROM audio_vectors, m)
    SELECT track_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[16] / sqrt(list_dot_product(v, v)), 6) AS last FROM z""",
)
def _zscore(c: Catalog) -> DataFrame:
    stats = c.vectors("audio").select(F.posexplode("vector").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    one = stats.agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias("s")).select(F.transform("s", lambda x: x["mean"]).alias("means"), F.transform("s", lambda x: x["std"]).alias("stds"), F.lit(1).alias("_one"))
    v = c.vectors("audio").withColumn("_one", F.lit(1)).join(one, "_one").select("track_id", normalized(zscore(F.col("vector"), F.col("means"), F.col("stds"))).alias("v"))
    return v.select("track_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"))
