"""The music catalog's tables as views over the given Parquet tables; BIND holds the same definitions as SQL for the oracles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..functions.vectors import normalized

NOW_JOBS = "2001-08-02"
#: Popularity tiers by p_size % 5.
TIERS = ("eternal_hit", "current_hit", "former_hit", "artist_best", "regular")


#: Events of a task that makes frames of them.
EVENTS = 1 << 15


@dataclass
class Catalog:
    """Each method is one domain table; only the columns that a query uses are read."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def tracks(self, *columns: str) -> DataFrame:
        """The columns named, or all; a table that none of them comes from is neither read nor joined."""
        rows, k = self.table("part"), F.col("p_partkey")
        made = {
            "track_id": k, "artist": F.col("p_brand"), "title": F.col("p_name"), "duration_sec": F.col("p_size") * 4 + 120,
            "language": F.col("lang"), "lyrics_text": F.col("text"),
            "status": F.when(k % 10 == 0, "processing").when((k % 10 == 1) & (F.col("p_size") > 45), "error").otherwise("ready"),
            "popularity_category": F.element_at(F.array(*map(F.lit, TIERS)), F.col("p_size") % 5 + 1), "play_count": F.coalesce("plays", F.lit(0)),
            "rec_cluster_id": F.col("label"), "catalog_cluster_id": F.col("label"),
            "lyrics_source": F.when(F.col("p_size") % 7 == 0, "asr_fallback").otherwise(F.col("source")),
            "mp3_key": F.when(k % 13 != 0, F.concat(F.lit("instrumentals/"), k.cast("string"), F.lit(".mp3"))),
        }
        wanted = columns or tuple(made)
        of_texts = [x for c, x in (("language", "lang"), ("lyrics_text", "text"), ("lyrics_source", "source")) if c in wanted]
        if of_texts:
            rows = rows.join(self.table("documents").select(F.col("doc_id").alias("p_partkey"), *of_texts), "p_partkey", "left")
        if {"rec_cluster_id", "catalog_cluster_id"} & set(wanted):
            rows = rows.join(self.table("embeddings").select(F.col("vec_id").alias("p_partkey"), "label"), "p_partkey", "left")
        if "play_count" in wanted:
            rows = rows.join(self.table("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("plays")), "p_partkey", "left")
        return rows.select(*(made[c].alias(c) for c in wanted))

    def vectors(self, kind: str) -> DataFrame:
        """audio: positions 1 to 16 of an embedding, lyrics: 17 to 64, unit length."""
        start, size = {"audio": (1, 16), "lyrics": (17, 48)}[kind]
        part = F.transform(F.slice("embedding", start, size), lambda x: x.cast("double"))
        return (
            self.table("embeddings")
            .join(self.table("part").select(F.col("p_partkey").alias("vec_id")), "vec_id", "left_semi")
            .select(F.col("vec_id").alias("track_id"), F.col("label").alias("cluster_id"), normalized(part).alias("vector"))
        )

    def mood_tags(self) -> DataFrame:
        one = self.table("embeddings").select("label").distinct()
        return one.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("j"), "label").select(
            (2 * F.col("label") + F.col("j")).alias("tag_id"), F.concat_ws("_", F.lit("tag"), "label", "j").alias("name"), F.col("label").alias("cluster_id")
        )

    def artists(self) -> DataFrame:
        n = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
        return self.table("part").select(F.col("p_brand").alias("name"), n.alias("n")).distinct().filter("n % 5 <> 0").select("name", F.when(F.col("n") % 3 != 0, F.concat(F.lit("artists/"), "n", F.lit(".jpg"))).alias("image_path"))

    def play_history(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        return self.table("events").filter("event_type = 'view'").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), (10 * F.col("user_id") + F.col("event_id") % 3).alias("participant_id"),
            k.alias("track_id"), F.col("ts").alias("played_at"), (F.col("value") > 5).alias("completed"),
        )

    def queue_entries(self) -> DataFrame:
        o = self.table("orders")
        status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "playing").otherwise("done")
        position = F.row_number().over(W.Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
        return o.select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"), (10 * F.col("o_custkey") + F.col("o_orderkey") % 3).alias("participant_id"),
            (F.col("o_orderkey") % 200).alias("track_id"), status.alias("status"), position.alias("order_position"),
        )

    def jobs(self) -> DataFrame:
        k = F.col("o_orderkey")
        status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
        return self.table("orders").select(
            k.alias("id"), status.alias("status"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
            F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.make_dt_interval(hours=(k % 48).cast("int"))).alias("updated_at"),
            F.when(k % 5 != 0, F.concat(F.lit("uploads/"), k.cast("string"), F.lit(".mp3"))).alias("mp3_key"),
            F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("w"), (F.col("o_custkey") % 4).cast("string"))).alias("locked_by"),
            F.when(k % 4 != 0, F.concat(F.lit("artist "), (F.col("o_custkey") % 50).cast("string"))).alias("artist_hint"),
        )

    def api_costs(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_returnflag").alias("service"), (F.col("l_extendedprice") * F.col("l_discount")).alias("cost_usd"), F.col("l_shipdate").alias("created_at"))

    def progress(self) -> DataFrame:
        status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("running")
        return self.table("events").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), status.alias("status"), F.col("event_type").alias("step"),
            F.get_json_object("props", "$.k").cast("long").alias("progress"), F.col("ts").cast(T.TimestampType()).alias("ts"),
        )

    def syllables(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        n = F.row_number().over(W.Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
        start = F.col("n") * 0.25 + (F.col("k") % 7) * 0.03 + 1.5 * F.floor(F.col("n") / 9) + 5 * F.floor(F.col("n") / 27)
        rows = self.table("events").select(F.col("user_id").alias("track_id"), n.alias("n"), k.alias("k"), "event_type")
        return rows.select("track_id", "n", F.when(F.col("k") % 3 != 0, F.concat(F.lit(" "), "event_type")).otherwise(F.col("event_type")).alias("syllable"), start.alias("start"), (start + 0.05).alias("end"))

    def rms_frames(self) -> DataFrame:
        """Frames by n: from each event's base to the next one's, loud for the first eight."""
        k = F.get_json_object("props", "$.k").cast("long")
        order = W.Window.partitionBy("user_id").orderBy("ts", "event_id")
        pause = F.when(F.col("k") % 10 == 0, 30).when(F.col("k") % 10 == 5, 12).otherwise(0)
        # An event becomes some ten frames in the task that holds its track: tasks follow the rows, not the bytes of the events.
        events = self.table("events").select("user_id", "event_id", "ts", k.alias("k"))
        events = events.repartition(max(1, -(-events.count() // EVENTS)), "user_id")
        e = events.withColumn("base", 5 * (F.row_number().over(order) - 1) + F.sum(pause).over(order))
        e = e.withColumn("next", F.coalesce(F.lead("base").over(order), F.col("base") + 5))
        f = e.select(F.col("user_id").alias("track_id"), "event_id", "k", "base", "next", F.explode(F.sequence("base", F.col("next") - 1)).alias("n"))
        loud = (F.col("n") - F.col("base") < 8) | ((F.col("event_id") % 2 == 1) & (F.col("next") - F.col("n") <= 4))
        return f.select("track_id", "n", F.when(loud, 0.5 + F.col("k") / 200).otherwise(0.01).alias("rms"))


BIND = """
WITH tracks AS (
  SELECT p_partkey AS track_id, p_brand AS artist, p_name AS title, 120 + 4 * p_size AS duration_sec, lang AS language, text AS lyrics_text,
         CASE WHEN p_partkey % 10 = 0 THEN 'processing' WHEN p_partkey % 10 = 1 AND p_size > 45 THEN 'error' ELSE 'ready' END AS status,
         ['eternal_hit', 'current_hit', 'former_hit', 'artist_best', 'regular'][p_size % 5 + 1] AS popularity_category,
         coalesce(n, 0) AS play_count, label AS rec_cluster_id, label AS catalog_cluster_id,
         CASE WHEN p_size % 7 = 0 THEN 'asr_fallback' ELSE source END AS lyrics_source,
         CASE WHEN p_partkey % 13 <> 0 THEN 'instrumentals/' || p_partkey || '.mp3' END AS mp3_key
  FROM part LEFT JOIN documents ON doc_id = p_partkey LEFT JOIN embeddings ON vec_id = p_partkey
  LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
audio AS (SELECT vec_id AS track_id, label AS cluster_id, embedding[1:16]::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT p_partkey FROM part)),
lyrics AS (SELECT vec_id AS track_id, label AS cluster_id, embedding[17:64]::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT p_partkey FROM part)),
audio_vectors AS (SELECT track_id, cluster_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS vector FROM audio),
lyrics_vectors AS (SELECT track_id, cluster_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS vector FROM lyrics),
mood_tags AS (SELECT 2 * label + j AS tag_id, 'tag_' || label || '_' || j AS name, label AS cluster_id FROM (SELECT DISTINCT label FROM embeddings), (SELECT unnest([0, 1]) AS j)),
artists AS (SELECT p_brand AS name, CASE WHEN n % 3 <> 0 THEN 'artists/' || n || '.jpg' END AS image_path
  FROM (SELECT DISTINCT p_brand, regexp_extract(p_brand, '(\\d+)$', 1)::INT AS n FROM part) WHERE n % 5 <> 0),
play_history AS (SELECT event_id AS id, user_id AS session_id, 10 * user_id + event_id % 3 AS participant_id, (props::JSON ->> '$.k')::BIGINT AS track_id,
  ts AS played_at, value > 5 AS completed FROM events WHERE event_type = 'view'),
queue_entries AS (SELECT o_orderkey AS id, o_custkey AS session_id, 10 * o_custkey + o_orderkey % 3 AS participant_id, o_orderkey % 200 AS track_id,
  CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'playing' ELSE 'done' END AS status,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS order_position FROM orders),
jobs AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'completed' END AS status,
  6 - o_orderpriority[1]::INT AS priority, o_orderdate AS created_at, o_orderdate + to_hours((o_orderkey % 48)::INT) AS updated_at,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'uploads/' || o_orderkey || '.mp3' END AS mp3_key,
  CASE WHEN o_orderstatus = 'P' THEN 'w' || (o_custkey % 4) END AS locked_by,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'artist ' || (o_custkey % 50) END AS artist_hint FROM orders),
api_costs AS (SELECT l_returnflag AS service, l_extendedprice * l_discount AS cost_usd, l_shipdate AS created_at FROM lineitem),
progress AS (SELECT event_id AS id, user_id AS job_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'running' END AS status,
  event_type AS step, (props::JSON ->> '$.k')::BIGINT AS progress, ts FROM events),
syl AS (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, (props::JSON ->> '$.k')::BIGINT AS k, event_type FROM events),
syllables AS (SELECT track_id, n, CASE WHEN k % 3 <> 0 THEN ' ' || event_type ELSE event_type END AS syllable,
  n * 0.25::DOUBLE + (k % 7) * 0.03::DOUBLE + 1.5::DOUBLE * floor(n / 9) + 5 * floor(n / 27) AS start,
  n * 0.25::DOUBLE + (k % 7) * 0.03::DOUBLE + 1.5::DOUBLE * floor(n / 9) + 5 * floor(n / 27) + 0.05::DOUBLE AS "end" FROM syl),
ev AS (SELECT user_id AS track_id, event_id, ts, (props::JSON ->> '$.k')::BIGINT AS k FROM events),
eb AS (SELECT *, 5 * (row_number() OVER w - 1) + (sum(CASE WHEN k % 10 = 0 THEN 30 WHEN k % 10 = 5 THEN 12 ELSE 0 END) OVER w)::BIGINT AS base FROM ev WINDOW w AS (PARTITION BY track_id ORDER BY ts, event_id)),
en AS (SELECT *, coalesce(lead(base) OVER (PARTITION BY track_id ORDER BY ts, event_id), base + 5) AS nxt FROM eb),
rms_frames AS (SELECT track_id, n, CASE WHEN n - base < 8 OR (event_id % 2 = 1 AND nxt - n <= 4) THEN 0.5::DOUBLE + k / 200 ELSE 0.01::DOUBLE END AS rms FROM (SELECT *, unnest(range(base, nxt)) AS n FROM en))
"""
