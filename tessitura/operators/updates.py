"""Table updates as new tables: joins of the old rows with what changes. Plain Parquet has no merge; the result is written elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import by, first_by


def set_payload(points: DataFrame, fields: DataFrame, key: str) -> DataFrame:
    """payload: a map column. New values win, other fields stay; points without new fields stay as they are."""
    new = fields.select(key, F.col("payload").alias("_new"))
    kept = F.map_filter("payload", lambda k, v: ~F.map_contains_key(F.col("_new"), k))
    return points.join(new, key, "left").withColumn("payload", F.when(F.col("_new").isNull(), F.col("payload")).otherwise(F.map_concat(kept, "_new"))).drop("_new")


def upsert_artist(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """name, image, source, created_at, updated_at. A known artist keeps created_at."""
    n = new.select("name", F.col("image").alias("_image"), F.col("source").alias("_source"), F.lit(True).alias("_hit"))
    j = old.join(n, "name", "full_outer")
    hit = F.coalesce("_hit", F.lit(False))
    return j.select(
        "name", F.when(hit, F.col("_image")).otherwise(F.col("image")).alias("image"), F.when(hit, F.col("_source")).otherwise(F.col("source")).alias("source"),
        F.coalesce("created_at", now).alias("created_at"), F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def index_points(tracks: DataFrame, assigned: DataFrame) -> DataFrame:
    """The payload that both vector tables get for each assigned track."""
    return tracks.join(assigned.select("track_id", F.col("cluster_id").alias("rec")), "track_id").select(
        "track_id", F.lit("ready").alias("status"), F.col("rec").alias("rec_cluster_id"), F.col("rec").alias("catalog_cluster_id"), F.coalesce("popularity_category", F.lit("regular")).alias("popularity_category")
    )


def with_defaults(rows: DataFrame, defaults: dict) -> DataFrame:
    """Nulls and missing columns get their defaults."""
    return rows.select(*rows.columns, *(F.lit(None).alias(c) for c in defaults if c not in rows.columns)).select(
        *(c for c in rows.columns if c not in defaults), *(F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items())
    )


def finish_play(entries: DataFrame, finished: DataFrame) -> DataFrame:
    """finished: id. Those entries become done; is_next marks each session's next one."""
    done = finished.select("id", F.lit(True).alias("_done"))
    rows = entries.join(done, "id", "left").withColumn("status", F.when(F.col("_done"), "done").otherwise(F.col("status"))).drop("_done")
    live = F.col("status").isin("playing", "queued")
    order = by("session_id").orderBy(F.when(F.col("status") == "playing", 0).when(live, 1).otherwise(2), "order_position", "id")
    return rows.withColumn("is_next", live & (F.row_number().over(order) == 1))


def skip_turn(entries: DataFrame, skipped: DataFrame) -> DataFrame:
    """skipped: id. Those rows are marked; a copy of each goes behind its session's last, in their order."""
    mark = skipped.select("id", F.lit(True).alias("_skip"))
    rows = entries.join(mark, "id", "left")
    old = rows.withColumn("status", F.when(F.col("_skip"), "skipped").otherwise(F.col("status"))).drop("_skip")
    last = entries.groupBy("session_id").agg(F.max("order_position").alias("_last"))
    rn = F.row_number().over(by("session_id").orderBy("order_position", "id"))
    copies = rows.filter("_skip").drop("_skip").join(last, "session_id").withColumn("order_position", (F.col("_last") + rn).cast("int")).drop("_last").withColumn("status", F.lit("queued"))
    return old.withColumn("is_copy", F.lit(False)).unionByName(copies.withColumn("is_copy", F.lit(True)))


def set_status(entries: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """changes: id, new_status. playing sets started_at, done and skipped set finished_at."""
    j = entries.join(changes, "id", "left")
    s = F.col("new_status")
    return j.select(
        *entries.drop("status").columns, F.coalesce(s, "status").alias("status"), F.when(s == "playing", now).alias("started_at"), F.when(s.isin("done", "skipped"), now).alias("finished_at")
    )


def clear_clusters(tracks: DataFrame) -> DataFrame:
    return tracks.withColumns({c: F.lit(None).cast(tracks.schema[c].dataType) for c in ("rec_cluster_id", "catalog_cluster_id")})


def indexed_to_tracks(tracks: DataFrame, messages: DataFrame) -> DataFrame:
    """messages: track_id, cluster_id, seq; the last of each track counts; a null cluster leaves the old one."""
    last = first_by(messages, ["track_id"], F.desc("seq")).select("track_id", F.col("cluster_id").alias("_c"), F.lit(True).alias("_hit"))
    return tracks.join(last, "track_id", "left").withColumn("rec_cluster_id", F.coalesce("_c", "rec_cluster_id")).withColumn("synced", F.coalesce("_hit", F.lit(False))).drop("_c", "_hit")


def job_results(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """results: id, result, error_message. An error fails a job, anything else completes it; both clear the lock."""
    r = results.select("id", F.col("result").alias("_r"), F.col("error_message").alias("_e"), F.lit(True).alias("_hit"))
    j = jobs.join(r, "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    status = F.when(hit & F.col("_e").isNotNull(), "failed").when(hit, "completed").otherwise(F.col("status"))
    return j.withColumn("status", status).withColumn("locked_by", F.when(~hit, F.col("locked_by"))).withColumnRenamed("_r", "result").withColumnRenamed("_e", "error_message").drop("_hit")


def unexpired(dead: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    return dead.filter(F.col("ts") > now - F.expr(f"INTERVAL {hours} HOURS"))


def validated(rows: DataFrame, types: dict[str, str], allowed: dict[str, tuple]) -> DataFrame:
    """Adds `error`: the first column whose text isn't of its type, or whose value isn't one of those allowed; null where all are
    right. types: column to type name; a null is of every type."""
    error = F.lit(None).cast("string")
    for name, kind in reversed(types.items()):
        error = F.when(F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull(), F.lit(name)).otherwise(error)
    for name, values in reversed(allowed.items()):
        error = F.when(~F.col(name).isin(*values), F.lit(name)).otherwise(error)
    return rows.withColumn("error", error)
