"""Filters, joins, aggregates, windows, ranked lists and set operations of the catalog.

Random order is md5 of a seed and the id, so that every run and every engine gives the same order. Lists end with the id.
Small sides aren't broadcast by hint: adaptive execution does that where their measured size allows it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

HITS = ("eternal_hit", "current_hit", "artist_best")


def by(*keys: str):
    return W.Window.partitionBy(*keys)


def shuffled(seed: int | str, col: str = "track_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(col).cast("string")))


def ready(tracks: DataFrame) -> DataFrame:
    return tracks.filter(F.col("status") == "ready")


def filter_payload(rows: DataFrame, wanted: dict) -> DataFrame:
    """Equality with every given value; none given: all rows."""
    return rows.filter(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in wanted.items()], F.lit(True)))


def filter_not_in(rows: DataFrame, col: str, values: list) -> DataFrame:
    """An empty list excludes nothing; null never equals a value and stays."""
    return rows.filter(F.col(col).isNull() | ~F.col(col).isin(values)) if values else rows


def filter_optional(rows: DataFrame, col: str, value) -> DataFrame:
    return rows if value is None else rows.filter(F.col(col) == F.lit(value))


def suggest(tracks: DataFrame, q: str, limit: int) -> DataFrame:
    """Distinct "artist — title" of ready tracks that hold q, whatever its case; an empty q gives none."""
    if not q.strip():
        return tracks.select(F.lit("").alias("suggestion")).limit(0)
    like = lambda c: F.lower(c).contains(q.lower())
    hits = ready(tracks).filter(like("artist") | like("title")).select("artist", "title").distinct()
    return hits.orderBy("artist", "title").limit(limit).select(F.concat_ws(" — ", "artist", "title").alias("suggestion"))


def missing_images(tracks: DataFrame, artists: DataFrame) -> DataFrame:
    return ready(tracks).select(F.col("artist").alias("name")).distinct().join(artists, "name", "left").filter("image_path is null").select("name")


def with_image(rows: DataFrame, artists: DataFrame, prefix: str = "https://media/") -> DataFrame:
    url = F.when(F.col("image_path").isNotNull() & (F.col("image_path") != ""), F.concat(F.lit(prefix), "image_path"))
    return rows.join(artists.select(F.col("name").alias("artist"), "image_path"), "artist", "left").withColumn("image_url", url).drop("image_path")


def active_uploads(jobs: DataFrame) -> DataFrame:
    live = jobs.filter(F.col("mp3_key").isNotNull() & F.col("status").isin("pending", "running"))
    return live.select("id", "status", F.coalesce("artist_hint", F.lit("Unknown")).alias("artist"), "created_at")


def stale_pending(jobs: DataFrame, now: str, ttl_seconds: int) -> DataFrame:
    before = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(ttl_seconds))
    return jobs.filter((F.col("status") == "pending") & F.col("mp3_key").isNotNull() & (F.col("updated_at") < before))


def partial_update(rows: DataFrame, patch: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Only values of the patch that aren't null overwrite."""
    p = patch.select(key, *(F.col(c).alias(f"_{c}") for c in cols))
    return rows.join(p, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in cols else c for c in rows.columns))


def object_key(name: Column) -> Column:
    return F.concat(F.lit("instrumentals/"), F.regexp_replace(F.split_part(name, F.lit("_("), F.lit(1)), r"\.mp3$", ""), F.lit(".mp3"))


def safe_filename(artist: Column, title: Column) -> Column:
    name = F.regexp_replace(F.concat(artist, F.lit(" - "), title), r'[\\/*?:"<>|]', "_")
    name = F.concat(F.regexp_replace(name, r"^[. ]+|[. ]+$", ""), F.lit(".mp3"))
    return F.when(F.octet_length(name) > 250, F.concat(F.left(name, F.lit(80)), F.lit("….mp3"))).otherwise(name)


def first_by(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_rn", F.row_number().over(by(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def current_entry(entries: DataFrame) -> DataFrame:
    live = entries.filter(F.col("status").isin("playing", "queued"))
    return first_by(live, ["session_id"], F.when(F.col("status") == "playing", 0).otherwise(1), "order_position", "id")


def queue_split(entries: DataFrame) -> DataFrame:
    rn = F.row_number().over(by("session_id").orderBy("order_position", "id"))
    return entries.filter(F.col("status").isin("playing", "queued")).withColumn("is_current", rn == 1)


def next_positions(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Positions behind the last one of each session, in order of arrival. new: session_id, arrival."""
    last = entries.groupBy("session_id").agg(F.max("order_position").alias("last"))
    rn = F.row_number().over(by("session_id").orderBy("arrival"))
    return new.join(last, "session_id", "left").select("session_id", "arrival", (F.coalesce("last", F.lit(0)) + rn).alias("order_position"))


def monthly_costs(costs: DataFrame, now: str) -> DataFrame:
    start = F.date_trunc("month", F.lit(now).cast("timestamp")).cast("timestamp_ntz")
    return costs.filter(F.col("created_at") >= start).groupBy("service").agg(F.round(F.sum("cost_usd"), 2).alias("cost_usd"))


def played_profile(history: DataFrame, tracks: DataFrame) -> DataFrame:
    joined = history.select("session_id", "track_id").join(tracks.select("track_id", "artist", "rec_cluster_id"), "track_id")
    return joined.groupBy("session_id").agg(F.sort_array(F.collect_set("artist")).alias("artists"), F.sort_array(F.collect_set("rec_cluster_id")).alias("clusters"))


def popular(tracks: DataFrame, limit: int, seed: int, categories: tuple[str, ...] = ()) -> DataFrame:
    rows = ready(tracks)
    rows = rows.filter(F.col("popularity_category").isin(*categories)) if categories else rows
    return rows.orderBy(F.desc("play_count"), shuffled(seed), "track_id").limit(limit)


def random_tracks(tracks: DataFrame, limit: int, seed: int, categories: tuple[str, ...] = ()) -> DataFrame:
    rows = ready(tracks)
    rows = rows.filter(F.col("popularity_category").isin(*categories)) if categories else rows
    return rows.orderBy(shuffled(seed), "track_id").limit(limit)


def tier(col: str = "popularity_category") -> Column:
    out = F.when(F.col(col) == "eternal_hit", 0).when(F.col(col) == "current_hit", 1).when(F.col(col) == "artist_best", 2)
    return out.when(F.col(col) == "former_hit", 3).otherwise(4)


def tracks_by_cluster(tracks: DataFrame, cluster: int, exclude: list[int], limit: int, seed: int) -> DataFrame:
    rows = filter_not_in(ready(tracks).filter(F.col("rec_cluster_id") == cluster), "track_id", exclude)
    return rows.orderBy(tier(), shuffled(seed), "track_id").limit(limit)


def popular_mix(tracks: DataFrame, limit: int, seed: int, language: str | None = None) -> DataFrame:
    """Popular tracks first, then random ones; both lists are cut before the language test, and a track counts once."""
    n_top = max(1, int(0.7 * limit))
    top = popular(tracks, n_top, seed, HITS).select("track_id", "language", F.lit(0).alias("part"), "play_count")
    more = random_tracks(tracks, limit, seed + 1).select("track_id", "language", F.lit(1).alias("part"), "play_count")
    own = W.Window.partitionBy("part").orderBy(F.when(F.col("part") == 0, -F.col("play_count")).otherwise(0), F.when(F.col("part") == 0, shuffled(seed)).otherwise(shuffled(seed + 1)), "track_id")
    rows = filter_optional(top.unionByName(more), "language", language).withColumn("pos", F.row_number().over(own))
    return first_by(rows, ["track_id"], "part", "pos").orderBy("part", "pos").limit(limit)


def one_tag_per_cluster(tags: DataFrame, limit: int, seed: int) -> DataFrame:
    return first_by(tags, ["cluster_id"], shuffled(seed, "tag_id"), "tag_id").orderBy(shuffled(seed, "tag_id"), "tag_id").limit(limit)


def mood_tags_for(sessions: DataFrame, profile: DataFrame, tags: DataFrame, limit: int, seed: int) -> DataFrame:
    """For each session: one tag of each cluster that it hasn't played, at most `limit`."""
    covered = profile.select("session_id", F.explode("clusters").alias("cluster_id"))
    clusters = tags.select("cluster_id").distinct()
    # Clusters are few by design (a fixed catalog): sessions times clusters stays linear in the sessions.
    open_ = sessions.withColumn("all", F.lit(1)).join(clusters.withColumn("all", F.lit(1)), "all").drop("all").join(covered, ["session_id", "cluster_id"], "left_anti")
    chosen = first_by(tags, ["cluster_id"], shuffled(seed, "tag_id"), "tag_id")
    rows = open_.join(chosen, "cluster_id").withColumn("rn", F.row_number().over(by("session_id").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "session_id", "tag_id")), "tag_id")))
    return rows.filter(F.col("rn") <= limit).select("session_id", "tag_id", "cluster_id", "rn")


def artist_once(ranked: DataFrame, limit: int) -> DataFrame:
    """ranked: artist, rank. The first track of each artist, ranked anew."""
    return first_by(ranked, ["artist"], "rank").orderBy("rank").limit(limit)


def slot_share(clusters: DataFrame, limit: int) -> DataFrame:
    """clusters: session_id, cluster_id, first_played. The limit split over a session's clusters in the order of their first play."""
    w = by("session_id")
    rn, n = F.row_number().over(w.orderBy("first_played", "cluster_id")), F.count("*").over(w)
    rows = clusters.withColumn("rn", rn).withColumn("n", n)
    base, rest = F.floor(F.lit(limit) / F.col("n")), F.lit(limit) % F.col("n")
    slots = base + F.when(F.col("rn") <= rest, 1).otherwise(0)
    return rows.withColumn("slots", slots).filter("slots > 0").select("session_id", "cluster_id", "rn", "slots")


def rerank_mood(hits: DataFrame, clusters: list[int], limit: int) -> DataFrame:
    t = F.when(F.col("popularity_category").isin(*HITS), 0).when(F.col("rec_cluster_id").isin(clusters), 1).otherwise(2)
    return hits.withColumn("tier", t).orderBy("tier", F.desc("score"), "track_id").limit(limit)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The last write of each key wins; new: the columns of old and seq."""
    both = old.withColumn("seq", F.lit(-1).cast("long")).unionByName(new)
    return first_by(both, [key], F.desc("seq")).drop("seq")


def reset_stale(jobs: DataFrame, worker: str) -> DataFrame:
    mine = (F.col("status") == "running") & (F.col("locked_by") == worker)
    return jobs.withColumn("was_reset", F.coalesce(mine, F.lit(False))).withColumn("status", F.when(F.col("was_reset"), "pending").otherwise(F.col("status"))).withColumn(
        "locked_by", F.when(~F.col("was_reset"), F.col("locked_by"))
    )


def sweep(jobs: DataFrame, now: str, stale_s: int = 600, fail_s: int = 86400) -> DataFrame:
    """What the sweeper does with stale pending jobs: old ones fail, the others are sent again."""
    age = F.lit(now).cast("timestamp_ntz") - F.col("created_at")
    return stale_pending(jobs, now, stale_s).select("id", F.when(age >= F.make_dt_interval(secs=F.lit(fail_s)), "fail").otherwise("republish").alias("action"))
