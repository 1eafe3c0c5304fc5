"""Recommendations for all sessions at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.vectors import normalized
from ..sources.shared import written
from .relational import HITS, popular_mix, slot_share
from .vectors import centroids, nearest, width


def greedy_artists(rows: DataFrame, limit: int) -> DataFrame:
    """rows: session_id, cluster_rank, rank, slots, track_id, artist, played_artists. Clusters in their order; a track is
    taken if its artist was neither played nor taken before, until the cluster's slots are full. A session has at most
    three times `limit` rows, so its group is bounded."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cluster_rank", "rank"])
        seen = set(pdf["played_artists"].iloc[0])
        taken: list[tuple] = []
        left: dict = {}
        for c, slots, track, artist, score in zip(pdf["cluster_rank"], pdf["slots"], pdf["track_id"], pdf["artist"], pdf["score"], strict=True):
            if artist not in seen and left.setdefault(c, slots) > 0 and len(taken) < limit:
                seen.add(artist)
                left[c] -= 1
                taken.append((pdf["session_id"].iloc[0], track, artist, score, len(taken) + 1))
        return pd.DataFrame(taken, columns=["session_id", "track_id", "artist", "score", "position"])

    return rows.groupBy("session_id").applyInPandas(walk, "session_id long, track_id long, artist string, score double, position long")


def cluster_hits(history: DataFrame, tracks: DataFrame, audio: DataFrame, lyrics: DataFrame, limit: int, audio_share: float = 0.7) -> DataFrame:
    """For each session and each cluster that it played: the ready tracks of the same cluster that it hasn't played and that are
    nearest to its centroids, by sound and by lyrics: the best three for each of the cluster's slots on either side as one list, an absent side counts 0;
    well-known ones with a score of 0.5 or more first. A session meets its own clusters' tracks only, in products of blocks: no row is a
    session and a track before each side's best."""
    both = audio.select("track_id", "cluster_id", F.col("vector").alias("av")).join(lyrics.select("track_id", F.col("vector").alias("lv")), "track_id")
    played = history.select("session_id", "track_id", "played_at").join(both, "track_id")
    keys = ["session_id", "cluster_id"]
    sizes = {"av": width(audio), "lv": width(lyrics)}
    mean = lambda v, name: centroids(played.select(*keys, F.col(v).alias("vector")), keys, sizes[v]).select(*keys, normalized(F.col("centroid")).alias(name))
    slots = slot_share(played.groupBy(*keys).agg(F.min("played_at").alias("first_played")), limit)
    corpus = written(both.join(tracks.filter("status = 'ready'").select("track_id"), "track_id"))
    asked = written(slots.join(mean("av", "qa"), keys).join(mean("lv", "ql"), keys).select(*keys, "rn", "slots", "qa", "ql"))
    heard = history.select(F.col("session_id").alias("query_id"), "track_id")

    def side(query: str, vector: str, name: str) -> DataFrame:
        queries = asked.select(F.col("session_id").alias("query_id"), "cluster_id", F.col(query).alias("query"))
        hits = nearest(queries, corpus.select("cluster_id", "track_id", F.col(vector).alias("vector")), 3 * limit, ["cluster_id"], without=heard)
        return hits.select(F.col("query_id").alias("session_id"), "cluster_id", "track_id", "rank", F.col("score").alias(name)).join(asked.select(*keys, "rn", "slots"), keys).filter(F.col("rank") <= 3 * F.col("slots")).drop("rank")

    own = W.Window.partitionBy(*keys)
    place = F.row_number().over(own.orderBy(F.desc("score"), "track_id"))
    both_sides = side("qa", "av", "a").join(side("ql", "lv", "l"), [*keys, "rn", "slots", "track_id"], "full_outer")
    score = F.round(F.coalesce("a", F.lit(0.0)) * audio_share + F.coalesce("l", F.lit(0.0)) * (1 - audio_share), 9)
    cut = both_sides.withColumn("score", score).withColumn("near", place).filter(F.col("near") <= 3 * F.col("slots"))
    known = cut.join(tracks.select("track_id", "artist", "popularity_category"), "track_id")
    first = F.when(F.col("popularity_category").isin(*HITS) & (F.col("score") >= 0.5), 0).otherwise(1)
    rank = F.row_number().over(own.orderBy(first, F.desc("score"), "track_id"))
    return known.select("session_id", F.col("rn").alias("cluster_rank"), rank.alias("rank"), "slots", "track_id", "artist", "score")


def recommend(history: DataFrame, tracks: DataFrame, audio: DataFrame, lyrics: DataFrame, limit: int, sessions: DataFrame | None = None, seed: int = 13) -> DataFrame:
    """session_id, track_id, artist, score, position, strategy: by the clusters that a session played; a session without such tracks gets
    the popular mix without what it has played (score 0). sessions: those to answer, all with a history by default."""
    artists = history.select("session_id", "track_id").join(tracks.select("track_id", "artist"), "track_id").groupBy("session_id").agg(F.collect_set("artist").alias("played_artists"))
    by_cluster = written(greedy_artists(cluster_hits(history, tracks, audio, lyrics, limit).join(artists, "session_id"), limit))
    rest = (sessions if sessions is not None else history).select("session_id").distinct().join(by_cluster.select("session_id"), "session_id", "left_anti")
    # The mix is one list of at most `limit` tracks.
    mix = popular_mix(tracks, limit, seed).select("track_id", F.struct("part", "pos").alias("order")).join(tracks.select("track_id", "artist"), "track_id")
    mixed = rest.join(F.broadcast(mix), F.lit(True)).join(history.select("session_id", "track_id").distinct(), ["session_id", "track_id"], "left_anti")
    position = F.row_number().over(W.Window.partitionBy("session_id").orderBy("order", "track_id")).cast("long")
    popular = mixed.select("session_id", "track_id", "artist", F.lit(0.0).alias("score"), position.alias("position"), F.lit("popular").alias("strategy"))
    return by_cluster.withColumn("strategy", F.lit("cluster")).unionByName(popular)
