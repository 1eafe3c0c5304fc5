"""Searches that end in catalog rows: by mood, by tag, in stages; and the side tables that they read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import tokenize
from ..functions.vectors import normalized
from ..sources.shared import written
from .relational import HITS
from .vectors import centroids, nearest, width


def _ranked(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order)))


def ranked_fetch(hits: DataFrame, tracks: DataFrame) -> DataFrame:
    """hits: track_id, rank and more. With their tracks; hits whose track is gone are dropped, ranks stay as they are."""
    return hits.join(tracks, "track_id")


def mood_search(queries: DataFrame, vectors: DataFrame, tracks: DataFrame, history: DataFrame, limit: int, offset: int = 0, oversample: int = 50) -> DataFrame:
    """queries: query_id, query (unit length), session_id. The nearest lyrics, whatever their status: hits first, then those of a
    cluster that the session has played, then others, by score; of these the page with its tracks, and how many the cut kept."""
    near = nearest(queries.select("query_id", "query"), vectors.select("track_id", "vector"), oversample).select("query_id", "track_id", "score")
    known = near.join(tracks.select("track_id", "popularity_category", "rec_cluster_id"), "track_id").join(queries.select("query_id", "session_id"), "query_id")
    played = history.select("session_id", "track_id").join(tracks.select("track_id", "rec_cluster_id"), "track_id").filter("rec_cluster_id IS NOT NULL")
    played = played.select("session_id", "rec_cluster_id", F.lit(True).alias("played")).distinct()
    tier = F.when(F.col("popularity_category").isin(*HITS), 0).when(F.coalesce("played", F.lit(False)), 1).otherwise(2)
    ranked = _ranked(known.join(played, ["session_id", "rec_cluster_id"], "left").withColumn("tier", tier), ["query_id"], "tier", F.desc("score"), "track_id")
    cut = ranked.filter(F.col("rank") <= limit + offset).withColumn("total", F.count("*").over(W.Window.partitionBy("query_id")))
    return ranked_fetch(cut.filter(F.col("rank") > offset).select("query_id", "track_id", "tier", "score", "rank", "total"), tracks.select("track_id", "artist", "title"))


def _fused(a: DataFrame, l: DataFrame, keys: list[str], limit: int, share: float) -> DataFrame:  # noqa: E741
    """a, l: keys, track_id, score, the best of each side. An absent side counts 0; the best `limit` of both."""
    both = a.select(*keys, "track_id", F.col("score").alias("a")).join(l.select(*keys, "track_id", F.col("score").alias("l")), [*keys, "track_id"], "full_outer")
    score = F.round(F.coalesce("a", F.lit(0.0)) * share + F.coalesce("l", F.lit(0.0)) * (1 - share), 9)
    return _ranked(both.withColumn("score", score), keys, F.desc("score"), "track_id").filter(F.col("rank") <= limit).select(*keys, "track_id", "score")


def recommend_by_tag(requests: DataFrame, tags: DataFrame, tracks: DataFrame, audio: DataFrame, lyrics: DataFrame, history: DataFrame, limit: int, share: float = 0.7) -> DataFrame:
    """requests: session_id, tag_id. A session with played vectors asks with their centroid inside the tag's cluster and gets nothing
    that it has played; any other with the cluster's own centroid among all, found once for each cluster. Three times
    `limit` hits, well-known ones with a score of 0.5 or more first, each artist once."""
    both = audio.select("track_id", "cluster_id", F.col("vector").alias("av")).join(lyrics.select("track_id", F.col("vector").alias("lv")), "track_id")
    corpus = written(both.join(tracks.filter("status = 'ready'").select("track_id", "artist", "popularity_category"), "track_id"))
    sizes = {"av": width(audio), "lv": width(lyrics)}
    mean = lambda rows, v, key, name: centroids(rows.select(key, F.col(v).alias("vector")), [key], sizes[v]).select(key, normalized(F.col("centroid")).alias(name))
    asked = requests.join(tags.select("tag_id", "cluster_id"), "tag_id")
    played = history.select("session_id", "track_id").join(both, "track_id")
    own = mean(played, "av", "session_id", "qa").join(mean(played, "lv", "session_id", "ql"), "session_id")
    # Each session asks a cluster once, whatever the number of its tags; rows of a pair are only each side's best.
    personal = written(asked.select("session_id", "cluster_id").distinct().join(own, "session_id"))
    heard = history.select(F.col("session_id").alias("query_id"), "track_id")
    near = lambda x, q, v: nearest(x.withColumnRenamed(q, "query"), corpus.select("cluster_id", "track_id", F.col(v).alias("vector")), 3 * limit, ["cluster_id"], without=heard)
    sides = [near(personal.select(F.col("session_id").alias("query_id"), "cluster_id", q), q, v) for q, v in (("qa", "av"), ("ql", "lv"))]
    of_sessions = _fused(*sides, ["query_id", "cluster_id"], 3 * limit, share).withColumnRenamed("query_id", "session_id")
    others = asked.join(own, "session_id", "left_anti")
    means = mean(both, "av", "cluster_id", "qa").join(mean(both, "lv", "cluster_id", "ql"), "cluster_id").join(others.select("cluster_id").distinct(), "cluster_id")
    general = written(means.withColumnRenamed("cluster_id", "query_id"))
    sides = [nearest(general.select("query_id", F.col(q).alias("query")), corpus.select("track_id", F.col(v).alias("vector")), 3 * limit) for q, v in (("qa", "av"), ("ql", "lv"))]
    of_clusters = _fused(*sides, ["query_id"], 3 * limit, share).withColumnRenamed("query_id", "cluster_id")
    columns = "session_id", "tag_id", "track_id", "score"
    hits = asked.join(of_sessions, ["session_id", "cluster_id"]).select(*columns).unionByName(others.join(of_clusters, "cluster_id").select(*columns))
    known = hits.join(corpus.select("track_id", "artist", "popularity_category"), "track_id")
    first = F.when(F.col("popularity_category").isin(*HITS) & (F.col("score") >= 0.5), 0).otherwise(1)
    once = _ranked(known.withColumn("first", first), ["session_id", "tag_id", "artist"], "first", F.desc("score"), "track_id").filter("rank = 1")
    return _ranked(once, ["session_id", "tag_id"], "first", F.desc("score"), "track_id").filter(F.col("rank") <= limit).select("session_id", "tag_id", "track_id", "artist", "score", "rank")


def cascade(requests: DataFrame, *stages: DataFrame, least: int = 20) -> DataFrame:
    """requests: id, text; stages: request_id, candidate_id, decision. The first stage that doesn't reject a request answers it; then
    its own text does, if long enough, marked as such and low; else it isn't found."""
    rows = requests.select("id", "text", F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("candidate_id"), F.lit(None).cast("string").alias("confidence"))
    for k, stage in enumerate(stages, 1):
        got = stage.filter("decision <> 'reject'").select(F.col("request_id").alias("_id"), F.col("candidate_id").alias("_candidate"), F.col("decision").alias("_decision"), F.lit(f"stage_{k}").alias("_stage"))
        # What is found already meets no row of a later stage: each stage is read once.
        rows = rows.join(got, (F.col("id") == F.col("_id")) & F.col("source").isNull(), "left")
        rows = rows.select("id", "text", F.coalesce("source", "_stage").alias("source"), F.when(F.col("source").isNull(), F.col("_candidate")).otherwise(F.col("candidate_id")).alias("candidate_id"), F.coalesce("confidence", "_decision").alias("confidence"))
    enough = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")) >= least
    rest = lambda long, short: F.when(enough, long).otherwise(short)
    return rows.select("id", "candidate_id", F.coalesce("confidence", rest("low", "none")).alias("confidence"), F.coalesce("source", rest("asr_fallback", "not_found")).alias("source"))


def first_variants(names: Column) -> Column:
    """The names that differ whatever their case and the blanks around them, in order; blank ones go."""
    keys = F.transform(names, lambda x: F.lower(F.trim(F.coalesce(x, F.lit("")))))
    return F.filter(names, lambda x, i: (F.trim(F.coalesce(x, F.lit(""))) != "") & (F.array_position(keys, F.lower(F.trim(x))) == i + 1))


def chunks(texts: DataFrame, size: int = 256) -> DataFrame:
    """texts: id, text. id, chunk (from 0), text of at most `size` words; a blank text has none."""
    words = texts.select("id", tokenize(F.col("text")).alias("w")).filter(F.size("w") > 0)
    return words.select("id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(size)), lambda k: F.array_join(F.slice("w", k, size), " "))).alias("chunk", "text"))


def chunk_means(texts: DataFrame, chunk_vectors: DataFrame, dimension: int) -> DataFrame:
    """chunk_vectors: id, chunk, vector. id, n, vector: the plain mean of a text's chunks, zeros for one without."""
    means = centroids(chunk_vectors.select("id", "vector"), ["id"], dimension)
    zeros = F.array_repeat(F.lit(0.0), dimension)
    return texts.select("id").join(means, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("centroid", zeros).alias("vector"))


def model_stats(documents: DataFrame, column: str = "value") -> DataFrame:
    """pos, mean, std from JSON documents {"mean": [...], "std": [...]}; a deviation below 1e-8 counts as 1."""
    parsed = documents.select(F.from_json(column, "struct<mean: array<double>, std: array<double>>").alias("s"))
    rows = parsed.select(F.posexplode(F.arrays_zip("s.mean", "s.std")).alias("pos", "x"))
    return rows.select("pos", F.col("x.mean").alias("mean"), F.when(F.col("x.std") < 1e-8, 1.0).otherwise(F.col("x.std")).alias("std"))


def export_catalog(clusters: DataFrame, tags: DataFrame) -> DataFrame:
    """A JSON document for each cluster with its tags in order of id; write them sorted by cluster_id, and no task holds more than
    one cluster's tags at once."""
    own = tags.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct(F.col("tag_id").alias("id"), "name"))).alias("tags"))
    rows = clusters.join(own, "cluster_id", "left").select("cluster_id", F.to_json(F.struct(F.col("cluster_id").alias("id"), "track_count", F.coalesce("tags", F.expr("CAST(array() AS array<struct<id: bigint, name: string>>)")).alias("tags"))).alias("document"))
    return rows.repartitionByRange("cluster_id").sortWithinPartitions("cluster_id")
