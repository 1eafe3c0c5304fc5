"""Nearest neighbours, centroids and score fusion over vector tables (track_id, vector: unit length)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.vectors import dot, normalized, weighted_concat


def width(vectors: DataFrame, column: str = "vector") -> int:
    return vectors.agg(F.max(F.size(column))).first()[0] or 0


def centroids(vectors: DataFrame, keys: list[str], dimension: int | None = None) -> DataFrame:
    """The mean vector and the number of rows of each key. Sums by position are columns of a key's row: they add up map-side, and no row is a position. dimension:
    the longest vector's length, looked up if it isn't given."""
    some = vectors.filter(F.size("vector") > 0)
    n = width(some) if dimension is None else dimension
    sums = some.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d"), *(F.avg(F.get("vector", F.lit(k))).alias(f"x{k}") for k in range(n)))
    mean = F.array(*(F.col(f"x{k}") for k in range(n))) if n else F.expr("CAST(array() AS array<double>)")
    return sums.select(*keys, F.slice(mean, F.lit(1), F.col("d")).alias("centroid"), "n")


def against_all(rows: DataFrame, few: DataFrame, most: int = 1 << 16, block: int = 1 << 12) -> DataFrame:
    """Every row with each of a few: queries or centroids, whose number is checked first. Up to `most` of them are broadcast, so
    that the rows stay where they are; more are dealt into blocks of about `block`, and each block is an equi-join."""
    n = few.count()
    if n <= most:
        return rows.join(F.broadcast(few), F.lit(True))
    blocks = -(-n // block)
    dealt = few.withColumn("_block", F.pmod(F.xxhash64(*few.columns[:1]), F.lit(blocks)))
    return rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_block", F.col("_block").cast("long")).join(dealt, "_block").drop("_block")


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    n = len(column)
    return pc.list_flatten(column).to_numpy().reshape(n, -1) if n else np.empty((0, 0))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k highest scores by nine decimals, ties by smaller id."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        r, c = np.nonzero(scores >= (least - 2e-9)[:, None])  # what may be rounded to the k-th; the others needn't be rounded
    else:
        r, c = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((ids[c], -np.round(scores[r, c], 9), r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, np.arange(scores.shape[0]))
    some = np.arange(len(r)) - first[r] < k
    return r[some], c[some]


def nearest(queries: DataFrame, corpus: DataFrame, k: int, on: list[str] | None = None, block: int | None = None, without: DataFrame | None = None) -> DataFrame:
    """queries: query_id, query (unit length). The k most similar rows of the corpus for each, exactly. on: columns that must be
    equal; the result has them too. Without them, every query meets every row. Both sides are dealt into blocks of about `block` (16,384 to 65,536, so that there are some 256
    cells: each row is copied to as many as the other side has blocks); a cell is one product of two matrices, and only each query's k best of a cell leave it. without: query_id, track_id, pairs that don't count."""
    keys = on or []
    most = lambda x: (x.groupBy(*keys).count().agg(F.max("count")).first()[0] if keys else x.count()) or 1
    nq, nc = most(queries), most(corpus)
    block = block or min(max(1 << 14, int((nq * nc) ** 0.5) >> 4), 1 << 16)
    ni, nj = -(-nq // block), max(-(-nc // block), min(8, -(-nc // (block >> 4 or 1))))
    kind = dict(queries.dtypes)["query_id"], dict(corpus.dtypes)["track_id"]
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.filter("query IS NOT NULL").select(*keys, "query_id", "query")
    if without is None:
        asked = asked.withColumn("out", F.lit(None).cast(f"array<{kind[1]}>"))
    else:  # a query carries what it leaves out; with keys only tracks under the same ones
        gone = without.select("query_id", "track_id").join(corpus.select(*keys, "track_id"), "track_id") if keys else without
        asked = asked.join(gone.groupBy(*keys, "query_id").agg(F.collect_set("track_id").alias("out")), [*keys, "query_id"], "left")
    asks = asked.select(*keys, deal("query_id", ni).alias("i"), every(nj).alias("j"), "query_id", F.lit(None).cast(kind[1]).alias("track_id"), F.col("query").alias("v"), "out")
    rows = corpus.filter("vector IS NOT NULL").select(*keys, every(ni).alias("i"), deal("track_id", nj).alias("j"), F.lit(None).cast(kind[0]).alias("query_id"), "track_id", F.col("vector").alias("v"), F.lit(None).cast(f"array<{kind[1]}>").alias("out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        left, right = table.filter(pc.is_valid(table["query_id"])), table.filter(pc.is_valid(table["track_id"]))
        if not len(left) or not len(right):
            return
        right = right.sort_by("track_id")
        a, b, ids = _vectors(left["v"]), _vectors(right["v"]).T, right["track_id"].to_numpy()
        asked, step = left.select([*keys, "query_id"]).combine_chunks(), max(1, (1 << 21) // len(right))
        for low in range(0, len(left), step):
            scores = a[low : low + step] @ b
            out = left["out"].slice(low, step)
            n, gone = pc.fill_null(pc.list_value_length(out), 0).to_numpy(), pc.list_flatten(out).to_numpy()
            if len(gone):
                first, last = np.searchsorted(ids, gone), np.searchsorted(ids, gone, "right")
                wide = last - first  # places of equal ids, none where the cell lacks one
                at = np.arange(wide.sum()) + np.repeat(first - (np.cumsum(wide) - wide), wide)
                scores[np.repeat(np.repeat(np.arange(len(n)), n), wide), at] = -np.inf
            r, c = best(scores, ids, k)
            some = scores[r, c] > -np.inf
            r, c = r[some], c[some]
            of = asked.take(pa.array(r + low)).combine_chunks()
            yield from pa.table([*of.columns, pa.array(ids[c]), pa.array(np.round(scores[r, c], 9))], [*of.column_names, "track_id", "score"]).to_batches()

    types = dict(queries.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keys), f"query_id {kind[0]}", f"track_id {kind[1]}", "score double"])
    scored = asks.unionByName(rows).groupBy(*keys, "i", "j").applyInArrow(run, schema)
    w = W.Window.partitionBy(*keys, "query_id").orderBy(F.desc("score"), "track_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fused(audio: DataFrame, lyrics: DataFrame, limit: int, audio_share: float = 0.7) -> DataFrame:
    """query_id, track_id, score of two hit lists as one: an absent side counts 0."""
    a = audio.select("query_id", "track_id", F.col("score").alias("a"))
    b = lyrics.select("query_id", "track_id", F.col("score").alias("l"))
    score = F.round(F.coalesce("a", F.lit(0.0)) * audio_share + F.coalesce("l", F.lit(0.0)) * (1 - audio_share), 9)
    rows = a.join(b, ["query_id", "track_id"], "full_outer").select("query_id", "track_id", score.alias("score"))
    w = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "track_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def assign_cluster(audio: DataFrame, lyrics: DataFrame, clusters: DataFrame, audio_share: float = 0.3) -> DataFrame:
    """The cluster whose centroid is nearest to the joined vector; clusters: cluster_id, centroid (unit length). Its rows
    are as many as a catalog has clusters."""
    scale = (audio_share / (1 - audio_share)) ** 0.5
    both = audio.select("track_id", F.col("vector").alias("a")).join(lyrics.select("track_id", F.col("vector").alias("l")), "track_id")
    joined = both.select("track_id", normalized(weighted_concat(F.col("a"), F.col("l"), scale)).alias("v"))
    scored = against_all(joined, clusters.select("cluster_id", "centroid")).withColumn("sim", F.round(dot(F.col("v"), F.col("centroid")), 9))
    return scored.groupBy("track_id").agg(F.max_by("cluster_id", F.struct("sim", -F.col("cluster_id"))).alias("cluster_id"))
