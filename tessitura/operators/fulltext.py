"""Full-text search in a stored inverted index.

A row of the index is one token's posting list within one range of track ids: the sorted ids as steps from the range's start, for each the
weight of the token's occurrences (artist 1, title 0.4, lyrics 0.1), and the greatest of these. Ranges are the same for all tokens.
The table is partitioned by status and by a hash of the token, so that a search reads the asked tokens' partitions of one status. New
tracks are added as further rows; nothing that is stored changes.
A search needs every word of its query. It first lists the ranges in which all of them have postings, with the sum of their
greatest weights as a bound; the best range of each query gives a score that the page's last hit can't be below; only ranges whose bound reaches it
are opened, in one place each, where a list serves all queries that ask for it. Any number of queries are searched at once, those of the same words
once; a query's words are cut as the index cuts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..sources.shared import written

#: Weights of the fields.
FIELDS = (("artist", "artist", 1.0), ("title", "title", 0.4), ("lyrics", "lyrics_text", 0.1))


def cut(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct tokens with the sums of their weights. A text is one row, so that no table of its tokens is kept."""
    for batch in batches:
        lists = [batch.column(batch.schema.get_field_index(c)) for _, c, _ in FIELDS]
        rows = np.concatenate([np.repeat(np.arange(len(batch)), pc.list_value_length(x).to_numpy(zero_copy_only=False)) for x in lists])
        weights = np.concatenate([np.full(len(x.flatten()), w) for x, (_, _, w) in zip(lists, FIELDS, strict=True)])
        tokens = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        size = max(len(tokens.dictionary), 1)
        one, at = np.unique(rows * size + tokens.indices.to_numpy(), return_inverse=True)
        sums = np.round(np.bincount(at, weights, len(one)), 6)
        of = pa.array(one // size)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), tokens.dictionary.take(pa.array(one % size)), pa.array(sums)], ["track_id", "status", "token", "w"])


def postings(tracks: DataFrame, width: int, buckets: int) -> DataFrame:
    """tracks: track_id (unique), status, artist, title, lyrics_text. status, bucket, token, range, ids, weights, most."""
    words = tracks.select("track_id", "status", *(cut(F.coalesce(F.col(c), F.lit(""))).alias(c) for _, c, _ in FIELDS))
    one = words.mapInArrow(_weighed, "track_id long, status string, token string, w double")
    range_ = F.floor(F.col("track_id") / width).cast("long")
    lists = one.groupBy("status", "token", range_.alias("range")).agg(F.array_sort(F.collect_list(F.struct("track_id", "w"))).alias("p"), F.max("w").alias("most"))
    steps = F.transform("p", lambda x: (x["track_id"] - F.col("range") * width).cast("int"))
    return lists.select("status", bucket(F.col("token"), buckets).alias("bucket"), "token", "range", steps.alias("ids"), F.transform("p", lambda x: x["w"]).alias("weights"), "most")


class Index:
    """An index below a folder that all executors share; width (ids in a range) and buckets stay as they were at first."""

    def __init__(self, spark: SparkSession, path: str, width: int = 4096, buckets: int = 256):
        self.spark, self.path, self.width, self.buckets = spark, path, width, buckets

    def add(self, tracks: DataFrame) -> Index:
        """Tracks that the index doesn't hold yet."""
        # A bucket's ranges are dealt too: no task sorts a whole bucket.
        rows = postings(tracks, self.width, self.buckets).withColumn("part", F.floor(F.col("range") / 16)).repartition("status", "bucket", "part").drop("part").sortWithinPartitions("status", "bucket", "token", "range")
        rows.write.mode("append").partitionBy("status", "bucket").parquet(self.path)
        return self

    def lists(self) -> DataFrame:
        return self.spark.read.schema("token string, range bigint, ids array<int>, weights array<double>, most double, status string, bucket int").parquet(self.path)

    def asked(self, queries: DataFrame, status: str | None) -> tuple[DataFrame, DataFrame]:
        """queries: query_id, q. The queries' tokens, and the lists of their partitions; status None: of any. Only numbers of partitions reach
        the driver, `buckets` at most."""
        tokens = written(queries.select("query_id", F.array_distinct(cut(F.col("q"))).alias("tokens")).select("query_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token")))
        some = [r[0] for r in tokens.select(bucket(F.col("token"), self.buckets)).distinct().collect()]
        of = F.lit(True) if status is None else F.col("status") == status
        return tokens, self.lists().filter(of & F.col("bucket").isin(some))

    def _ranges(self, queries: DataFrame, status: str | None, keep: int | None) -> tuple[DataFrame, DataFrame]:
        """Ranges that each query may have hits in, with its tokens; and the tokens' lists. keep: how many hits of a range count, None: all."""
        tokens, lists = self.asked(queries, status)
        per_token = lists.groupBy("token", "range").agg(F.max("most").alias("most")).join(tokens, "token")
        whole = per_token.groupBy("query_id", "n", "range").agg(F.count("*").alias("have"), F.sum("most").alias("bound"), F.collect_list("token").alias("tokens")).filter("have = n")
        return whole.select("query_id", "range", "bound", "tokens", F.lit(keep).cast("int").alias("keep")), lists.join(tokens.select("token").distinct(), "token", "left_semi")

    def _hits(self, ranges: DataFrame, lists: DataFrame) -> DataFrame:
        """A range's lists meet its queries in one place: a list is moved once, however many queries ask for its token."""
        width, kind = self.width, dict(ranges.dtypes)["query_id"]
        asks = ranges.select("range", "query_id", "tokens", "keep", *(F.lit(None).cast(t).alias(c) for c, t in (("token", "string"), ("ids", "array<int>"), ("weights", "array<double>"))))
        held = lists.join(ranges.select("range").distinct(), "range", "left_semi").select("range", *(F.lit(None).cast(t).alias(c) for c, t in (("query_id", kind), ("tokens", "array<string>"), ("keep", "int"))), "token", "ids", "weights")

        def search(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, found = pa.Table.from_batches(list(batches)), {}
            some = table.filter(pc.is_valid(table["token"]))
            for token, ids, weights in zip(some["token"].to_pylist(), some["ids"].combine_chunks(), some["weights"].combine_chunks(), strict=True):
                found.setdefault(token, []).append((ids.values.to_numpy(), weights.values.to_numpy()))
            some = table.filter(pc.is_valid(table["query_id"]))
            for batch in some.to_batches(max_chunksize=1024):
                out = []
                for k, (tokens, keep) in enumerate(zip(batch["tokens"].to_pylist(), batch["keep"].to_pylist(), strict=True)):
                    have, score = np.zeros(width, np.int64), np.zeros(width)
                    for token in tokens:
                        for ids, weights in found[token]:
                            have[ids] += 1
                            score[ids] += weights
                    hits = np.flatnonzero(have == len(tokens))
                    points = np.round(score[hits], 6)
                    if keep is not None:
                        first = np.lexsort((hits, -points))[:keep]
                        hits, points = hits[first], points[first]
                    out.append((np.full(len(hits), k), hits, points))
                at, hits, points = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch["query_id"].take(pa.array(at)), pa.array(key[0].as_py() * width + hits), pa.array(points)], ["query_id", "track_id", "score"])

        return asks.unionByName(held).groupBy("range").applyInArrow(search, f"query_id {kind}, track_id long, score double")

    def _once(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """query_id and key; the queries of different words, by key: a set of words is searched once."""
        named = written(queries.select("query_id", F.array_join(F.array_sort(F.array_distinct(cut(F.col("q")))), " ").alias("q")))
        one = written(named.select("q").distinct().select(F.monotonically_increasing_id().alias("query_id"), "q"))
        return named.join(one.select(F.col("query_id").alias("key"), "q"), "q").select("query_id", "key"), one

    def matches(self, queries: DataFrame, status: str | None = "ready") -> DataFrame:
        """query_id, track_id, score of every match; a query without words has none. status None: tracks of any."""
        named, one = self._once(queries)
        return self._hits(*self._ranges(one, status, None)).withColumnRenamed("query_id", "key").join(named, "key").select("query_id", "track_id", "score")

    def top(self, queries: DataFrame, limit: int, offset: int = 0, status: str | None = "ready") -> DataFrame:
        """query_id, rank (from 1), track_id, score: a page of each query's matches by score, then id."""
        named, one = self._once(queries)
        ranges, lists = self._ranges(one, status, limit + offset)
        ranges = written(ranges)
        by_bound = W.Window.partitionBy("query_id").orderBy(F.desc("bound"), "range")
        first = ranges.withColumn("k", F.row_number().over(by_bound)).filter("k = 1").drop("k")
        by_score = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "track_id")
        last = self._hits(first, lists).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") == limit + offset).select("query_id", F.col("score").alias("least"))
        # Sums are rounded: a bound counts if it is near.
        open_ = ranges.join(last, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-5)).drop("least")
        ranked = self._hits(open_, lists).withColumn("rank", F.row_number().over(by_score))
        page = ranked.filter((F.col("rank") > offset) & (F.col("rank") <= limit + offset)).withColumnRenamed("query_id", "key")
        return page.join(named, "key").select("query_id", "rank", "track_id", "score")
