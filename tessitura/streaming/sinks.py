"""One stream, several tables, each message once.

A trigger writes its rows of every table into a folder of its own number. A trigger that is run again after a failure, wherever it
was stopped, writes the same folders again; a reader takes the folders of the triggers whose last table is there, so that it never sees half of
one. Nothing but the stream's own checkpoint remembers what has been done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..operators import vectors as V
from .progress import read_topic


class Tables:
    """Tables below a folder that all executors share, written trigger by trigger."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, number: int, tables: dict[str, DataFrame]) -> None:
        """All tables of a trigger, then the mark that they are whole."""
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/trigger={number}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/_whole/trigger={number}")

    def read(self, name: str, schema: str) -> DataFrame:
        """Rows of whole triggers, with the trigger's number."""
        done = self.spark.read.schema("id long, trigger long").option("recursiveFileLookup", "false").parquet(f"{self.path}/_whole").select("trigger").distinct()
        return self.spark.read.schema(f"{schema}, trigger long").option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}").join(done, "trigger", "left_semi")


def drive(stream: DataFrame, checkpoint: str, tables: Tables, split: Callable[[DataFrame], dict[str, DataFrame]]) -> None:
    """Everything that is there now. split: a trigger's rows to rows of the tables; the trigger is held while they are written."""

    def batch(df: DataFrame, number: int) -> None:
        held = df.persist()
        try:
            tables.write(number, split(held))
        finally:
            held.unpersist()

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(batch).start().awaitTermination()


POINT = "track_id long, vector array<double>, rec_cluster_id long, catalog_cluster_id long, status string, popularity_category string"
DEAD = "id long, error string, value string"
INDEXED = "id long, track_id long, rec_cluster_id long"


def index_messages(audio: DataFrame, lyrics: DataFrame, centroids: DataFrame, payload: DataFrame) -> Callable[[DataFrame], dict[str, DataFrame]]:
    """For drive(): messages of rec.index (id, value) to points of both vector tables with their cluster, answers for rec.indexed, and dead
    letters: broken ones, those without a field that they must have, and those of tracks without both vectors. audio, lyrics: track_id, vector;
    payload: track_id, popularity_category (a null one is regular). Of a track's messages in a trigger the last one by id counts."""

    def split(messages: DataFrame) -> dict[str, DataFrame]:
        rows = read_topic(messages, "rec.index")
        last = W.Window.partitionBy("track_id").orderBy(F.desc("id"))
        good = rows.filter("rejected IS NULL").withColumn("k", F.row_number().over(last)).filter("k = 1").select("id", "track_id")
        both = audio.select("track_id", F.col("vector").alias("a")).join(lyrics.select("track_id", F.col("vector").alias("l")), "track_id")
        found = good.join(both, "track_id")
        side = lambda c: found.select("track_id", F.col(c).alias("vector"))
        clusters = V.assign_cluster(side("a"), side("l"), centroids).select("track_id", F.col("cluster_id").cast("long").alias("rec_cluster_id"))
        known = payload.select("track_id", F.coalesce("popularity_category", F.lit("regular")).alias("popularity_category"))
        ready = found.join(clusters, "track_id").join(known, "track_id", "left").withColumns({"catalog_cluster_id": F.col("rec_cluster_id"), "status": F.lit("ready"), "popularity_category": F.coalesce("popularity_category", F.lit("regular"))})
        columns = [x.split()[0] for x in POINT.split(", ")]
        lost = good.join(both.select("track_id"), "track_id", "left_anti").join(messages.select("id", "value"), "id").select("id", F.lit("no vectors").alias("error"), "value")
        return {
            "audio": ready.withColumn("vector", F.col("a")).select(*columns), "lyrics": ready.withColumn("vector", F.col("l")).select(*columns),
            "indexed": ready.select("id", "track_id", "rec_cluster_id"), "dead": rows.filter("rejected IS NOT NULL").select("id", F.col("rejected").alias("error"), "value").unionByName(lost),
        }

    return split


def newest(rows: DataFrame, key: str) -> DataFrame:
    """Of each key the row of the latest trigger."""
    return rows.withColumn("_k", F.row_number().over(W.Window.partitionBy(key).orderBy(F.desc("trigger")))).filter("_k = 1").drop("_k", "trigger")


def counters(base: DataFrame, parts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """key, n: counts of a base table and of whole triggers together."""
    return base.select(key, n).unionByName(parts.select(key, n)).groupBy(key).agg(F.sum(n).alias(n))
