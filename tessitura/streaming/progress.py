"""Job progress as streams. The transformations take batch and streaming DataFrames alike; run() drives a stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Each topic's fields, and those without which a message is bad.
TOPICS = {
    "jobs": ("job_id long, mp3_key string, request_id string", ("job_id", "mp3_key")),
    "progress": ("job_id long, status string, step string, progress long, error string", ("job_id", "status")),
    "rec.index": ("track_id long, mp3_key string, lyrics string, request_id string", ("track_id", "mp3_key")),
    "rec.indexed": ("track_id long, rec_cluster_id long", ("track_id",)),
}


def read_topic(messages: DataFrame, topic: str) -> DataFrame:
    """messages: id, value; a batch or a stream. The topic's fields of each message; rejected says why one is bad: broken JSON or a
    field missing that it must have."""
    fields, needed = TOPICS[topic]
    m = messages.withColumn("m", F.from_json("value", fields + ", _broken string", {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}))
    missing = F.lit(False)
    for name in needed:
        missing = missing | F.col(f"m.{name}").isNull()
    error = F.when(F.col("m").isNull() | F.col("m._broken").isNotNull(), "broken").when(missing, "missing")
    return m.select("id", *(F.col(f"m.{f.split()[0]}").alias(f.split()[0]) for f in fields.split(", ")), error.alias("rejected"), "value")


def parsed(messages: DataFrame) -> DataFrame:
    return read_topic(messages, "jobs").drop("request_id").withColumnRenamed("rejected", "error")


def good(p: DataFrame) -> DataFrame:
    return p.filter("error is null").select("id", "job_id", "mp3_key")


def dead_letters(p: DataFrame) -> DataFrame:
    return p.filter("error is not null").select("id", "error", "value")


def latest(progress: DataFrame) -> DataFrame:
    """The last step, progress and status of each job, and its event: completed, failed or status."""
    last = progress.groupBy("job_id").agg(F.max_by(F.struct("step", "progress", "status"), F.struct("ts", "id")).alias("x"))
    return last.select("job_id", "x.*").withColumn("event", F.when(F.col("status").isin("completed", "failed"), F.col("status")).otherwise("status"))


def inactivity(progress: DataFrame, seconds: int = 300, late: str = "0 seconds") -> DataFrame:
    """A row for each stretch of events of a job that no event followed for `seconds`: the time of the time-out."""
    marked = progress.withWatermark("ts", late)
    # Sessions that touch are one; an event just as late as the time-out begins a new stretch.
    w = F.session_window("ts", f"{seconds} seconds -1 microseconds").alias("w")
    end = F.timestamp_micros(F.unix_micros("w.end") + 1)
    return marked.groupBy("job_id", w).agg(F.count("*").alias("n")).select("job_id", F.col("w.start").alias("started"), end.alias("timed_out"), "n")


def claims(messages: DataFrame, within: str = "3 days") -> DataFrame:
    """The first message of each job; streams forget a job after `within`."""
    if messages.isStreaming:
        return messages.withWatermark("ts", within).dropDuplicatesWithinWatermark(["job_id"])
    return messages.dropDuplicates(["job_id"])


def play_counts(history: DataFrame) -> DataFrame:
    return history.filter("completed").groupBy("track_id").agg(F.count("*").alias("plays"))


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that is there now, as a written table; state and offsets lie in the shared folder, from which a
    restarted query goes on. complete and update: the rows of the last batch in which they changed."""
    spark: SparkSession = stream.sparkSession
    path, checkpoint = shared_dir(spark), shared_dir(spark)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        writer.format("parquet").outputMode("append").start(path).awaitTermination()
    else:
        writer.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, ts as a timestamp."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A pattern: the stream source takes a single file as well as a folder by it.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
