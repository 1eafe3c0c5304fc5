"""Event sequences: gaps, islands, line numbers and proportional times, as windows over each track's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

def track():
    return W.Window.partitionBy("track_id").orderBy("n")


def gaps(rows: DataFrame) -> DataFrame:
    """start - the end before; null for a track's first row."""
    return rows.withColumn("gap", F.col("start") - F.lag("end").over(track()))


def gap_percentile(rows: DataFrame, share: float = 0.75) -> DataFrame:
    return gaps(rows).filter("gap is not null").groupBy("track_id").agg(F.round(F.percentile("gap", F.lit(share)), 6).alias("gap"))


def median_inner_gap(rows: DataFrame, drop_last: bool = False) -> DataFrame:
    """The median gap without a track's first one, and without its last one too if drop_last."""
    last = F.max("n").over(W.Window.partitionBy("track_id"))
    inner = gaps(rows).withColumn("last", last).filter("n > 1" + (" and n < last" if drop_last else ""))
    return inner.groupBy("track_id").agg(F.round(F.median("gap"), 6).alias("median_gap"))


def line_ids(rows: DataFrame, pause: float = 1.0) -> DataFrame:
    """A running line number: one more at each row behind a gap longer than `pause`."""
    start = F.coalesce(F.col("gap") > pause, F.lit(False)).cast("int")
    return gaps(rows).withColumn("line", F.sum(start).over(track()))


def lines(rows: DataFrame, pause: float = 1.0) -> DataFrame:
    return line_ids(rows, pause).groupBy("track_id", "line").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_syllables"))


def gap_intervals(rows: DataFrame, intro: float = 0.1, pause: float = 1.0, least: float = 5.0) -> DataFrame:
    """The gap before the first line and those of `least` seconds or more between lines."""
    w = W.Window.partitionBy("track_id").orderBy("line")
    x = lines(rows, pause).withColumn("from", F.coalesce(F.lag("end").over(w), F.lit(0.0))).withColumn("first", F.col("line") == 0)
    return x.filter((F.col("first") & (F.col("start") > intro)) | (~F.col("first") & (F.col("start") - F.col("from") >= least))).select("track_id", F.col("from").alias("start"), F.col("start").alias("end"))


def islands(rows: DataFrame, flag: str) -> DataFrame:
    """Runs of rows on which the flag holds: first and last n. Rows of a run share n minus their number among the flagged."""
    own = F.col("n") - F.row_number().over(track())
    return rows.filter(flag).withColumn("_run", own).groupBy("track_id", "_run").agg(F.min("n").alias("first_n"), F.max("n").alias("last_n"), F.count("*").alias("length")).drop("_run")


def first_silent_run(rows: DataFrame, flag: str, k: int) -> DataFrame:
    """Where the first run of at least k rows without the flag begins."""
    return islands(rows, f"NOT ({flag})").filter(F.col("length") >= k).groupBy("track_id").agg(F.min("first_n").alias("first_n"))


def cumulative_times(words: DataFrame, digits: int = 3) -> DataFrame:
    """words: track_id, word, n, text, start, end. A word's time split over its parts in proportion to their characters."""
    word = W.Window.partitionBy("track_id", "word")
    share = F.sum(F.length("text")).over(word.orderBy("n")) / F.sum(F.length("text")).over(word)
    return words.withColumn("part_end", F.round(F.col("start") + (F.col("end") - F.col("start")) * share, digits))


def line_at(lines_: DataFrame, times: DataFrame) -> DataFrame:
    """times: track_id, t. The last line that starts at or before t; before the first one: line 0. As-of, by one union
    and one window, so that no pair of a line and a time is made but the one that is asked for."""
    marks = lines_.select("track_id", F.col("start").alias("at"), F.lit(0).alias("kind"), "line").unionByName(
        times.select("track_id", F.col("t").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("line"))
    )
    w = W.Window.partitionBy("track_id").orderBy("at", "kind")
    got = marks.withColumn("line", F.coalesce(F.last("line", ignorenulls=True).over(w), F.lit(0)))
    return got.filter("kind = 1").select("track_id", F.col("at").alias("t"), "line")


def gap_at(gaps_: DataFrame, times: DataFrame) -> DataFrame:
    """times: track_id, t. The gap that holds t and how much of it has passed in per cent; none: no row. Gaps of a track
    don't overlap, so that the last one that starts at or before t is the only candidate."""
    marks = gaps_.select("track_id", F.col("start").alias("at"), F.lit(0).alias("kind"), F.struct("start", "end").alias("g")).unionByName(
        times.select("track_id", F.col("t").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<start:double,end:double>").alias("g"))
    )
    w = W.Window.partitionBy("track_id").orderBy("at", "kind")
    got = marks.withColumn("g", F.last("g", ignorenulls=True).over(w)).filter((F.col("kind") == 1) & (F.col("at") < F.col("g.end")))
    return got.select("track_id", F.col("at").alias("t"), ((F.col("at") - F.col("g.start")) / (F.col("g.end") - F.col("g.start")) * 100).alias("percent"))


def syllable_progress(rows: DataFrame, t: float) -> DataFrame:
    """At time t of each track: sung, active with its share in per cent, or upcoming."""
    state = F.when(F.col("end") <= t, "sung").when(F.col("start") <= t, "active").otherwise("upcoming")
    share = F.least(F.lit(1.0), (F.lit(t) - F.col("start")) / (F.col("end") - F.col("start"))) * 100
    return rows.withColumn("state", state).withColumn("percent", F.when(F.col("state") == "active", share))


def voiced_intervals(frames: DataFrame, top_db: float, frame_seconds: float = 0.02, least_seconds: float = 1.0) -> DataFrame:
    """frames: track_id, n, rms. Runs of frames louder than the track's peak less top_db; a track with less than
    least_seconds of them keeps its whole length as one interval."""
    own = W.Window.partitionBy("track_id")
    floor = F.max("rms").over(own) * 10 ** (-top_db / 20)
    marked = frames.select("track_id", "n", (F.col("rms") > floor).alias("voiced"))
    runs = islands(marked, "voiced").select("track_id", F.col("first_n").alias("start_n"), (F.col("last_n") + 1).alias("end_n"))
    kept = runs.withColumn("total", F.sum(F.col("end_n") - F.col("start_n")).over(own)).filter(F.col("total") * frame_seconds >= least_seconds).drop("total")
    whole = frames.groupBy("track_id").agg(F.min("n").alias("start_n"), (F.max("n") + 1).alias("end_n")).join(kept.select("track_id").distinct(), "track_id", "left_anti")
    return kept.unionByName(whole)


def frames_in_span(frames: DataFrame, spans: DataFrame, block: int = 64) -> DataFrame:
    """spans: track_id, span, start_n, end_n (excluded). The peak rms of the frames inside each: an equi-join on blocks of
    frames, then the exact test, so that a span meets only the blocks that it touches."""
    cut = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_n") / block), F.floor((F.col("end_n") - 1) / block))))
    rows = cut.join(frames.withColumn("_b", F.floor(F.col("n") / block)), ["track_id", "_b"]).filter((F.col("n") >= F.col("start_n")) & (F.col("n") < F.col("end_n")))
    return rows.groupBy("track_id", "span").agg(F.max("rms").alias("peak"), F.count("*").alias("n_frames"))
