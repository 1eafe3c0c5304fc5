"""Word and line times from phoneme spans and loudness frames, as joins on blocks of frames and windows over each track.

spans: track_id, word, j (place in the word), start_n, end_n (frames, the end excluded). frames: track_id, n, rms.
words: what word_spans() makes of spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .timing import islands

#: A gap is an outlier above 2 medians, and extreme from 7; the least level that counts as a voice.
OUTLIER, EXTREME, LEAST_LEVEL = 2.0, 7.0, 1e-6
FRAME = 0.02


def frame_rms(samples: Column, size: int, hop: int) -> Column:
    """Root mean squares of the frames of `size` samples, every `hop` samples; samples that don't fill a frame are left out."""
    starts = F.when(F.size(samples) >= size, F.sequence(F.lit(1), F.size(samples) - size + 1, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.sqrt(F.aggregate(F.slice(samples, s, size), F.lit(0.0), lambda a, x: a + x * x) / size))


def lyric_words(text: Column) -> Column:
    """An array of (word, first): the words of each line that hold a letter or an apostrophe; first: the first one kept of its line."""
    words = lambda line: F.filter(F.split(line, r"\s+"), lambda w: w.rlike(r"[\p{L}']"))
    flagged = lambda ws: F.transform(ws, lambda w, i: F.struct(w.alias("word"), (i == 0).alias("first")))
    return F.flatten(F.transform(F.split(text, r"\r\n|\n|\r"), lambda line: flagged(words(line))))


def group_by_lengths(tokens: DataFrame, lengths: DataFrame) -> DataFrame:
    """tokens: track_id, n (from 0); lengths: track_id, word, length. Each word takes the next tokens; the first one that doesn't
    fit ends the track. An equi-join on the places that each word covers."""
    order = W.Window.partitionBy("track_id").orderBy("word")
    placed = lengths.withColumn("upto", F.sum("length").over(order)).withColumn("from", F.col("upto") - F.col("length"))
    total = tokens.groupBy("track_id").agg(F.count("*").alias("total"))
    fit = placed.join(total, "track_id").filter("upto <= total AND length > 0")
    return fit.select("track_id", "word", F.explode(F.sequence(F.col("from"), F.col("upto") - 1)).alias("n")).join(tokens, ["track_id", "n"])


def word_spans(spans: DataFrame) -> DataFrame:
    """track_id, word, spans (in order of j), start_n, end_n, next_start (of the next word, null for the last one)."""
    rows = spans.groupBy("track_id", "word").agg(F.array_sort(F.collect_list(F.struct("j", "start_n", "end_n"))).alias("spans"))
    rows = rows.withColumn("start_n", F.col("spans")[0]["start_n"]).withColumn("end_n", F.element_at("spans", -1)["end_n"])
    return rows.withColumn("next_start", F.lead("start_n").over(W.Window.partitionBy("track_id").orderBy("word")))


def _inner_median(words: DataFrame, leave_last: int) -> DataFrame:
    """track_id, median: of the gaps inside words, without each word's first gap and its last `leave_last`."""
    pairs = F.arrays_zip(F.slice("spans", 2, F.size("spans")), F.slice("spans", 3, F.size("spans")))
    gaps = F.transform(F.slice(pairs, 1, F.greatest(F.size("spans") - 2 - leave_last, F.lit(0))), lambda p: p["1"]["start_n"] - p["0"]["end_n"])
    return words.select("track_id", F.explode(gaps).alias("gap")).groupBy("track_id").agg(F.median("gap").alias("median"))


def _within(frames: DataFrame, areas: DataFrame, block: int = 64) -> DataFrame:
    """areas: track_id, word, lo, hi (excluded) and more. A row for each frame inside: an equi-join on blocks of frames."""
    cut = areas.filter("hi > lo").withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    return cut.join(frames.withColumn("_b", F.floor(F.col("n") / block)), ["track_id", "_b"]).filter("n >= lo AND n < hi").drop("_b")


def _track_end(frames: DataFrame) -> DataFrame:
    return frames.groupBy("track_id").agg((F.max("n") + 1).alias("track_end"))


def _level(frames: DataFrame, areas: DataFrame) -> DataFrame:
    """track_id, word, level: the loudest frame of each area; areas without a voice go."""
    return _within(frames, areas).groupBy("track_id", "word").agg(F.max("rms").alias("level")).filter(F.col("level") >= LEAST_LEVEL)


def _silent_runs(frames: DataFrame, areas: DataFrame) -> DataFrame:
    """areas with `floor`: the runs of frames below it, cut at the area: track_id, word, first_n, last_n, length."""
    inside = _within(frames, areas).withColumn("_key", F.struct("track_id", "word"))
    marked = inside.select(F.col("_key").alias("track_id"), "n", (F.col("rms") < F.col("floor")).alias("silent"))
    return islands(marked, "silent").select("track_id.*", "first_n", "last_n", "length")


def refine_onset(frames: DataFrame, onsets: DataFrame) -> DataFrame:
    """onsets: track_id, onset_n. The onset moved back to just behind the nearest two silent frames: silent is a tenth of the median
    of the half second from the onset. More than a second back, or without a voice there: as it was."""
    ahead = _within(frames, onsets.select("track_id", F.lit(0).alias("word"), F.col("onset_n").alias("lo"), (F.col("onset_n") + 25).alias("hi")))
    level = ahead.groupBy("track_id").agg(F.median("rms").alias("median"), F.max("rms").alias("most")).filter("most >= 1e-5 AND median >= 1e-6")
    behind = onsets.join(level, "track_id").select("track_id", F.lit(0).alias("word"), (F.col("onset_n") - 60).alias("lo"), F.col("onset_n").alias("hi"), (F.col("median") / 10).alias("floor"))
    runs = _silent_runs(frames, behind.withColumn("lo", F.greatest("lo", F.lit(0)))).filter("length >= 2")
    moved = runs.groupBy("track_id").agg((F.max("last_n") + 1).alias("at"))
    near = F.col("onset_n") - F.col("at") <= 50
    return onsets.join(moved, "track_id", "left").select("track_id", "onset_n", F.when(near, F.col("at")).otherwise(F.col("onset_n")).alias("refined_n"))


def line_start_shift(words: DataFrame, frames: DataFrame, firsts: DataFrame) -> DataFrame:
    """firsts: track_id, word of the words that begin a line. (track_id, word, start_n, new_start) of those whose first gap is an
    outlier and whose voice sets in more than a frame later: behind the first long enough silence, or, where the gap is
    extreme, behind the last one (else at the second span)."""
    many = words.join(firsts.select("track_id", "word"), ["track_id", "word"], "left_semi").filter(F.size("spans") >= 2).join(_inner_median(words, 0), "track_id")
    many = many.withColumn("second", F.col("spans")[1]["start_n"]).withColumn("gap", F.col("second") - F.col("spans")[0]["end_n"]).withColumn("ref", F.greatest("median", F.lit(1.0)))
    odd = many.filter(F.col("gap") > OUTLIER * F.col("median")).join(_track_end(frames), "track_id")
    odd = odd.select("track_id", "word", "start_n", "second", "gap", "ref", F.coalesce(F.col("next_start") - 1, F.col("track_end")).alias("voiced_end"))
    level = _level(frames, odd.select("track_id", "word", F.col("start_n").alias("lo"), F.col("voiced_end").alias("hi")))
    odd = odd.join(level, ["track_id", "word"]).withColumn("least", F.greatest(F.lit(2), F.round(OUTLIER * F.col("ref")).cast("int"))).withColumn("extreme", F.col("gap") / F.col("ref") >= EXTREME)
    runs = _silent_runs(frames, odd.select("track_id", "word", F.col("start_n").alias("lo"), F.col("second").alias("hi"), (F.col("level") / 5).alias("floor")))
    long = runs.join(odd.select("track_id", "word", "second", "least"), ["track_id", "word"]).filter("length >= least")
    # The first long silence counts even if nothing voiced follows it; the last one has to end before the second span.
    found = long.groupBy("track_id", "word").agg(F.min("last_n").alias("first_end"), F.max(F.when(F.col("last_n") < F.col("second") - 1, F.col("last_n"))).alias("last_end"))
    both = odd.join(found, ["track_id", "word"], "left")
    late = F.when(F.col("second") - F.col("start_n") >= F.col("least") + 1, F.col("last_end") + 1)
    new = F.when(F.col("extreme"), F.coalesce(late, F.col("second"))).when((F.col("first_end") < F.col("second") - 1) & (F.col("second") - F.col("start_n") >= 2), F.col("first_end") + 1)
    return both.withColumn("new_start", new).filter(F.col("new_start") > F.col("start_n") + 1).select("track_id", "word", "start_n", "new_start")


def _voiced_until(frames: DataFrame, areas: DataFrame) -> DataFrame:
    """areas: track_id, word, lo, hi, floor, least. Where the voice that begins in the area ends: behind its last voiced frame
    before the first run of `least` silent ones. No row without a voiced frame before that."""
    runs = _silent_runs(frames, areas).join(areas.select("track_id", "word", "least"), ["track_id", "word"]).filter("length >= least")
    stop = runs.groupBy("track_id", "word").agg(F.min("first_n").alias("stop"))
    inside = _within(frames, areas).filter("rms >= floor").join(stop, ["track_id", "word"], "left").filter("stop IS NULL OR n < stop")
    return inside.groupBy("track_id", "word").agg((F.max("n") + 1).alias("until"))


def word_end_trim(words: DataFrame, frames: DataFrame) -> DataFrame:
    """(track_id, word, end_n, new_end) of words whose last gap is an outlier and whose voice ends before it."""
    many = words.filter(F.size("spans") >= 2).join(_inner_median(words, 1), "track_id").withColumn("ref", F.greatest("median", F.lit(1.0)))
    many = many.withColumn("before", F.element_at("spans", -2)["end_n"]).withColumn("gap", F.element_at("spans", -1)["start_n"] - F.col("before"))
    odd = many.filter(F.col("gap") > OUTLIER * F.col("ref")).filter(F.col("end_n") - F.col("before") >= 2)
    odd = odd.select("track_id", "word", "start_n", "end_n", "before", F.greatest(F.lit(2), F.round(OUTLIER * F.col("ref")).cast("int")).alias("least"))
    level = _level(frames, odd.select("track_id", "word", F.col("start_n").alias("lo"), F.col("end_n").alias("hi")))
    odd = odd.join(level, ["track_id", "word"])
    got = _voiced_until(frames, odd.select("track_id", "word", F.col("before").alias("lo"), F.col("end_n").alias("hi"), (F.col("level") / 10).alias("floor"), "least"))
    both = odd.join(got, ["track_id", "word"]).filter("until < end_n - 1 AND until > before + 1")
    return both.select("track_id", "word", "end_n", F.col("until").alias("new_end"))


def word_end_extend(words: DataFrame, frames: DataFrame, trimmed: DataFrame) -> DataFrame:
    """(track_id, word, end_n, new_end) of words that aren't trimmed and whose voice goes on behind their end: until two silent
    frames, at most to a frame before the next word or to the track's end."""
    rest = words.join(trimmed.select("track_id", "word"), ["track_id", "word"], "left_anti").join(_track_end(frames), "track_id")
    rest = rest.select("track_id", "word", "start_n", "end_n", F.least("track_end", F.coalesce(F.col("next_start") - 1, F.col("track_end"))).alias("cap")).filter("cap - end_n >= 2")
    level = _level(frames, rest.select("track_id", "word", F.col("start_n").alias("lo"), F.col("end_n").alias("hi")))
    rest = rest.join(level, ["track_id", "word"])
    got = _voiced_until(frames, rest.select("track_id", "word", F.col("end_n").alias("lo"), F.col("cap").alias("hi"), (F.col("level") / 10).alias("floor"), F.lit(2).alias("least")))
    return rest.join(got, ["track_id", "word"]).filter("until > end_n + 1").select("track_id", "word", "end_n", F.col("until").alias("new_end"))


def merge_adjustments(trims: DataFrame, extensions: DataFrame) -> DataFrame:
    """track_id, word, new_end: a trim goes before an extension."""
    a, b = trims.select("track_id", "word", F.col("new_end").alias("a")), extensions.select("track_id", "word", F.col("new_end").alias("b"))
    return a.join(b, ["track_id", "word"], "full_outer").select("track_id", "word", F.coalesce("a", "b").alias("new_end"))


def word_prefix(first_of_track: Column, first_of_line: Column) -> Column:
    return F.when(first_of_track, "").when(first_of_line, "\n").otherwise(" ")


def syllable_timings(words: DataFrame, parts: DataFrame, firsts: DataFrame, starts: DataFrame, ends: DataFrame, frame: float = FRAME) -> DataFrame:
    """parts: track_id, word, j, text. Each part's text (the word's first one with its prefix), start and end in seconds: the
    adjusted word's time, at least 0.05 s, split in proportion to the parts' characters (one at least each)."""
    order = W.Window.partitionBy("track_id").orderBy("word")
    times = words.join(starts.select("track_id", "word", "new_start"), ["track_id", "word"], "left").join(ends.select("track_id", "word", "new_end"), ["track_id", "word"], "left")
    times = times.join(firsts.select("track_id", "word", F.lit(True).alias("line")), ["track_id", "word"], "left")
    low, high = F.coalesce("new_start", "start_n") * F.lit(frame), F.coalesce("new_end", "end_n") * F.lit(frame)
    times = times.select("track_id", "word", low.alias("low"), F.when(high <= low, low + 0.05).otherwise(high).alias("high"), word_prefix(F.row_number().over(order) == 1, F.coalesce("line", F.lit(False))).alias("prefix"))
    size = F.greatest(F.length(F.trim("text")), F.lit(1))
    own = W.Window.partitionBy("track_id", "word")
    rows = parts.select("track_id", "word", "j", "text", F.sum(size).over(own.orderBy("j")).alias("upto"), size.alias("size"), F.sum(size).over(own).alias("all")).join(times, ["track_id", "word"])
    at = lambda n: F.round(F.col("low") + (F.col("high") - F.col("low")) * n / F.col("all"), 3)
    text = F.when(F.col("upto") == F.col("size"), F.concat("prefix", "text")).otherwise(F.col("text"))
    return rows.select("track_id", "word", "j", text.alias("text"), at(F.col("upto") - F.col("size")).alias("start"), at(F.col("upto")).alias("end"))


def alignment_stats(timed: DataFrame) -> DataFrame:
    """track_id, words, split: words with times, and those whose time is split among several parts."""
    own = timed.groupBy("track_id", "word").agg(F.count("*").alias("parts"))
    return own.groupBy("track_id").agg(F.count("*").alias("words"), F.count(F.when(F.col("parts") > 1, 1)).alias("split"))


def reduction(intervals: DataFrame, frames: DataFrame) -> DataFrame:
    """track_id, original and kept frames, and the reduction in per cent."""
    kept = intervals.groupBy("track_id").agg(F.sum(F.col("end_n") - F.col("start_n")).alias("kept"))
    total = frames.groupBy("track_id").agg(F.count("*").alias("original"))
    return total.join(kept, "track_id").select("track_id", "original", "kept", F.round((1 - F.col("kept") / F.col("original")) * 100, 1).alias("reduction_pct"))
