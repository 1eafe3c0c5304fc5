"""Lyrics sheets: sections and their repeats, search fragments, line breaks. Spark functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.stems import bound
from ..functions.text import tokenize

#: How a repeat is written. Latin x, Cyrillic х and the multiplication sign; "times" in two languages.
_COUNT = r"(?:[xх×]\s*(\d+)|(\d+)\s*[xх×]|(\d+)\s*раз[аовы]*|(\d+)\s*times?)"
HEADER = r"^\s*\[\s*([^\[\]\n]+?)\s*\]\s*$"
COUNT = "(?iu)" + _COUNT
BRACKETED = r"(?iu)\s*[\(\[]\s*" + _COUNT + r"\s*[\)\]]\s*$"
BARE = r"\s+(?:×\s*(\d+)|(\d+)\s*×)\s*$"
#: What both of these end in. Blanks, and line ends that $ looks past.
ENDS = r"[)\]×0-9]\s*$"
BLANKS, LINE_ENDS = " \t\n\x0b\f\r", "\x85\u2028\u2029"


#: The greatest count that is written out; larger ones, whatever their length, count as this.
MOST = 1000


def _count(text: Column, pattern: str, groups: int) -> Column:
    """The largest number that the pattern's groups find, 1 at least and MOST at most."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in range(1, groups + 1)]
    return F.array_max(F.concat(F.array(F.lit(1)), F.transform(F.filter(F.concat(*found), lambda x: x != ""), lambda x: F.least(F.coalesce(x.try_cast("int"), F.lit(MOST)), F.lit(MOST)))))


def _last_in(text: Column, letters: str) -> Column:
    """Whether the last letter is one of these; an empty text has none of others. Far cheaper than a pattern, which is then asked of few."""
    return F.lit(letters).contains(F.substring(text, F.lit(-1), F.lit(1)))


def _trimmed(text: Column) -> Column:
    pattern = F.lit(BLANKS).contains(F.substring(text, F.lit(1), F.lit(1))) | _last_in(text, BLANKS + LINE_ENDS)
    return F.when(pattern, F.regexp_replace(text, r"^\s+|\s+$", "")).otherwise(text)


def section_ids(sheets: DataFrame) -> DataFrame:
    """sheets: id, text. A row for each line: id, pos, line, header (null without one), section: how many headers so far."""
    lines = sheets.select("id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("pos", "line"))
    header = F.when(F.col("line").rlike(HEADER), F.regexp_extract("line", HEADER, 1))
    order = W.Window.partitionBy("id").orderBy("pos")
    return lines.withColumn("header", header).withColumn("section", F.count("header").over(order))


def sections(sheets: DataFrame) -> DataFrame:
    """id, section, label (lower case without counts, null without one), count, body (its lines, blank ends off)."""
    # Arrays exploded as rows are worked out once; no line is a row.
    lines = sheets.select("id", F.explode(F.array(F.split("text", r"\r\n|\n|\r"))).alias("ls"))
    found = F.transform("ls", lambda x, i: F.struct(i.alias("at"), F.when(x.contains("[") & x.rlike(HEADER), F.regexp_extract(x, HEADER, 1)).alias("header")))
    start = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("header")))
    heads = lines.select("id", "ls", F.explode(F.array(F.concat(start, F.filter(found, lambda h: h["header"].isNotNull())))).alias("hs"))

    def part(h: Column, k: Column) -> Column:
        n = F.coalesce(F.get("hs", k + 1)["at"], F.size("ls")) - h["at"] - 1
        body = bound(F.array_join(F.slice("ls", h["at"] + 2, n), "\n"), _trimmed)
        return F.struct(k.cast("long").alias("section"), h["header"].alias("header"), body.alias("body"), ((k > 0) | (n > 0)).alias("there"))

    one = heads.select("id", F.inline(F.transform("hs", part))).filter("there")
    label = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace("header", COUNT, ""), r"\s+", " "), r"^[ :;,-]+|[ :;,-]+$", ""))
    return one.select("id", "section", F.when(label != "", label).alias("label"), F.coalesce(_count(F.col("header"), COUNT, 4), F.lit(1)).alias("count"), "body")


def last_body_by_label(rows: DataFrame) -> DataFrame:
    """A section of a header alone takes the latest body before it under the same label; without one it goes."""
    before = W.Window.partitionBy("id", "label").orderBy("section")
    known = F.last(F.when(F.col("body") != "", F.col("body")), ignorenulls=True).over(before)
    return rows.withColumn("body", F.when(F.col("body") != "", F.col("body")).when(F.col("label").isNotNull(), known)).filter("body IS NOT NULL")


def _repeated_lines(body: Column) -> Column:
    """Lines that end in a repeat count as often as that says, without it; lines of nothing else go."""

    def lines(line: Column) -> Column:
        # Most lines don't end as a repeat does; of others each value is worked out once.
        may = _last_in(line, ")]×0123456789" + BLANKS + LINE_ENDS) & line.rlike(ENDS)
        return F.when(may, ending(line, BRACKETED, ending(line, BARE, F.array(line)))).otherwise(F.array(line))

    def ending(line: Column, pattern: str, other: Column) -> Column:
        return bound(F.regexp_extract(line, pattern, 0), lambda m: F.when(m != "", repeated(line, m, pattern)).otherwise(other))

    def repeated(line: Column, match: Column, pattern: str) -> Column:
        """match: what the pattern finds; it has one number."""
        n = F.greatest(F.lit(1), F.least(F.coalesce(F.regexp_extract(match, r"\d+", 0).try_cast("int"), F.lit(MOST)), F.lit(MOST)))
        base = F.regexp_replace(F.regexp_replace(line, pattern, ""), r"\s+$", "")
        return bound(base, lambda x: F.when(F.trim(x) == "", F.array().cast("array<string>")).otherwise(F.array_repeat(x, n)))

    return F.array_join(F.flatten(F.transform(F.split(body, "\n"), lines)), "\n")


def expand_repeats(sheets: DataFrame) -> DataFrame:
    """id, text: every section as often as its header says, references filled in, repeated lines written out; a blank line between."""
    rows = last_body_by_label(sections(sheets).repartition("id")).withColumn("block", _repeated_lines(F.col("body")))
    whole = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("section", "count", "block"))).alias("s"))
    # Blank blocks go here: a filter on rows would work out each block twice.
    some = F.filter("s", lambda x: F.trim(x["block"]) != "")
    text = F.array_join(F.flatten(F.transform(some, lambda x: F.array_repeat(x["block"], x["count"]))), "\n\n")
    return sheets.select("id").join(whole.select("id", text.alias("text")), "id", "left").select("id", F.coalesce("text", F.lit("")).alias("text"))


def _chunks(words: Column, size: Column) -> Column:
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(1), F.size(words), size), lambda k: F.array_join(F.slice(words, k, size), " "))).otherwise(F.array().cast("array<string>"))


def search_fragments(rows: DataFrame, n: int = 3, text: str = "text") -> DataFrame:
    """Adds `fragments`: up to n phrases of at most 12 words from the start, the middle and the end of a text; phrases of less than 5
    words only where there is nothing else; few phrases: chunks of 8 to 12 words."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    out = rows.withColumn("_words", tokenize(F.col(text))).withColumn("_cut", F.filter(F.transform(F.split(text, r"[.!?\n]+"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != ""))
    whole = F.when(trimmed != "", F.array(trimmed)).otherwise(F.array().cast("array<string>"))
    first = F.when(F.size("_cut") > 0, F.col("_cut")).otherwise(_chunks(F.col("_words"), F.lit(10)))
    out = out.withColumn("_long", F.filter(first, lambda p: F.size(tokenize(p)) >= 5))
    out = out.withColumn("_some", F.when(F.size("_long") > 0, F.col("_long")).otherwise(F.col("_cut")))
    size = F.greatest(F.lit(8), F.least(F.lit(12), F.floor(F.size("_words") / n).cast("int")))
    out = out.withColumn("_some", F.when((F.size("_some") < n) & (F.size("_some") > 0) & (F.size("_words") >= n * 5), _chunks(F.col("_words"), size)).otherwise(F.col("_some")))
    short = F.transform("_some", lambda p: F.array_join(F.slice(tokenize(p), 1, 12), " "))
    spread = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(short, F.bround(i * (F.size("_some") - 1) / max(n - 1, 1)).cast("int")))
    nothing = (F.size("_some") == 0) | ((F.size("_cut") == 0) & (F.size("_words") < 3))
    return out.withColumn("fragments", F.when(nothing, whole).when(F.size("_some") <= n, short).otherwise(spread)).drop("_words", "_cut", "_long", "_some")


def _break_indices(rows: Column, threshold: Column, most: int) -> Column:
    """Places of the rows (syllable, gap) that open a line: at a word behind a gap over the threshold, or at a word once the line
    has more than `most` characters. The line's length starts anew at each break, so rows are taken in their order."""

    def step(a: Column, r: Column) -> Column:
        opens = r["syllable"].startswith(" ") & ((r["gap"] > threshold) | (a["chars"] > most)) & (a["i"] > 0)
        size = F.length(r["syllable"])
        return F.struct((a["i"] + 1).alias("i"), F.when(opens, size).otherwise(a["chars"] + size).alias("chars"), F.when(opens, F.concat(a["at"], F.array(a["i"]))).otherwise(a["at"]).alias("at"))

    return F.aggregate(rows, F.struct(F.lit(0).alias("i"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("at")), step)["at"]


def _bar_indices(rows: Column, bars: Column) -> Column:
    """For each bar but the first in turn, the first word that isn't used yet and starts at most 0.3 s before the bar."""

    def step(a: Column, r: Column) -> Column:
        opens = (a["i"] > 0) & r["syllable"].startswith(" ") & F.coalesce(r["start"] >= F.get(bars, a["bar"]) - 0.3, F.lit(False))
        return F.struct((a["i"] + 1).alias("i"), F.when(opens, a["bar"] + 1).otherwise(a["bar"]).alias("bar"), F.when(opens, F.concat(a["at"], F.array(a["i"]))).otherwise(a["at"]).alias("at"))

    return F.aggregate(rows, F.struct(F.lit(0).alias("i"), F.lit(1).alias("bar"), F.array().cast("array<int>").alias("at")), step)["at"]


def bars_to_words(timings: DataFrame, beats: DataFrame) -> DataFrame:
    """beats: track_id, t. track_id, breaks: the bar of every fourth beat at its word (a track's rows and beats are one list each)."""
    bars = beats.withColumn("k", F.row_number().over(W.Window.partitionBy("track_id").orderBy("t")) - 1).filter("k % 4 = 0")
    bars = bars.groupBy("track_id").agg(F.array_sort(F.collect_list("t")).alias("bars"))
    rows = timings.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("n", "syllable", "start"))).alias("rows"))
    return rows.join(bars, "track_id").select("track_id", _bar_indices(F.col("rows"), F.col("bars")).alias("breaks"))


def inject_break(syllable: Column) -> Column:
    """A leading space becomes a line feed; without one it is put before the text."""
    return F.when(syllable.startswith(" "), F.concat(F.lit("\n"), F.substring(syllable, F.lit(2), F.length(syllable)))).when(syllable.startswith("\n"), syllable).otherwise(F.concat(F.lit("\n"), syllable))


def line_breaks(timings: DataFrame, beats: DataFrame | None = None, most: int = 50) -> DataFrame:
    """timings: track_id, n (from 0), syllable, start, end. Adds `opens` and `marked`. Five gaps over 0.4 s: breaks at gaps over 2.5 times the
    75th percentile, 0.3 s at least; fewer: at bars where a track has four beats or more, else at gaps as before, over 0.2 s at
    least. Tracks of one row or with marks already stay as they are."""
    own = W.Window.partitionBy("track_id")
    gap = F.col("start") - F.lag("end").over(own.orderBy("n"))
    rows = timings.withColumn("gap", gap).groupBy("track_id").agg(
        F.array_sort(F.collect_list(F.struct("n", "syllable", "start", "gap"))).alias("rows"), F.percentile("gap", F.lit(0.75)).alias("p75"),
        F.count(F.when(F.col("gap") > 0.4, 1)).alias("wide"), F.max(F.col("syllable").startswith("\n")).alias("done"),
    )
    if beats is not None:
        many = beats.groupBy("track_id").agg(F.count("*").alias("beats"))
        rows = rows.join(many, "track_id", "left").join(bars_to_words(timings, beats).withColumnRenamed("breaks", "bars"), "track_id", "left")
    else:
        rows = rows.withColumn("beats", F.lit(0)).withColumn("bars", F.array().cast("array<int>"))
    floor = F.when(F.col("wide") >= 5, 0.3).otherwise(0.2)
    at = F.when(F.col("done") | (F.size("rows") < 2), F.array().cast("array<int>")).when((F.col("wide") < 5) & (F.coalesce("beats", F.lit(0)) >= 4), F.col("bars")).otherwise(
        _break_indices(F.col("rows"), F.greatest(floor, F.col("p75") * 2.5), most)
    )
    breaks = rows.select("track_id", F.explode(at.cast("array<bigint>")).alias("n"))
    return timings.join(breaks.withColumn("opens", F.lit(True)), ["track_id", "n"], "left").withColumn("opens", F.coalesce("opens", F.lit(False))).withColumn(
        "marked", F.when(F.col("opens"), inject_break(F.col("syllable"))).otherwise(F.col("syllable"))
    )
