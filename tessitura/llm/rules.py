"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Defined results: a null or empty text has no words, fails the base rule and isn't kept. Lines and
windows are counted over the whole text whatever its length. Repeated rows get equal results, one
each. Extra columns of the input are not read, but for those in `carry`, which go with their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, id_and_text

#: Frequent short words of the languages that the rules know.
STOP_WORDS = {
    "en": "the of and to a in is it be as with for on that this by are was from at an or",
    "fr": "de la le et les des en un une du que qui dans par pour sur au ou est",
    "de": "der die und das in den von zu mit ist des sich ein dem nicht eine im auf",
    "es": "de la que el en y los del se las por un para con una su al es",
}
SYMBOLS = "#*$%&|<>"

#: name of a measure, least value, greatest value: a text is kept if every measure lies between them. None: no bound.
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("mean_word_chars", 1.5, 20.0),
    ("symbols_per_word", None, 0.25),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
]


def _windows(words: Column) -> Column:
    """A struct for each 3-word window, sorted: its hash, its words, its place. Equal windows become neighbours, whatever
    other windows have the same hash."""
    return F.sort_array(
        F.transform(
            F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
            lambda w, i: F.struct(
                F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("hash"),
                w.alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("place"),
            ),
        )
    )


def _repeated(windows: Column) -> Column:
    """The places of the windows that are found twice or more: equal to a neighbour."""

    def equal(x: Column, y: Column) -> Column:
        return (x["hash"] == y["hash"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    return F.transform(F.filter(windows, lambda x, i: equal(x, F.get(windows, i + 1)) | equal(x, F.get(windows, i - 1))), lambda x: x["place"])


def _covered(places: Column) -> Column:
    """How many words the windows at these places cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda x: F.array(*[x + k for k in range(3)]))))).cast("long")


def measures(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, all counts and ratios that the rules use, and the columns in `carry`."""
    text = F.col("text")
    whole = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(whole, WORD_GAP))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stops = sorted({w for x in STOP_WORDS.values() for w in x.split()})
    carried = ["_carried"] if carry else []
    rows = id_and_text(docs, *([F.struct(*carry).alias("_carried")] if carry else []))
    first = rows.select("doc_id", "text", *carried, words.alias("_words"), lines.alias("_lines"))
    second = first.select("doc_id", "text", *carried, "_words", "_lines", _windows(F.col("_words")).alias("_windows"))
    third = second.select("doc_id", "text", *carried, "_words", "_lines", _repeated(F.col("_windows")).alias("_again"))
    # One struct, exploded: a filter on the verdict then stays above it. Pushed below, it would repeat the expressions on
    # the sorted windows for each element of an array.
    counts = third.select(
        "doc_id", *carried,
        F.explode(F.array(F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("_again")).alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"),
        F.size(F.filter("_words", lambda w: w.isin(stops))).alias("_stops"),
        ))).alias("c"),
    ).select("doc_id", *carried, "c.*")
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return counts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        per(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        per(F.col("n_symbols"), F.col("n_words")).alias("symbols_per_word"),
        per(F.col("_stops"), F.col("n_words")).alias("stop_word_ratio"),
        per(F.col("n_dup_lines"), F.col("_n_lines")).alias("dup_line_ratio"),
        *(F.col(f"_carried.{c}").alias(c) for c in carry),
    )


def verdict(thresholds=THRESHOLDS) -> Column:
    """The table as one boolean expression."""
    ok = F.lit(True)
    for name, least, most in thresholds:
        for bound in ([F.col(name) >= least] if least is not None else []) + ([F.col(name) <= most] if most is not None else []):
            ok = ok & bound
    return ok


def quality_rules(docs: DataFrame, thresholds=THRESHOLDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: counts, ratios, base_failed, kept and the columns in `carry`."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(docs, carry).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(thresholds))
