"""Spelling variants: words that differ by one code point, by a variable-length gram index.

A word between two marks is decomposed into variable grams: at each place the shortest gram of `least` to `most` code points that the
frequency-pruned dictionary doesn't extend. The dictionary is a trie of which only the frequent grams are kept: a gram that
stands at more than `frequent` places of the words has all one longer grams below it, any other is a leaf. So a rare gram is short and
a frequent one is told apart by what follows it. A gram is known by its own code points alone; grams inside their
left neighbour are kept, since short words would have too few others.
Affected-gram bound: one edit touches only the grams around its place; a word's bound is the greatest number of its grams that
have a place in common. A near word shares all other grams, so that it stands in as many lists at least.
List merging: lists are merged for the rarest grams of each word, one more than the bound, those with a mark last; the longer
lists are only looked into for what these give: a word travels with a bit for each of its grams, and a pair goes if more
grams of one are missing in the other than one edit can touch. A gram that an edit leaves alone has the same text on
one of its sides in both words, and on the other side one half of the text is the same. So lists are kept in parts, by both and by the words'
length: a gram that very many words hold isn't one key. Pairs that are left are verified.
Word counts are added up by task before they move; the dictionary holds at most `bound` grams of each length, as `frequent` grows with the
vocabulary where it must, and only it is broadcast.
Defined results: a null or empty text has no words; a null doc_id counts as an empty id text; repeated rows count each time; words
without a near one stand alone; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, in_slices, written

#: Code points of a run in Latin-1, A-Z lowered; all others become a question mark.
RUN = r"[a-z\xc0-\xff]{%d,}"
#: Marks before and behind a word; no run holds them.
BEGIN, END = "^", "$"


def word_counts(docs: DataFrame, shortest: int = 5, every: int = 97, held: int = 500_000) -> DataFrame:
    """word, n of all runs of letters with at least `shortest` code points, after the change: a run loses one code point where
    `every` divides the checksum of its document's id and itself. A task adds up `held` words at most
    before it sends them on."""
    find = RUN % shortest

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        had, crc = seen.get, zlib.crc32
        runs = re.compile(find.encode("latin-1")).findall

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for ids, texts in in_slices(batches):
            for doc, text in zip(ids, texts, strict=True):
                base = crc(b":" if doc is None else b"%d:" % doc)
                for run, n in Counter(runs(text.encode("latin-1", "replace").lower())).items():
                    h = crc(run if run.isascii() else run.decode("latin-1").encode(), base)
                    if h % every:
                        seen[run] = had(run, 0) + n
                    elif len(run) > shortest:
                        cut = run[: h % len(run)] + run[h % len(run) + 1 :]
                        seen[cut] = had(cut, 0) + n
                if len(seen) >= held:
                    yield rows()
        if seen:
            yield rows()

    return id_and_text(docs).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def gram_dictionary(words: DataFrame, least: int, most: int, frequent: int, bound: int) -> dict[str, int]:
    """The grams that have longer ones below them, with the number of places where they stand."""
    if least == most:
        return {}
    marked = words.select(F.concat(F.lit(BEGIN), "word", F.lit(END)).alias("w"))
    total = marked.agg(F.sum(F.length("w"))).first()[0] or 0
    frequent = max(frequent, total // bound)

    def at_places(q: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length("w") - q + 1), lambda i: F.substring(F.col("w"), i, F.lit(q)))

    grams = marked.select(F.explode(F.flatten(F.array(*(F.when(F.length("w") >= q, at_places(q)).otherwise(F.array().cast("array<string>")) for q in range(least, most))))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > frequent)
    return {r["gram"]: r["n"] for r in counts.collect()}


def decompose(word: str, inner: dict[str, int], least: int, most: int) -> list[tuple[int, int, int]]:
    """(start, length, frequency) of the grams of a marked word. The frequency is the dictionary's for the longest part of the gram
    that it knows, which no list of the gram exceeds."""
    out, n = [], len(word)
    for p in range(n - least + 1):
        q, known = least, 0
        while (f := inner.get(word[p : p + q])) is not None:
            known = f
            if q == most or p + q == n:
                break
            q += 1
        out.append((p, q, known if q == most or p + q == n else 0))
    return out


def affected(grams: list[tuple[int, int, int]], n: int) -> int:
    """The greatest number of grams that one edit of a marked word of n code points touches."""
    change = np.zeros(n + 1, np.int64)
    for p, q, _ in grams:
        change[p] += 1
        change[p + q] -= 1
    return int(np.cumsum(change)[1 : n - 1].max(initial=0))


def _postings(words: DataFrame, inner: dict[str, int], least: int, most: int) -> DataFrame:
    """word, n, bits (one of 60 for each gram, above them the bound), parts: for each of the rarest grams its length with the
    text up to its end, and the rest; then its length with the text from its start on, and the rest before it."""
    known = words.sparkSession.sparkContext.broadcast(inner)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits, parts = [], []
            for word in b["word"].to_pylist():
                w = BEGIN + word + END
                own = decompose(w, known.value, least, most)
                reach = affected(own, len(w))
                if reach >= min(len(own), 8):
                    raise ValueError(f"one edit touches every gram of {word!r}, or more than 7: shorter grams are needed")
                # One order of grams for all words; equal ones in the order of their places.
                rare = sorted(own, key=lambda x: (x[0] == 0 or x[0] + x[1] == len(w), x[2], w[x[0] : x[0] + x[1]], x[0]))[: reach + 1]
                mask = 0
                for p, q, _ in own:
                    mask |= 1 << (zlib.crc32(w[p : p + q].encode()) % 60)
                bits.append(mask | reach << 60)
                parts.append([(f"{q}{w[: p + q]}", w[p + q :]) for p, q, _ in rare if p + q < len(w)] + [(f"{q}{w[p:]}", w[:p]) for p, q, _ in rare if p])
            kind = pa.list_(pa.struct([("same", pa.string()), ("rest", pa.string())]))
            flat = [{"same": x, "rest": y} for own in parts for x, y in own]
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind.value_type))
            yield pa.RecordBatch.from_arrays([b["word"], b["n"], pa.array(bits, pa.int64()), lists], ["word", "n", "bits", "parts"])

    return words.select("word", "n").mapInArrow(cut, "word string, n long, bits long, parts array<struct<same:string,rest:string>>")


def _keys(more: int) -> Column:
    """The list parts of a word, as those of words that are longer by `more` (0 or 1). The edit is in one half of the rest, so that the
    other half is the same; a rest that is only a mark has no code point to replace or to be the added one."""
    half = F.floor((F.length("part.rest") + more) / 2).cast("int")
    halves = (F.substring(F.col("part.rest"), F.lit(1), half), F.substring(F.col("part.rest"), half + 1 - more, F.length("part.rest")))
    keys = F.array(*(F.xxhash64("part.same", F.length("word") + more, F.lit(k), x) for k, x in enumerate(halves)))
    return F.explode(F.when(F.length("part.rest") + more >= 2, keys))


def near_pairs(words: DataFrame, least: int = 2, most: int = 3, frequent: int = 64, bound: int = 1 << 16) -> DataFrame:
    """words: word (distinct), n. a, b, a_n, b_n: each pair of words that differ by exactly one inserted, deleted or replaced code
    point, once. Words have at least `most` code points if `least` is 2; a shorter one may stop the job with an error."""
    lists = written(_postings(words, gram_dictionary(words, least, most, frequent, bound), least, most))
    rows = lists.select("word", "n", "bits", F.explode("parts").alias("part"))
    side = lambda x: (F.col(c).alias(f"{x}_{c}") for c in ("word", "n", "bits"))
    a = rows.select(_keys(0).alias("key"), *side("a")).unionAll(rows.select(_keys(1).alias("key"), *side("a")))
    b = rows.select(_keys(0).alias("key"), *side("b"))
    more = F.length("b_word") - F.length("a_word")
    once = (more == 1) | (more == 0) & (F.col("a_word") < F.col("b_word"))
    grams, reach = (lambda x: F.col(f"{x}_bits").bitwiseAND((1 << 60) - 1)), (lambda x: F.shiftright(f"{x}_bits", 60))
    lost = lambda x, y: F.bit_count(grams(x).bitwiseAND(F.bitwise_not(grams(y)))) <= reach(x)
    merged = a.join(b, "key").filter(once & lost("a", "b") & lost("b", "a"))
    near = merged.filter(F.levenshtein("a_word", "b_word", 1) == 1)
    return near.groupBy(F.col("a_word").alias("a"), F.col("b_word").alias("b")).agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))


def grouped(words: DataFrame, pairs: DataFrame, times: int = 2) -> DataFrame:
    """word, n, form, form_n, n_near, root. A form has at least `times` the word's n, so that chains are short: roots are doubled
    until no word moves."""
    ways = F.explode(F.array(F.struct("a", "a_n", "b", "b_n"), F.struct(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n"))))
    best = pairs.select(ways.alias("x")).select("x.*").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("_"), F.col("b"))).alias("best"))
    most, strong = -F.col("best._"), -F.col("best._") >= times * F.col("n")
    out = words.select("word", "n").join(best, "word", "left").select(
        "word", "n", F.when(strong, F.col("best.b")).alias("form"), F.when(strong, most).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")
    )
    out = written(out)
    roots = written(out.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        next_ = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(roots.join(next_, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if moved.filter("moved").isEmpty():
            return out.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
        roots = moved.select("word", "root")


def spelling_variants(docs: DataFrame, shortest: int = 5, at_least: int = 3, every: int = 97, times: int = 2, **more) -> DataFrame:
    words = written(word_counts(docs, shortest, every).filter(F.col("n") >= at_least))
    return grouped(words, written(near_pairs(words, **more)), times)
