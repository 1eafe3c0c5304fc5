"""Words of one text against the words of another, for many pairs of texts.

Pairs lie in a grid: both sides are dealt into blocks by a hash of their ids, and a cell holds the pairs of two blocks and each text
of these once. A row is a text or a pair, never a pair and a word. In a cell each distinct word that a text's partners lack in it is
compared with the text's own words once, however many partners have that word: by equal keys first, then by the similarity ratio with words
whose length differs by at most `band`. An upper bound from the letters that two words don't have in common rules most of these
out; common subsequences of the others are worked out for all of them at a time, one bit for each place of a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import ratio
from ..sources.shared import written

#: Comparisons at a time.
SLICE = 1 << 20
KEYS = ("lemma", "skeleton", "phonetic")


class Words:
    """Distinct words with what comparisons need: letters as small numbers, lengths, one of 64 bits for each letter and the how-manieth it is."""

    def __init__(self, words: list[str], letters: dict[str, int]):
        self.words = words
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.letters = np.zeros((len(words), min(max(int(self.sizes.max(initial=0)), 1), 63)), np.int32)  # longer words are compared one at a time
        self.bits = np.zeros(len(words), np.uint64)
        for k, w in enumerate(words):
            mask, seen = 0, {}
            for j, c in enumerate(w):
                code = letters.setdefault(c, len(letters) + 1)
                if j < 63:
                    self.letters[k, j] = code
                times = seen[c] = seen.get(c, -1) + 1
                mask |= 1 << ((code * 7 + times * 29) & 63)
            self.bits[k] = mask


def common_lengths(a: Words, x: np.ndarray, b: Words, y: np.ndarray, letters: int) -> np.ndarray:
    """Lengths of the longest common subsequences of a's words x and b's words y, of at most 63 letters, place by place."""
    own, at = np.unique(x, return_inverse=True)
    table = np.zeros((len(own), letters + 1), np.uint64)
    for k in range(int(a.sizes[own].max(initial=0))):
        table[np.arange(len(own)), a.letters[own, k]] |= np.uint64(1) << np.uint64(k)
    table[:, 0] = 0  # behind the end
    row = np.full(len(x), np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(int(b.sizes[y].max(initial=0))):
        hit = row & table[at, b.letters[y, k]]
        row = (row + hit) | (row - hit)
    full = (np.uint64(1) << a.sizes[x].astype(np.uint64)) - np.uint64(1)
    return np.bitwise_count(~row & full).astype(np.int64)


def best_ratios(a: Words, x: np.ndarray, b: Words, y: np.ndarray, letters: int, band: int, least: float) -> np.ndarray:
    """For each of a's words x the highest ratio with b's words y whose length differs by at most `band`; 0 where none has `least`, -1 where
    none has such a length."""
    y = y[np.argsort(b.sizes[y], kind="stable")]
    out = np.full(len(x), -1.0)
    if not len(x) or not len(y):
        return out
    first, last = np.searchsorted(b.sizes[y], a.sizes[x] - band), np.searchsorted(b.sizes[y], a.sizes[x] + band, "right")
    n = last - first
    out[n > 0] = 0.0
    ends = np.cumsum(n)
    low = 0
    while low < len(x):  # about SLICE comparisons at a time, one word at least
        high = max(int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE, "right")), low + 1)
        some = np.arange(low, high)
        i = np.repeat(some, n[some])
        j = np.arange(len(i)) - np.repeat(np.cumsum(n[some]) - n[some], n[some]) + np.repeat(first[some], n[some])
        p, q = x[i], y[j]
        sizes = a.sizes[p] + b.sizes[q]
        lack = lambda u, v: np.bitwise_count(u & ~v).astype(np.int64)
        most = np.minimum(a.sizes[p] - lack(a.bits[p], b.bits[q]), b.sizes[q] - lack(b.bits[q], a.bits[p]))
        may = np.flatnonzero(200 * most >= least * sizes)
        i, p, q, sizes = i[may], p[may], q[may], sizes[may]
        long = (a.sizes[p] > 63) | (b.sizes[q] > 63)
        got = np.zeros(len(p))
        got[~long] = 200.0 * common_lengths(a, p[~long], b, q[~long], letters) / sizes[~long]
        got[long] = [ratio(a.words[u], b.words[v]) for u, v in zip(p[long].tolist(), q[long].tolist(), strict=True)]
        np.maximum.at(out, i, np.where(got >= least, got, 0.0))
        low = high
    return out


def packed_texts(words: DataFrame) -> DataFrame:
    """words: id, word, and, if they are there, count and KEYS. A row for each text."""
    keys = [F.xxhash64(F.lit(k[0]), k).alias(k) if k in words.columns else F.lit(None).cast("long").alias(k) for k in KEYS]
    known = [F.when(F.col(k) != "", h).alias(k) if k in words.columns else h for k, h in zip(KEYS, keys, strict=True)]
    count = F.col("count") if "count" in words.columns else F.lit(1).cast("long").alias("count")
    rows = words.select("id", F.struct("word", count, *known).alias("w"))
    some = rows.groupBy("id").agg(F.collect_list("w").alias("w"))
    return some.select("id", F.col("w.word").alias("words"), F.col("w.count").alias("counts"), F.flatten(F.transform("w", lambda x: F.array(*(F.coalesce(x[k], F.lit(0)) for k in KEYS)))).alias("keys"))


def cells(pairs: DataFrame, left: DataFrame, right: DataFrame, block: int) -> DataFrame:
    """pairs: a, b (distinct); left, right: of packed_texts(). Rows of a cell (i, j): its pairs, and their texts once."""
    pairs = written(pairs.select("a", "b"))
    sizes = pairs.agg(F.count_distinct("a").alias("a"), F.count_distinct("b").alias("b")).first()
    deal = lambda c: F.pmod(F.xxhash64(c), F.lit(max(1, -(-sizes[c] // block)))).cast("int")
    placed = pairs.select(deal("a").alias("i"), deal("b").alias("j"), "a", "b")
    text = lambda x, c: placed.select("i", "j", c).distinct().join(x.withColumnRenamed("id", c), c)
    none = {k: F.lit(None).cast(t) for k, t in (("words", "array<string>"), ("counts", "array<bigint>"), ("keys", "array<bigint>"))}
    of_a, of_b = text(left, "a").withColumn("b", F.lit(None).cast(dict(pairs.dtypes)["b"])), text(right, "b").withColumn("a", F.lit(None).cast(dict(pairs.dtypes)["a"]))
    return placed.withColumns(none).unionByName(of_a).unionByName(of_b)


class Cell:
    def __init__(self, pdf: pd.DataFrame):
        text = pdf["words"].notna()
        self.letters: dict[str, int] = {}
        self.a, self.b = (self._side(pdf[text & pdf[other].isna()], own) for own, other in (("a", "b"), ("b", "a")))
        both = pdf[~text]
        self.pairs = [(b, both["a"].to_numpy()[k]) for b, k in both.groupby("b", sort=False).indices.items()]

    def _side(self, pdf: pd.DataFrame, own: str) -> tuple[Words, np.ndarray, dict]:
        """Distinct words; their keys; by text the words' numbers and counts."""
        numbers: dict[str, int] = {}
        keys, texts = [], {}
        for id, words, counts, of in zip(pdf[own], pdf["words"], pdf["counts"], pdf["keys"], strict=True):
            fresh = len(numbers)
            at = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
            new = np.flatnonzero(at >= fresh)
            keys.append(np.asarray(of, np.int64).reshape(-1, len(KEYS))[new])
            texts[id] = at, np.asarray(counts, np.int64)
        return Words(list(numbers), self.letters), np.concatenate([*keys, np.empty((0, len(KEYS)), np.int64)]), texts

    def levels(self, band: int | None, least: float, by_keys: bool) -> Iterator[tuple]:
        """b, its partners, and for their words (by number) the best ratio: 100 for equal words, 99 for equal keys where by_keys is set. Without
        a band no ratio is worked out."""
        left, keys, texts = self.a
        right, other_keys, others = self.b
        same = {w: k for k, w in enumerate(left.words)}
        as_left = np.fromiter((same.get(w, -1) for w in right.words), np.int64, len(right.words))
        best = np.empty(len(left.words))
        for b, partners in self.pairs:
            asked = np.unique(np.concatenate([texts[a][0] for a in partners]))
            own = others[b][0]
            best[asked] = -2.0
            have = as_left[own]
            best[have[have >= 0]] = 100.0
            open_ = asked[best[asked] == -2.0]
            if by_keys:
                hit = np.isin(keys[open_], other_keys[own]) & (keys[open_] != 0)
                best[open_[hit.any(axis=1)]] = 99.0
                open_ = open_[~hit.any(axis=1)]
            best[open_] = best_ratios(left, open_, right, own, len(self.letters), band, least) if band is not None else 0.0
            yield b, partners, best


def word_scores(pairs: DataFrame, left: DataFrame, right: DataFrame, band: int = 2, block: int = 256) -> DataFrame:
    """left, right: id, word, count and KEYS. a, b, coverage (share of the words of a that score 2 or more), rate (their scores by 3 a word): 3 for a
    word that b has, 2 for one that it has by lemma, skeleton or sound or with a ratio of 80, 1 with a ratio of 60."""
    kind = dict(pairs.dtypes)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        cell, out = Cell(pdf), []
        texts = cell.a[2]
        for b, partners, best in cell.levels(band, 60.0, True):
            points = np.select([best == 100.0, best >= 80.0, best >= 60.0], [3, 2, 1], 0)
            for a in partners:
                at, n = texts[a]
                out.append((a, b, int(n[points[at] >= 2].sum()) / int(n.sum()), int((points[at] * n).sum()) / (3 * int(n.sum()))))
        return pd.DataFrame(out, columns=["a", "b", "coverage", "rate"])

    return cells(pairs, packed_texts(left), packed_texts(right), block).groupBy("i", "j").applyInPandas(score, f"a {kind['a']}, b {kind['b']}, coverage double, rate double")


def lacking_words(pairs: DataFrame, left: DataFrame, right: DataFrame, block: int = 256) -> DataFrame:
    """left, right: id, word, count and KEYS. For each pair whose a has words that b lacks: a, b, words and occurrences of these, and found:
    how many of the words b has by lemma, skeleton or sound."""
    kind = dict(pairs.dtypes)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        cell, out = Cell(pdf), []
        for b, partners, best in cell.levels(None, 0.0, True):
            for a in partners:
                at, n = cell.a[2][a]
                lost = best[at] < 100
                if lost.any():
                    out.append((a, b, int(lost.sum()), int(n[lost].sum()), int((best[at] == 99).sum())))
        return pd.DataFrame(out, columns=["a", "b", "words", "occurrences", "found"])

    return cells(pairs, packed_texts(left), packed_texts(right), block).groupBy("i", "j").applyInPandas(count, f"a {kind['a']}, b {kind['b']}, words long, occurrences long, found long")


def fuzzy_words(pairs: DataFrame, left: DataFrame, right: DataFrame, band: int = 2, block: int = 256) -> DataFrame:
    """left, right: id, word. a, b, word (of a), best: the highest ratio with a word of b whose length differs by at most `band`; no row without one."""
    kind = dict(pairs.dtypes)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = Cell(pdf)
        words, _, texts = cell.a
        names = np.array(words.words, dtype=object)
        out = [pd.DataFrame({"a": [], "b": [], "word": [], "best": []})]
        for b, partners, best in cell.levels(band, 0.0, False):
            for a in partners:
                at = texts[a][0][best[texts[a][0]] >= 0]
                out.append(pd.DataFrame({"a": a, "b": b, "word": names[at], "best": best[at]}))
        return pd.concat(out)

    return cells(pairs, packed_texts(left), packed_texts(right), block).groupBy("i", "j").applyInPandas(score, f"a {kind['a']}, b {kind['b']}, word string, best double")
