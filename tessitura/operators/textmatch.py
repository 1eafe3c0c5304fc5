"""Matching of noisy texts against candidate texts: blocking by shared word n-grams, then set and token measures of each pair.

Tokens and n-grams of a text are rows keyed by its id; pairs come from equi-joins on n-grams only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.similarity import best_part_ratio, hint_score, nfkc
from ..functions.stems import metaphone, stem
from ..functions.text import FOLD, clean_for_match, composite, decision, harmonic_mean, length_penalty, ngrams, phonetic_key, skeleton, tokenize
from ..sources.shared import written
from .cellwords import best_matches, best_words
from .gramcounts import document_frequency as document_frequency
from .paircells import Grid
from .wordmatch import fuzzy_words, word_scores


def grams(texts: DataFrame, n: int) -> DataFrame:
    """texts: id, text. Distinct (id, gram)."""
    # Tokens are a column of their own: inside the lambda of ngrams() an expression would run once for each n-gram.
    words = texts.select("id", tokenize(F.lower("text")).alias("words"))
    return words.select("id", F.explode(F.array_distinct(ngrams(F.col("words"), n))).alias("gram"))


def prepared(texts: DataFrame, n: int = 4, anchor_n: int = 5) -> DataFrame:
    """texts: id, text. id, size (in words), words, grams (n words) and long (anchor_n words): distinct 64-bit hashes. An n-gram's hash is that
    of its words' hashes, so that no string is joined or moved. Write it where it is used more than once."""
    # One array, exploded as a row: a filter on what is made of it then stays above. Pushed below, it would cut the text anew
    # for each n-gram.
    hashed = texts.select("id", F.explode(F.array(F.transform(tokenize(F.lower("text")), lambda w: F.xxhash64(w)))).alias("w"))

    def runs(k: int) -> Column:
        at = F.sequence(F.lit(0), F.size("w") - k)
        made = F.transform(at, lambda i: F.xxhash64(*(F.get(F.col("w"), i + j) for j in range(k))))
        return F.when(F.size("w") >= k, F.array_distinct(made)).otherwise(F.array().cast("array<bigint>"))

    return hashed.select("id", F.size("w").alias("size"), F.array_distinct("w").alias("words"), runs(n).alias("grams"), runs(anchor_n).alias("long"))


def _arrays(texts: DataFrame, n: int = 4, anchor_n: int = 5) -> DataFrame:
    return texts if "grams" in texts.columns else prepared(texts, n, anchor_n)


def candidate_pairs(requests: DataFrame, candidates: DataFrame, n: int = 4, max_df: int = 20, least: int = 3) -> DataFrame:
    """request_id, candidate_id, shared: other texts with at least `least` n-grams in common, of those that at most max_df
    candidates hold. So a join key has at most max_df candidates: the pairs stay linear in the n-grams. whole_pairs() is the
    exact way for the rest. Both sides: id, text, or prepared()."""
    own = _arrays(candidates, n).select("id", F.explode("grams").alias("gram"))
    rare = own.groupBy("gram").agg(F.count("*").alias("df")).filter(F.col("df") <= max_df)
    right = own.join(rare.select("gram"), "gram", "left_semi").select("gram", F.col("id").alias("candidate_id"))
    left = _arrays(requests, n).select(F.explode("grams").alias("gram"), F.col("id").alias("request_id"))
    pairs = left.join(right, "gram").filter("request_id <> candidate_id").groupBy("request_id", "candidate_id").agg(F.count("*").alias("shared"))
    return pairs.filter(F.col("shared") >= least)


def whole_pairs(requests: DataFrame, candidates: DataFrame, n: int = 4, least: int = 3, block: int | None = None) -> DataFrame:
    """request_id, candidate_id, shared: all other texts with at least `least` n-grams in common, however frequent those are;
    shared counts all of them. Both sides: id, text. Pairs come from a grid of cells, blocks of `block` texts on both sides (by
    default as many as the tables ask for); none is a row before the result."""
    return Grid(requests, candidates, n, least=least, block=block).pairs()


def whole_measures(requests: DataFrame, candidates: DataFrame, n: int = 4, least: int = 3, block: int | None = None) -> DataFrame:
    """What pair_measures() gives of whole_pairs()."""
    return Grid(requests, candidates, n, least=least, block=block).measures()


def whole_anchors(requests: DataFrame, candidates: DataFrame, n: int = 4, anchor_n: int = 5, least: int = 3, block: int | None = None) -> DataFrame:
    """What rare_anchor() gives of whole_pairs()."""
    return Grid(requests, candidates, n, anchor_n, least, block).measures(words=False, anchor=True)


def whole_best(requests: DataFrame, candidates: DataFrame, n: int = 4, least: int = 3, block: int | None = None) -> DataFrame:
    """Of what scored() gives of whole_pairs(): each request's best two at least, for top_two()."""

    def score(coverage_request, coverage_candidate, ngram, length, anchor):
        total = coverage_request + coverage_candidate
        f1 = np.divide(2 * coverage_request * coverage_candidate, total, out=np.zeros(len(total)), where=total > 0)
        return np.round(np.clip(0.55 * f1 + 0.15 * coverage_request + 0.10 * ngram + 0.20 * anchor - 0.10 * length, 0.0, 1.0), 9)

    return Grid(requests, candidates, n, least=least, block=block).best(score)


def whole_lacking(requests: DataFrame, candidates: DataFrame, n: int = 4, least: int = 3, block: int | None = None) -> DataFrame:
    """request_id, candidate_id, words, occurrences, found: what token_match() gives of whole_pairs(), summed for each pair that lacks a word; words in lower
    case, by skeleton and phonetic key."""
    grid = Grid(requests, candidates, n, least=least, block=block)
    return grid.lacking(word_rows(grid.texts.select(F.col("class").alias("id"), "text")), ("skeleton", "phonetic"))


def measured(pairs: DataFrame, requests: DataFrame, candidates: DataFrame, n: int = 4, anchor_n: int = 5) -> DataFrame:
    """pair_measures(), and for the anchor the longer n-grams that a pair shares and how many the candidate has. Each pair meets both
    texts' arrays once. Both sides: id, text, or prepared()."""
    side = lambda x, name: _arrays(x, n, anchor_n).select(F.col("id").alias(f"{name}_id"), *(F.col(c).alias(f"{name}_{c}") for c in ("size", "words", "grams", "long")))
    both = pairs.select("request_id", "candidate_id").join(side(requests, "request"), "request_id").join(side(candidates, "candidate"), "candidate_id")
    common = F.size(F.array_intersect("request_words", "candidate_words"))
    shared = F.size(F.array_intersect("request_grams", "candidate_grams"))
    union = F.size("request_grams") + F.size("candidate_grams") - shared
    return both.select(
        "request_id", "candidate_id",
        (common / F.size("request_words")).alias("coverage_request"), (common / F.size("candidate_words")).alias("coverage_candidate"),
        (shared / union).alias("ngram"), length_penalty(F.col("candidate_size"), F.col("request_size")).alias("length"),
        F.array_intersect("request_long", "candidate_long").alias("shared"), F.size("candidate_long").alias("size"),
    )


def pair_measures(pairs: DataFrame, requests: DataFrame, candidates: DataFrame, n: int = 4) -> DataFrame:
    """For each pair: shares of the distinct tokens that the other text holds too, n-gram Jaccard, length penalty."""
    return measured(pairs, requests, candidates, n).drop("shared", "size")


def _anchors(rows: DataFrame) -> DataFrame:
    """rows: of measured(). The sum of 1 / df over a pair's shared n-grams by the candidate's n-grams, then by the largest in the
    request's pool; df: how many candidates of the pool hold the n-gram, which are those that share it with the request."""
    each = rows.select("request_id", "candidate_id", F.explode("shared").alias("gram"))
    df = F.count("*").over(W.Window.partitionBy("request_id", "gram"))
    sums = each.withColumn("df", df).groupBy("request_id", "candidate_id").agg(F.sum(1 / F.col("df")).alias("s"))
    raw = rows.select("request_id", "candidate_id", "size").join(sums, ["request_id", "candidate_id"], "left").withColumn("raw", F.coalesce(F.when(F.col("size") > 0, F.col("s") / F.col("size")), F.lit(0.0)))
    most = F.max("raw").over(W.Window.partitionBy("request_id"))
    return raw.select("request_id", "candidate_id", F.when(most > 0, F.col("raw") / most).otherwise(0.0).alias("anchor"))


def rare_anchor(pairs: DataFrame, requests: DataFrame, candidates: DataFrame, n: int = 5) -> DataFrame:
    return _anchors(written(measured(pairs, requests, candidates, anchor_n=n).select("request_id", "candidate_id", "shared", "size")))


def scored(pairs: DataFrame, requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """request_id, candidate_id, score, from equal words alone. match_words() below also takes words that look or sound alike."""
    rows = written(measured(pairs, requests, candidates))
    m = rows.join(_anchors(rows), ["request_id", "candidate_id"])
    f1 = harmonic_mean(F.col("coverage_request"), F.col("coverage_candidate"))
    score = composite(f1, F.col("coverage_request"), F.col("ngram"), F.col("anchor"), F.lit(0.0), F.col("length"))
    return m.select("request_id", "candidate_id", F.round(score, 9).alias("score"))


def word_rows(texts: DataFrame, lexicon: DataFrame | None = None, language: str | None = None) -> DataFrame:
    """id, word, count and the word's features: lemma, skeleton, phonetic key, worked out once for each distinct word. The lemma is that of
    the lexicon (word, lemma), else the stem of the language (en, ru), else the word; with a language the key is the metaphone. Texts are cleaned already."""
    rows = texts.select("id", F.explode(tokenize(F.col("text"))).alias("word")).groupBy("id", "word").agg(F.count("*").alias("count"))
    sound = metaphone(F.translate("word", *FOLD)) if language else phonetic_key(F.col("word"))
    words = rows.select("word").distinct().select("word", stem(F.col("word"), language).alias("own"), skeleton(F.col("word")).alias("skeleton"), sound.alias("phonetic"))
    if lexicon is not None:
        words = words.join(lexicon.select("word", "lemma"), "word", "left")
    lemma = F.coalesce("lemma", "own") if lexicon is not None else F.col("own")
    return rows.join(words.select("word", lemma.alias("lemma"), "skeleton", "phonetic"), "word").select("id", "word", "count", "lemma", "skeleton", "phonetic")


def token_match(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs: a, b; left, right: word_rows() of the texts a and b. A row for each distinct word of a that b lacks: a, b, word, count, found:
    whether b has a word of the same lemma, skeleton or phonetic key. Words that both have are known from the two texts' word
    lists and make no rows."""
    words = lambda x, i: x.groupBy(F.col("id").alias(i)).agg(F.collect_list("word").alias(f"{i}_words"))
    lacking = pairs.select("a", "b").join(words(left, "a"), "a").join(words(right, "b"), "b").select("a", "b", F.explode(F.array_except("a_words", "b_words")).alias("word"))
    keys = lambda *c: F.filter(F.array(*(F.when(F.col(x) != "", F.concat(F.lit(x[0]), F.col(x))) for x in c)), lambda k: k.isNotNull())
    rows = lacking.join(left.select(F.col("id").alias("a"), "word", "count", keys("lemma", "skeleton", "phonetic").alias("keys")), ["a", "word"])
    index = right.select(F.col("id").alias("b"), F.explode(keys("lemma", "skeleton", "phonetic")).alias("key")).distinct()
    hit = rows.select("a", "b", "word", F.explode("keys").alias("key")).join(index, ["b", "key"], "left_semi").select("a", "b", "word").distinct()
    return rows.drop("keys").join(hit.withColumn("found", F.lit(True)), ["a", "b", "word"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def match_words(pairs: DataFrame, requests: DataFrame, candidates: DataFrame, names: DataFrame | None = None, lexicon: DataFrame | None = None, language: str | None = None) -> DataFrame:
    """request_id, candidate_id, score: texts cleaned, both coverages and the rate from word_scores(), n-grams of skeletons, anchor, length; names:
    id, name, of which the request's is the hint for the candidate's."""
    clean = lambda x: written(x.select("id", clean_for_match(nfkc(F.col("text"))).alias("text")))
    requests, candidates = clean(requests), clean(candidates)
    left, right = written(word_rows(requests, lexicon, language)), written(word_rows(candidates, lexicon, language))
    ab = written(pairs.select(F.col("request_id").alias("a"), F.col("candidate_id").alias("b")))
    ways = word_scores(ab, left, right).join(word_scores(ab.select(F.col("b").alias("a"), F.col("a").alias("b")), right, left).select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("coverage").alias("back")), ["a", "b"])
    bones = lambda x: x.select("id", F.array_join(F.transform(tokenize(F.col("text")), lambda w: F.when(skeleton(w) != "", skeleton(w)).otherwise("?")), " ").alias("text"))
    sides = ab.select(F.col("a").alias("request_id"), F.col("b").alias("candidate_id"))
    rows = written(measured(sides, requests, candidates).drop("ngram"))
    by_bones = measured(sides, bones(requests), bones(candidates)).select("request_id", "candidate_id", F.coalesce("ngram", F.lit(0.0)).alias("ngram"))
    m = rows.join(_anchors(rows), ["request_id", "candidate_id"]).join(by_bones, ["request_id", "candidate_id"]).join(ways.withColumnsRenamed({"a": "request_id", "b": "candidate_id"}), ["request_id", "candidate_id"])
    hint = F.lit(0.0)
    if names is not None:
        named = sides.join(names.select(F.col("id").alias("request_id"), F.col("name").alias("hint")), "request_id").join(names.select(F.col("id").alias("candidate_id"), "name"), "candidate_id")
        m = m.join(named, ["request_id", "candidate_id"], "left").join(hints(named).withColumnRenamed("score", "by_name"), ["hint", "name"], "left")
        hint = F.coalesce("by_name", F.lit(0.0))
    score = composite(harmonic_mean(F.col("coverage"), F.col("back")), F.col("rate"), F.col("ngram"), F.col("anchor"), hint, F.col("length"))
    return m.select("request_id", "candidate_id", F.round(score, 9).alias("score"))


def whole_match(requests: DataFrame, candidates: DataFrame, names: DataFrame | None = None, lexicon: DataFrame | None = None, language: str | None = None, n: int = 4, least: int = 3, block: int | None = None) -> DataFrame:
    """Of what match_words() gives of whole_pairs(): each request's best two at least, for top_two(). No row is a pair before the result. A text
    without a word once it is cleaned agrees with none."""
    clean = lambda x: x.select("id", "text", clean_for_match(nfkc(F.col("text"))).alias("clean"))
    grid = Grid(clean(requests), clean(candidates), n, least=least, block=block, more=("clean",))
    return best_matches(grid, word_rows(grid.texts.select(F.col("class").alias("id"), F.col("clean").alias("text")), lexicon, language), names)


def top_two(scores: DataFrame) -> DataFrame:
    """The best candidate of each request, and the gap to the second (null without one)."""
    w = W.Window.partitionBy("request_id").orderBy(F.desc("score"), "candidate_id")
    ranked = scores.withColumn("rank", F.row_number().over(w)).withColumn("second", F.lead("score").over(w))
    return ranked.filter("rank = 1").select("request_id", "candidate_id", "score", (F.col("score") - F.col("second")).alias("gap"))


def decide(best: DataFrame, chosen: Column | None = None) -> DataFrame:
    return best.withColumn("decision", decision(F.col("score"), F.round("gap", 9), chosen if chosen is not None else F.lit(False)))


def fuzzy_tokens(pairs: DataFrame, requests: DataFrame, candidates: DataFrame, band: int = 2) -> DataFrame:
    """request_id, candidate_id, token, best: for each distinct word of a request the highest similarity ratio among the
    candidate's words whose length differs by at most `band`. A row is a word of a pair only in the result."""
    words = lambda x: x.select("id", F.explode(F.array_distinct(tokenize(F.lower("text")))).alias("word"))
    ab = pairs.select(F.col("request_id").alias("a"), F.col("candidate_id").alias("b"))
    best = fuzzy_words(ab, words(requests), words(candidates), band)
    return best.select(F.col("a").alias("request_id"), F.col("b").alias("candidate_id"), F.col("word").alias("token"), F.round("best", 6).alias("best"))


def whole_fuzzy(requests: DataFrame, candidates: DataFrame, band: int = 2, n: int = 4, least: int = 3, block: int | None = None) -> DataFrame:
    """What fuzzy_tokens() gives of whole_pairs(). No row is a pair before the result, and no word is one."""
    best = best_words(Grid(requests, candidates, n, least=least, block=block), band)
    return best.select("request_id", "candidate_id", F.col("word").alias("token"), F.round("best", 6).alias("best"))


def hints(pairs: DataFrame) -> DataFrame:
    """pairs: hint, name. The score of each distinct pair by the best part of the longer one."""
    one = pairs.select("hint", "name").distinct()
    return one.select("hint", "name", F.round(hint_score(best_part_ratio(F.col("hint"), F.col("name"))), 6).alias("score"))
