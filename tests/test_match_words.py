"""match_words() against its rules, word by word; plans that don't depend on a broadcast threshold."""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessitura.functions import similarity
from tessitura.functions import text as X
from tessitura.operators import textmatch as M
from tessitura.operators import vectors as V

FOLD = str.maketrans(*X.FOLD)
SOUNDS = dict(zip(*X.SOUNDS, strict=True))


def cleaned(text):
    t = unicodedata.normalize("NFKC", text).lower()
    for pattern in (r"\[[^\]]*\]", r"\([^)]{1,30}\)", r"\b\d+\b", r"[^\w'\s]"):
        t = re.sub(pattern, " ", t)
    return t.split()


def letters(word):
    return "".join(c for c in word.lower().translate(FOLD) if c.isalpha())


def skeleton(word):
    return "".join(c for c in letters(word) if c not in X.LATIN_VOWELS + X.CYRILLIC_VOWELS)


def phonetic(word):
    s = letters(word)
    if not re.fullmatch("[a-z]+", s):
        return ""
    return s[0] + re.sub(r"(\d)\1+", r"\1", "".join(SOUNDS.get(c, "") for c in s[1:]))


def word_score(word, others):
    if word in others:
        return 3
    if (skeleton(word) and skeleton(word) in map(skeleton, others)) or (phonetic(word) and phonetic(word) in map(phonetic, others)):
        return 2
    best = max((similarity.ratio(word, o) for o in others if abs(len(o) - len(word)) <= 2), default=0)
    return 2 if best >= 80 else 1 if best >= 60 else 0


def runs(words, n):
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def plain(a, b, pool):
    """Score of request a (words) and candidate b, and the raw anchor of each of the pool."""
    sa, sb = [word_score(w, set(b)) for w in a], [word_score(w, set(a)) for w in b]
    ca, cb = (sum(x >= 2 for x in s) / len(s) for s in (sa, sb))
    ga, gb = (runs([skeleton(w) or "?" for w in ws], 4) for ws in (a, b))
    raw = [sum(1 / sum(g in runs(p, 5) for p in pool) for g in runs(c, 5) & runs(a, 5)) / max(len(runs(c, 5)), 1) for c in pool]
    anchor = raw[pool.index(b)] / max(raw) if max(raw) > 0 else 0
    f1 = 2 * ca * cb / (ca + cb) if ca + cb else 0
    score = 0.55 * f1 + 0.15 * sum(sa) / (3 * len(sa)) + 0.10 * (len(ga & gb) / len(ga | gb) if ga | gb else 0) + 0.20 * anchor - 0.10 * min(1, abs(math.log(len(b) / len(a))))
    return max(0.0, min(1.0, score))


def test_match_words_equals_its_rules(spark):
    rnd = random.Random(8)
    base = [rnd.choice("night lights shining cafe naïve rhythm love lover running ran heart hard 12 don't ﬁre moon (oh) soft-ly".split()) for _ in range(60)]

    def noisy():
        out = []
        for w in base[rnd.randrange(10) : 60 - rnd.randrange(10)]:
            x = rnd.random()
            out.append(w + "s" if x < 0.1 else w[:-1] if x < 0.2 else w.replace("i", "e") if x < 0.3 else rnd.choice(["zebra", "quilt", w]) if x < 0.4 else w)
        return " ".join(out)

    texts = {k: noisy() for k in range(8)}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    pairs = spark.createDataFrame([(a, b) for a in (0, 1, 2) for b in range(8) if a != b], "request_id long, candidate_id long")
    got = {(r["request_id"], r["candidate_id"]): r["score"] for r in M.match_words(pairs, docs, docs).collect()}
    words = {k: cleaned(t) for k, t in texts.items()}
    assert len(got) == 21
    for (a, b), score in got.items():
        pool = [words[k] for k in range(8) if k != a]
        assert math.isclose(score, plain(words[a], words[b], pool), abs_tol=1e-8), (a, b)


def test_a_lexicon_gives_lemmas_and_names_give_hints(spark):
    docs = spark.createDataFrame([(1, "mice ate cheese today again here"), (2, "mouse eats cheese today again here"), (3, "nothing in common with it at all")], "id long, text string")
    lexicon = spark.createDataFrame([("mice", "mouse"), ("ate", "eat"), ("eats", "eat")], "word string, lemma string")
    rows = {(r["id"], r["word"]): r["lemma"] for r in M.word_rows(docs, lexicon).collect()}
    assert rows[1, "mice"] == rows[2, "mouse"] == "mouse" and rows[1, "cheese"] == "cheese"
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "request_id long, candidate_id long")
    score = lambda **k: {r["candidate_id"]: r["score"] for r in M.match_words(pairs, docs, docs, **k).collect()}
    names = spark.createDataFrame([(1, "Cheese Song"), (2, "The Cheese Song"), (3, "Other")], "id long, name string")
    assert score(lexicon=lexicon)[2] > score()[2]
    assert score(names=names)[2] > score()[2]


@pytest.mark.parametrize("most", [1 << 16, 3])
def test_queries_meet_all_rows_by_a_checked_broadcast_or_in_blocks(spark, most):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        corpus = spark.range(500).select(F.col("id").alias("track_id"), F.array(F.cos("id"), F.sin("id")).alias("vector"))
        few = corpus.filter("track_id % 50 = 0").select(F.col("track_id").alias("query_id"), F.col("vector").alias("query"))
        pairs = V.against_all(corpus, few, most=most, block=4)
        assert pairs.select("query_id", "track_id").distinct().count() == pairs.count() == 5000
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan
        near = V.nearest(few, corpus, 3).collect()
        assert len(near) == 30 and all(r["track_id"] == r["query_id"] for r in near if r["rank"] == 1)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
