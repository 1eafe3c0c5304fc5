from __future__ import annotations

import functools
import random
import re
import unicodedata

from pyspark.sql import functions as F

from tessitura.functions import similarity as S
from tessitura.operators import textmatch


def plain_common(a, b):
    @functools.cache
    def go(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + go(i + 1, j + 1) if a[i] == b[j] else max(go(i + 1, j), go(i, j + 1))

    return go(0, 0)


def test_common_length_and_ratios():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choices("abcé", k=rnd.randrange(12))) for _ in range(2))
        assert S.common_length(a, b) == plain_common(a, b)
    assert S.ratio("", "") == 100 and S.ratio("a", "") == 0 and S.ratio("abcd", "abed") == 75
    assert S.partial_ratio("ABBA", "the abba band") == 100 and S.partial_ratio("", "x") == 0


def test_fuzzy_tokens_equal_brute_force(spark):
    texts = {1: "hello wurld again", 2: "hallo world against the wind", 3: "zzz"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "request_id long, candidate_id long")
    got = {(r["request_id"], r["candidate_id"], r["token"]): r["best"] for r in textmatch.fuzzy_tokens(pairs, df, df).collect()}
    want = {}
    for a, b in ((1, 2), (2, 1), (1, 3)):
        for t in set(texts[a].split()):
            near = [S.ratio(t, o) for o in texts[b].split() if abs(len(o) - len(t)) <= 2]
            if near:
                want[a, b, t] = round(max(near), 6)
    assert got == want


def test_hint_score(spark):
    rows = spark.createDataFrame([("ABBA", "the abba band"), ("abc", "xyz"), (None, "a")], "hint string, name string")
    got = {r["hint"]: r["score"] for r in textmatch.hints(rows).collect()}
    assert got["ABBA"] == 1.0 and got["abc"] == 0.0
    assert rows.select(S.similarity_ratio(F.col("hint"), F.col("name")).alias("x")).filter("x is null").count() == 1


def test_texts_that_composition_leaves_alone_stay_in_spark(spark):
    """Every letter of UNCHANGED by itself and behind others; texts with any other letter are composed."""
    inside = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000 and re.match(f"[{S.UNCHANGED}]", chr(k))]
    assert len(inside) > 30000
    assert all(unicodedata.normalize("NFKC", a + x) == a + x and not unicodedata.combining(x) for x in inside for a in ("", "a", "か", "가"))
    texts = [None, "", "plain", "été “да” — 漢字", "été", "ﬁn … ½", "각", "が", "a b", "𝔸", "y" * 5000 + "²"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = frame.select("id", S.nfkc(F.col("text")).alias("text"), F.col("text").rlike(f"[^{S.UNCHANGED}]").alias("sent")).collect()
    assert {r["id"]: r["text"] for r in got} == {k: t and unicodedata.normalize("NFKC", t) for k, t in enumerate(texts)}
    assert [r["sent"] for r in sorted(got)] == [None, False, False, False] + [True] * 7
