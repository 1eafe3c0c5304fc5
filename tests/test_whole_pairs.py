"""Pairs of groups larger than any bound on document frequency."""

from __future__ import annotations

from itertools import product

from tessitura.operators import textmatch as M


def four_grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)}


def test_whole_pairs_of_large_groups_equal_brute_force(spark):
    copy = "the quick brown fox jumps over the lazy dog at noon"
    texts = {k: copy for k in range(25)} | {100 + k: f"{copy} and word{k} goes on" for k in range(22)}
    texts |= {200: copy.upper(), 201: "only three words", 202: "", 203: "lazy dog at noon and nothing else here at all"}
    df = spark.createDataFrame([*texts.items()], "id long, text string")
    asked = df.filter("id % 5 = 0 or id > 199")
    want = {(a, b): n for a, b in product([r["id"] for r in asked.collect()], texts) if a != b and (n := len(four_grams(texts[a]) & four_grams(texts[b]))) >= 3}
    for block in (1024, 3):
        got = M.whole_pairs(asked, df, block=block).collect()
        assert len(got) == len(want) and {(r["request_id"], r["candidate_id"]): r["shared"] for r in got} == want
    assert not M.candidate_pairs(asked, df).filter("request_id = 0 and candidate_id = 5").count()  # what the bound of 20 leaves out
