"""Spelling variants against brute force: edits by their definition, chains, ties, odd texts, any dictionary."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessitura.llm import queries, spellings

from .helpers import ODD, SF, documents, texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            n[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain(n):
    words = sorted(n)
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and one_edit(v, w)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in words}


def got(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_query_equals_brute_force(spark):
    n = plain_counts(texts(spark).items())
    assert got(queries.op12_spelling_variants(spark, SF)) == plain(n)


@pytest.mark.parametrize(("frequent", "bound", "most"), [(0, 1 << 16, 3), (3, 1 << 16, 4), (64, 20, 3), (1, 1 << 16, 2)])
def test_any_dictionary_finds_every_near_word(spark, frequent, bound, most):
    """Few letters: many equal grams in a word, and hot ones that most words hold."""
    rnd = random.Random(frequent)
    n = {"".join(rnd.choice("aab\xe9") for _ in range(rnd.randrange(5, 9))): rnd.randrange(3, 40) for _ in range(400)}
    n |= {"abcde" + x: 5 for x in ("", "f", "fg", "g", "gf")} | {"aaaaa": 100, "aaaaaa": 50, "aaaaaaa": 25, "aaaaaaaa": 12, "÷×÷×÷": 3, "÷×÷×÷÷": 6}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    pairs = spellings.near_pairs(words, most=most, frequent=frequent, bound=bound)
    assert pairs.count() == pairs.select(F.least("a", "b"), F.greatest("a", "b")).distinct().count()
    assert got(spellings.grouped(words, pairs)) == plain(n)


def test_affected_grams_hold_for_every_edit():
    rnd = random.Random(5)
    for _ in range(300):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randrange(5, 12)))
        inner = {g: 9 for g in ("ab", "ba", "^a", "c$", "aba", "bab", "cc") if rnd.random() < 0.7}
        i, c = rnd.randrange(len(word)), rnd.choice("abc")
        other = rnd.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :]])
        own = spellings.decompose(f"^{word}$", inner, 2, 4)
        names = lambda w: Counter(f"^{w}$"[p : p + q] for p, q, _ in spellings.decompose(f"^{w}$", inner, 2, 4))
        assert (names(word) - names(other)).total() <= spellings.affected(own, len(word) + 2)


def test_odd_texts_repeats_nulls_and_clashing_columns(spark):
    rows = [*ODD, (20, "Stra\xdfe Strasse stra\xdfe STRASSE strasse strasse stra\xdfe İstanbul Äpfel Äpfel Äpfel äpfel"), (None, "hello hello hello hallo"), (21, "hallo hallo hellos hellos hellos"), (21, "hallo hallo hellos hellos hellos")]
    docs = documents(spark, rows).withColumns({c: F.lit("x") for c in ("word", "n", "form", "root", "key", "more", "part", "parts")})
    n = plain_counts(rows)
    assert n and got(spellings.spelling_variants(docs)) == plain(n)
    assert spellings.spelling_variants(documents(spark, [])).count() == 0


def test_a_long_chain_ends_at_its_last_form(spark):
    n = {"abcde" + "x" * k: 3 << (12 - k) for k in range(12)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert got(spellings.grouped(words, spellings.near_pairs(words))) == plain(n)
    assert {r["root"] for r in spellings.grouped(words, spellings.near_pairs(words)).collect()} == {"abcde"}


def test_counts_do_not_depend_on_how_much_a_task_holds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = ({(r["word"], r["n"]) for r in spellings.word_counts(docs, held=h).collect()} for h in (10, 10**6))
    assert a == b
