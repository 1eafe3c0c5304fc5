"""Licence scans against every template at every place; odd texts; hot words; templates of the caller."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tessitura.llm import licences, queries

from .helpers import ODD, SF, documents, texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def plain(text, notices, least=80):
    ws = words(text)
    base, labels, score = {}, set(), 0.0
    for label, phrase in licences.BASE.items():
        p = words(phrase)
        base[label] = [k for k in range(len(ws)) if ws[k : k + len(p)] == p]
    for label, body, phrases in notices:
        t = words(body)
        if not {w for p in phrases for w in words(p)} <= set(ws):
            continue
        for s in range(-len(t), len(ws)):
            n = sum(0 <= s + q < len(ws) and ws[s + q] == w for q, w in enumerate(t))
            sure = all(s + k >= 0 and ws[s + k : s + k + len(p)] == p for p in map(words, phrases) for k in range(len(t)) if t[k : k + len(p)] == p)
            if sure and 100 * n >= least * len(t):
                labels.add(label)
                score = max(score, n / len(t))
    own, places = sorted(x for x in base if base[x]), sorted(p for x in base.values() for p in x)
    if places:
        score = 1.0
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(own), ",".join(sorted({*own, *labels})), score


def check(rows, given, notices):
    got = sorted((tuple(r) for r in rows), key=repr)
    assert got == sorted(((d, *plain(t, notices)) for d, t in given), key=repr)
    return got


def test_query_equals_every_template_at_every_place(spark):
    got = check(queries.op13_license_scans(spark, SF).collect(), texts(spark).items(), licences.NOTICES)
    assert {x for r in got for x in r[6].split(",")} & {"mit", "apache-2.0", "gpl-3.0", "cc-by-nc-4.0"}


def test_whole_notices_changed_ones_and_odd_texts(spark):
    rnd = random.Random(1)
    rows = list(ODD)
    for k, (_, body, _) in enumerate(licences.NOTICES):
        ws = body.split()
        changed = [*ws[:4], "(c)", *ws[4:]]
        dropped = list(ws)
        dropped[rnd.randrange(len(ws))] = "other"
        rows += [(100 + k, "/* " + body.upper() + " */"), (200 + k, " \n# ".join(changed)), (300 + k, "é".join([" a ", *body.split(), " b"])), (400 + k, " ".join(dropped)), (500 + k, " ".join(ws[1:])), (600 + k, body + ".\n" + body)]
    rows += [(None, "All rights reserved"), (7, "CC-BY cc by; ccé by"), (7, "CC-BY cc by; ccé by"), (8, "all rights all rights reserved " * 30)]
    docs = documents(spark, rows).withColumns({c: F.lit("x") for c in ("word", "n", "words", "labels", "score", "base")})
    got = check(licences.scan(docs).collect(), rows, licences.NOTICES)
    assert all(r[6] for r in got if 100 <= (r[0] or 0) < 200)
    assert licences.scan(documents(spark, [])).count() == 0


def test_own_templates_and_hot_words(spark):
    """The rarest word differs from corpus to corpus; results don't."""
    own = [("x", "the the the rare the the", ("the rare the",)), ("y", "the the the the", ("the the",)), ("z", "rare the common the rare", ("rare the", "the rare"))]
    templates = licences.TEMPLATES[:3] + [licences.template(*t) for t in own]
    rnd = random.Random(2)
    rows = [(k, " ".join(rnd.choice(["the", "the", "the", "rare", "common"]) for _ in range(rnd.randrange(40)))) for k in range(80)]
    check(licences.scan(documents(spark, rows), templates).collect(), rows, own)
    check(licences.scan(documents(spark, [(1, "the rare"), *rows[:5]]), templates, 80).collect(), [(1, "the rare"), *rows[:5]], own)


def test_a_phrase_that_is_not_in_its_template_is_an_error():
    with pytest.raises(ValueError, match="isn't in the template"):
        licences.template("x", "some words", ("other words",))
