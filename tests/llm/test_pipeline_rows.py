"""Null and repeated doc_ids in every stage of the pipeline."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from tessitura.llm.common import written

from .helpers import SF, documents

BAD = "tiny"


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join(rng.choice("the of and to a in is".split()) if k % 3 == 0 else "".join(rng.choices("abcdefghijklmnop", k=6)) for k in range(n))


def rows(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_rules_and_classifier_judge_each_row(spark, monkeypatch):
    good = [(None, prose(1)), (None, prose(2)), (7, prose(3)), (7, prose(3)), (9, prose(4))]
    docs = documents(spark, [*good, (None, BAD), (7, BAD), (None, None), (9, "")])
    assert rows(corpus_pipeline.quality_rules(spark, docs, SF)) == Counter(good)

    # Without weights every text scores 0.5; with only a bias every text passes.
    import numpy as np

    from tessitura.llm import classifier

    w = np.zeros((1 << classifier.BITS) + 1, np.float32)
    for bias, want in ((5, Counter([*good, (None, BAD), (7, BAD), (None, None), (9, "")])), (-5, Counter())):
        w[-1] = bias
        monkeypatch.setattr(corpus_pipeline.queries, "quality_weights", lambda spark, sf, w=w.copy(): w)
        assert rows(corpus_pipeline.quality_classifier(spark, docs, SF)) == want


def test_near_dedup_keeps_one_row_of_each_group(spark):
    docs = documents(spark, [(None, prose(1)), (None, prose(2)), (None, prose(2)), (7, prose(3)), (7, prose(3)), (7, prose(4)), (8, prose(3)), (9, prose(5))])
    got = rows(corpus_pipeline.near_dedup(spark, written(docs), SF))
    assert got == Counter([(None, prose(1)), (None, prose(2)), (7, prose(3)), (7, prose(4)), (9, prose(5))])


def test_substring_dedup_cuts_each_row_by_itself(spark):
    shared = prose(9, 30)
    docs = documents(spark, [(None, prose(1)), (None, f"{prose(2)} {shared}"), (7, prose(3)), (7, f"{shared} {prose(4)}"), (9, f"{prose(5)} {shared}")])
    got = rows(corpus_pipeline.substring_dedup(spark, written(docs), SF))
    assert got == Counter([(None, prose(1)), (None, f"{prose(2)} {shared}"), (7, prose(3)), (7, prose(4)), (9, prose(5))])


def test_packing_takes_every_row(spark):
    docs = documents(spark, [(None, prose(1)), (None, prose(2)), (7, prose(3)), (7, prose(3))])
    assert Counter(r["doc_id"] for r in corpus_pipeline.best_fit_packing(spark, docs, SF).collect()) == Counter([None, None, 7, 7])
