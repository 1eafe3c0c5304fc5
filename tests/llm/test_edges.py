"""Hash, training and stage results against plain versions; nulls, empty tables, repeated rows and clashing names."""

from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessitura.llm import classifier, media, neardup, rules

from .helpers import SF, documents

CLASHING = ("print", "bands", "sig", "id", "label", "key", "row", "_words", "_carried", "n_words", "kept", "score", "predicted", "media", "hash", "n_bytes", "piece", "_group", "carried", "low", "high", "ranges")


def clash(docs):
    return docs.withColumns({c: F.lit("x") for c in CLASHING})


def plain_hash(image, low=8, side=32):
    """Area means by overlaps, the transform by its definition, bits against the median without the first value."""
    h, w = len(image), len(image[0])
    share = lambda k, n, i: max(0.0, min(i + 1, (k + 1) * n / side) - max(i, k * n / side))
    small = [[sum(share(y, h, i) * share(x, w, j) * image[i][j] for i in range(h) for j in range(w)) * side * side / (h * w) for x in range(side)] for y in range(side)]
    cos = lambda u, x: math.cos(math.pi * u * (2 * x + 1) / (2 * side))
    freq = [round(sum(small[y][x] * cos(u, y) * cos(v, x) for y in range(side) for x in range(side)), 6) + 0.0 for u in range(low) for v in range(low)]
    middle = statistics.median(freq[1:])
    bits = "".join("1" if f > middle else "0" for f in freq)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))


@pytest.mark.parametrize("shape", [(1, 40), (3, 33), (32, 32), (45, 37)])
def test_cosine_hash_equals_its_definition(shape):
    image = np.random.default_rng(shape[0]).integers(0, 256, shape, dtype=np.uint8)
    assert media.cosine_hash(image) == plain_hash(image.tolist())


def test_media_of_nulls_and_clashing_columns(spark):
    rows = [(None, "a"), (1, None), (1, ""), (1, "a")]
    got = media.media_features(media.store_texts(clash(documents(spark, rows)))).collect()
    assert len(got) == 4
    assert len({r["payload_sha256"] for r in got}) == 2  # equal texts, equal values
    assert media.media_features(media.store_texts(documents(spark, []))).count() == 0


def plain_ftrl(texts, labels, passes=3, alpha=0.5, beta=1.0, l1=1e-3, l2=1e-3):
    """Per coordinate, over dictionaries."""
    z, n, bias = {}, {}, 1 << classifier.BITS

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(passes):
        for text, y in zip(texts, labels, strict=True):
            x = {bias: 1.0}
            for _, i, v in zip(*(a.tolist() for a in classifier.features([text])), strict=True):
                x[i] = x.get(i, 0.0) + v
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i, v in x.items():
                g = (p - y) * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_training_equals_the_update_rule():
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("good fine text word spam !!! 12 xx".split()) for _ in range(rnd.randrange(0, 25))) for _ in range(40)]
    labels = [rnd.randrange(2) for _ in texts]
    got, want = classifier.train_shard(texts, labels), plain_ftrl(texts, labels)
    assert {i for i, w in want.items() if w} == set(np.flatnonzero(got).tolist())
    assert all(math.isclose(got[i], w, rel_tol=1e-9, abs_tol=1e-12) for i, w in want.items())


def test_labels_that_are_null_contradict_or_belong_to_nothing(spark):
    docs = documents(spark, [(k, "clean words here" if k % 2 else "$$ ## 99") for k in range(30)] + [(None, "x")])
    told = [(k, k % 2) for k in range(20)]
    labels = lambda more: spark.createDataFrame(told + more, "doc_id long, quality int")
    plain = classifier.train(docs, labels([]), F.lit(True))
    # Of contradicting labels the larger counts; a null label, a null id and an unknown id count for nothing.
    odd = classifier.train(clash(docs), labels([(1, 0), (2, None), (None, 1), (999, 1)]), F.lit(True))
    assert np.array_equal(plain, odd)
    scores = {r["doc_id"]: r["score"] for r in classifier.classify(clash(docs), plain).collect()}
    assert min(scores[k] for k in range(1, 30, 2)) > max(scores[k] for k in range(0, 30, 2))
    assert classifier.classify(documents(spark, []), plain).count() == 0
    assert classifier.train(docs, labels([]), F.lit(False)) is None
    assert classifier.train(documents(spark, []), labels([]), F.lit(True)) is None


def test_near_dedup_and_rules_with_clashing_columns_and_without_rows(spark):
    text = " ".join(f"w{k}" for k in range(80))
    docs = documents(spark, [(1, text), (2, text), (3, "other"), (4, None), (None, text)])
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(clash(docs)).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (None, None, True)}
    assert neardup.near_duplicates(documents(spark, [])).count() == 0
    measured = rules.quality_rules(clash(docs)).select("doc_id", "n_words", "base_failed").collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["base_failed"]) for r in measured) == [(0, 80, False), (1, 80, False), (2, 80, False), (3, 1, True), (4, 0, True)]
    assert rules.quality_rules(documents(spark, [])).count() == 0


def test_estimates_of_rows_equal_those_of_columns(spark):
    rnd = np.random.default_rng(3)
    sig = rnd.integers(-(1 << 62), 1 << 62, (6, 4))
    sig[1] = sig[0]
    sig[2, :2] = sig[0, :2]
    rows = spark.createDataFrame([(k, sig[0].tolist(), s.tolist()) for k, s in enumerate(sig)], "k int, a array<long>, b array<long>")
    want = {r["k"]: r["e"] for r in rows.select("k", neardup.estimate(F.col("a"), F.col("b"), 4, 4).alias("e")).collect()}
    got = neardup.estimated(sig[0].view(np.uint64), sig.view(np.uint64), 4)
    assert all(math.isclose(got[k], e, abs_tol=1e-12) for k, e in want.items())
    assert got[0] == got[1] == 1


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_a_stage_takes_nulls_repeats_empty_tables_and_clashing_names(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    last = name == corpus_pipeline.STAGES[-1][0]
    words = "the quick and the lazy of a to in is it be as with for on that this by are".split()
    rnd = random.Random(1)
    text = lambda: " ".join(rnd.choice(words) + str(rnd.randrange(900)) if k % 2 else rnd.choice(words) for k in range(120))
    own = [text() for _ in range(4)]
    rows = [(1, own[0]), (2, own[1]), (2, own[1]), (2, own[2]), (None, own[3]), (None, own[3]), (None, None), (7, ""), (8, None)]
    docs = documents(spark, rows).withColumn("lang", F.when(F.col("doc_id") > 1, F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    out = stage(spark, clash(docs), SF)
    got = out.collect()
    if last:
        assert len(got) == len(rows)
    else:
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {(r["doc_id"], r["text"]) for r in got} <= {*rows, *((d, t or "") for d, t in rows)}
    kept = {(r["doc_id"], r["text"]) for r in got} if not last else set()
    if name == "near_dedup":
        assert sum(t == own[1] for _, t in kept) == sum(t == own[3] for _, t in kept) == 1 and len([r for r in got if r["text"] in own]) == 4
    if name == "substring_dedup":
        assert len(got) == len(rows) and all((d, t) in kept for d, t in rows if t)
    assert stage(spark, documents(spark, []), SF).count() == 0
