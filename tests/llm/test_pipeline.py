from __future__ import annotations

import math
from collections import Counter

import numpy as np

import corpus_pipeline
from tessitura.llm import classifier, queries, rules
from tessitura.llm.common import hashes_of, mixed

from .helpers import SF, texts
from .test_neardup import brute
from .test_others import brute_kept, split
from .test_tokens import _check_packing


def score(text, w):
    """One text's score, n-gram by n-gram."""
    words = classifier.WORD.findall(text.encode())
    grams = Counter()
    for k, h in enumerate(hashes_of(words)):
        grams[int(h) >> (64 - classifier.BITS)] += 1
        if k:
            two = mixed(hashes_of(words[k - 1 : k]), hashes_of(words[k : k + 1]))
            grams[int(two[0]) >> (64 - classifier.BITS)] += 1
    n = max(1, sum(grams.values()))
    return 1 / (1 + math.exp(-(sum(c * classifier.SCALE / n * float(w[g]) for g, c in grams.items()) + float(w[-1]))))


def passes_rules(text):
    ws = [w.decode() for w in split(text)]
    windows = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    covered = {i + k for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    if len(ws) < 50 or 100 * len(covered) > 50 * len(ws):
        return False
    lines = [x for x in text.split("\n") if x.split()]
    stops = {w for x in rules.STOP_WORDS.values() for w in x.split()}
    got = {
        "mean_word_chars": sum(map(len, ws)) / len(ws), "symbols_per_word": sum(c in rules.SYMBOLS for c in text) / len(ws),
        "stop_word_ratio": sum(w in stops for w in ws) / len(ws), "dup_line_ratio": (len(lines) - len(set(lines))) / len(lines),
    }
    return all((a is None or got[n] >= a) and (b is None or got[n] <= b) for n, a, b in rules.THRESHOLDS)


def test_run_equals_brute_force(spark):
    docs = {d: t for d, t in texts(spark).items() if passes_rules(t or "")}
    w = np.asarray(queries.quality_weights(spark, SF))
    docs = {d: t for d, t in docs.items() if score(t, w) >= 0.7}
    same = brute(list(docs.items()), 5, 80, 100)
    docs = {d: t for d, t in docs.items() if same[d][1] == d}
    kept = brute_kept(docs.items(), 20)
    docs = {d: t if len(kept[d]) == len(split(t)) else b" ".join(kept[d]).decode() for d, t in docs.items()}
    used, least = _check_packing(corpus_pipeline.run(spark, SF).collect(), docs, 2048)
    assert used <= least + 1
    assert 100 < len(docs) < 200


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
