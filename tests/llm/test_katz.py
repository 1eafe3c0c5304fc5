from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessitura.llm import katz, queries

from .helpers import ODD, SF, documents, texts


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


class Plain:
    """The model as the formulas have it, over dictionaries."""

    def __init__(self, train):
        self.c1, self.c2 = Counter(), defaultdict(Counter)
        for ws in train:
            for h, w in zip(["<s>", *ws], [*ws, "</s>"], strict=True):
                self.c1[w] += 1
                self.c2[h][w] += 1
        self.n = sum(self.c1.values())
        of = lambda cs: [sum(c == r for c in cs) for r in range(1, 7)]
        self.d1 = katz.discounts(of(self.c1.values()))
        self.d2 = katz.discounts(of([c for x in self.c2.values() for c in x.values()]))
        left = sum((1 - self.d(c, self.d1)) * c for c in self.c1.values()) / self.n if self.n else 1
        self.scale, self.unk = (1, left) if left > 0 else (self.n / (self.n + 1), 1 / (self.n + 1))

    @staticmethod
    def d(c, d):
        return d[c - 1] if c <= 5 else 1

    def p1(self, w):
        if not self.n:
            return 1
        c = self.c1.get(w, 0)
        return self.scale * self.d(c, self.d1) * c / self.n if c else self.unk

    def p(self, h, w):
        seen = self.c2.get(h)
        if not seen:
            return self.p1(w)
        total = sum(seen.values())
        left = sum((1 - self.d(c, self.d2)) * c for c in seen.values())
        whole = total if left > 0 else total + 1
        left = left if left > 0 else 1
        if w in seen:
            return self.d(seen[w], self.d2) * seen[w] / whole
        return left / whole / (1 - sum(map(self.p1, seen))) * self.p1(w)

    def score(self, ws):
        return sum(math.log10(self.p(h, w)) for h, w in zip(["<s>", *ws], [*ws, "</s>"], strict=True))

    def base(self, ws):
        return sum(math.log10((self.c1.get(w, 0) + 1) / (self.n + len(self.c1) + 1)) for w in [*ws, "</s>"])


def held(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2


def check(rows, want):
    model = Plain([words(t) for d, t in want if not held(d)])
    by = defaultdict(list)
    for d, t in want:
        by[d].append(t)
    assert len(rows) == len(want)
    for r in rows:
        assert any(
            (r["n_tokens"], r["n_known"], r["held_out"]) == (len(ws) + 1, sum(w in model.c1 for w in [*ws, "</s>"]), held(r["doc_id"]))
            and math.isclose(r["base_score"], model.base(ws), rel_tol=1e-9, abs_tol=1e-9)
            and math.isclose(r["score"], model.score(ws), rel_tol=1e-9, abs_tol=1e-9)
            for ws in map(words, by[r["doc_id"]])
        ), (r, model.score(words(by[r["doc_id"]][0])))
    return model


def test_query_equals_the_formulas(spark):
    rows = queries.op1_katz_backoff(spark, SF).collect()
    model = check(rows, list(texts(spark).items()))
    assert {r["train_tokens"] for r in rows} == {model.n}
    everything = [*model.c1, "never seen"]
    for h in ["<s>", *random.Random(1).sample([x for x in model.c1 if x != "</s>"], 20)]:
        assert math.isclose(sum(model.p(h, w) for w in everything), 1, rel_tol=1e-9)


@pytest.mark.parametrize("limit", [1, 200, 1 << 20])
def test_odd_texts_and_small_blocks(spark, limit):
    rnd = random.Random(limit)
    rows = [x for x in ODD if len(x[1] or "") < 30_000] + [(20 + k, " ".join(rnd.choice("a b c d e f g h".split()) for _ in range(rnd.randrange(40)))) for k in range(40)] + [(20, "x y"), (20, "x y"), (None, "a b")]
    docs = documents(spark, rows).withColumn("block", F.lit(1)).withColumn("payload", F.lit("x"))
    scores, model = katz.fit_and_score(docs, held, limit)
    plain = check(scores.collect(), rows)
    stored = {r["id"]: r for r in model.word_table().collect()}
    assert len(stored) == len(plain.c1) + 1  # the start
    assert sum(r["count"] for r in stored.values()) == plain.n + model.scalars.texts
    assert sum(r["count"] for r in model.bigram_table().collect()) == plain.n


@pytest.mark.parametrize(("per_bucket", "hot"), [(10, 3), (50, 20), (1 << 20, 1)])
def test_spread_histories_and_many_buckets(spark, per_bucket, hot):
    """Histories spread over buckets by their followers give the same probabilities; stored weights make each history add up to 1."""
    rnd = random.Random(per_bucket)
    rows = [(k, " ".join(rnd.choice("the the the a b c d e f g h i j k l m n o p".split()) for _ in range(rnd.randrange(30)))) for k in range(60)]
    scores, model = katz.fit_and_score(documents(spark, rows), held, 300, per_bucket, hot)
    plain = check(scores.collect(), rows)
    words = {r["id"]: r for r in model.word_table().collect()}
    seen = defaultdict(dict)
    for r in model.bigram_table().collect():
        seen[r["history"]][r["word"]] = r["count"]
    s = model.scalars
    own = {i: float(s.word([r["count"]])[0]) for i, r in words.items() if r["hash"] != int(katz.START.astype("int64"))}
    assert math.isclose(sum(own.values()) + (s.unseen if sum(own.values()) < 1 - 1e-12 else 0), 1, rel_tol=1e-9)
    for h, followers in seen.items():
        told = sum(katz.discounted(katz.np.array([c]), s.d2)[0] / words[h]["count"] for c in followers.values())
        rest = sum(p for w, p in own.items() if w not in followers) + s.unseen
        assert math.isclose(told + words[h]["alpha"] * rest, 1, rel_tol=1e-6)
    assert len(seen) == len(plain.c2)


def test_a_stored_model_scores_other_documents(spark):
    rows = [(k, f"some words {k % 3} and more words") for k in range(40)]
    with katz.blocks_of(documents(spark, rows), lambda d: False) as blocks:
        path = katz.fit(blocks).path
    other = [(100, "some words 1 and unheard words"), (101, None), (102, "some more")]
    with katz.blocks_of(documents(spark, other), lambda d: True) as blocks:
        got = {r["doc_id"]: r["score"] for r in katz.score(blocks, katz.load(spark, path)).collect()}
    plain = Plain([words(t) for _, t in rows])
    assert all(math.isclose(got[d], plain.score(words(t)), rel_tol=1e-9) for d, t in other)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("llm_blocks")]


def test_no_training_texts_and_no_texts(spark):
    only = [(d, "a b") for d in range(200) if held(d)]
    check(katz.fit_and_score(documents(spark, only), held)[0].collect(), only)
    assert katz.fit_and_score(documents(spark, []), held)[0].count() == 0


def test_frequent_only_counts_still_leave_something(spark):
    rows = [(d, "a a a a b b b b") for d in range(40)]
    check(katz.fit_and_score(documents(spark, [*rows, (1000, "b zzz a")]), held)[0].collect(), [*rows, (1000, "b zzz a")])
