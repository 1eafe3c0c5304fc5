"""document_frequency() against counting one text at a time."""

from __future__ import annotations

from collections import Counter

import pytest

from tessitura.operators import gramcounts
from tessitura.operators import textmatch as M


@pytest.mark.parametrize("size", [1 << 22, 40])
def test_document_frequency_equals_counting(spark, monkeypatch, size):
    """Whatever the buckets and slices; ids may repeat, blanks are those of ASCII, and no run is shuffled as a string."""
    monkeypatch.setattr(gramcounts, "CHARS", size)
    monkeypatch.setattr(gramcounts, "SLICE", size)
    texts = ["a b c d e f", "A B\tC\x0bD\n e  ", "x a b c d e a b c d e", "a b c d e f", "été là b c d", "ÉTÉ Là b C d e", "one two", "", "   ", None, "w " * 90]
    frame = spark.createDataFrame([(k % 3, t) for k, t in enumerate(texts)], "id long, text string")
    for n in (3, 5):
        want = Counter()
        for t in texts:
            w = [x.decode() for x in (t or "").lower().encode().split()]
            want.update({" ".join(w[k : k + n]) for k in range(len(w) - n + 1)})
        for least in (1, 3):
            got = M.document_frequency(frame, n, least)
            assert "hashpartitioning(gram" not in got._jdf.queryExecution().toString()
            assert sorted(map(tuple, got.collect())) == sorted((g, k) for g, k in want.items() if k >= least)


def test_no_runs(spark):
    for rows in ([], [(None,)], [("a b",)]):
        assert M.document_frequency(spark.createDataFrame(rows, "text string"), 5).count() == 0
