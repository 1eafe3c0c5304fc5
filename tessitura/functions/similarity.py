"""String similarity as Arrow-batched functions. Apply them to distinct pairs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one integer's bits for all places of a."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | (1 << k)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * 2 * common subsequence / total length; two empty strings are equal."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a stretch of its length of the longer one, whatever their case."""
    a, b = sorted((a.casefold(), b.casefold()), key=len)
    return max((ratio(a, b[k : k + len(a)]) for k in range(len(b) - len(a) + 1)), default=0.0) if a else 0.0


def _over(f):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def similarity_ratio(a: Column, b: Column) -> Column:
    return _over(ratio)(a, b)


def best_part_ratio(a: Column, b: Column) -> Column:
    return _over(partial_ratio)(a, b)


def hint_score(best: Column) -> Column:
    """best: 0 to 100. Below 65: 0, then linear up to 1."""
    r = best / 100
    return F.when(r < 0.65, 0.0).otherwise((r - 0.65) / 0.35)


#: Letters and signs that the composition leaves as they are, where no mark follows.
UNCHANGED = r"\x00-\x7F\u00A1-\u00A7\u00AB-\u00AE\u00BB\u00BF-\u0131\u0134-\u013E\u0141-\u0148\u0400-\u0482\u2012-\u2016\u2018-\u201F\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF\uAC00-\uD7A3"


def nfkc(text: Column) -> Column:
    """Unicode's compatibility composition, for which Spark has no function. Only texts that it may change go to Python, where a batch is
    held as strings."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    # Letters of ASCII first: other ranges are asked of few.
    some = (F.octet_length(text) != F.length(text)) & text.rlike(rf"[[^\x00-\x7F]&&[^{UNCHANGED}]]")
    return F.coalesce(run(F.when(some, text)), text)
