"""How many texts hold each run of n words, counted by the runs' hashes: strings are made only of runs that are asked for.

A task hashes its texts' runs and deals them into buckets, packed by text; a bucket counts its hashes and names a text and a place for each. Hashes
have 96 bits: among 2^31 different runs two share one with a chance of 1 in 10^10.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..sources.shared import written
from .paircells import Lists

#: Characters of texts for a bucket, and bytes that a task hashes at a time.
CHARS, SLICE = 1 << 23, 1 << 22
#: Keys of the words' two hashes, and an odd factor.
KEYS, FACTOR = ("tessitura.runs.1", "tessitura.runs.2"), np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * FACTOR
    return h ^ (h >> np.uint64(32))


def _lists(ends: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, kind))


def _packed(rows: np.ndarray, texts: list[bytes], n: int, buckets: int) -> pa.RecordBatch | None:
    """bucket, and of its runs: rows and how many of each, places, both hashes; a run of a text once."""
    cut = [t.split() for t in texts]  # as \\s does: blanks of ASCII
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    many = np.maximum(sizes - n + 1, 0)
    if not many.sum():
        return None
    flat = np.empty(int(sizes.sum()), dtype=object)
    flat[:] = list(chain.from_iterable(cut))
    codes, words = pd.factorize(flat)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    place, hashes = at + np.repeat(np.cumsum(sizes) - sizes, many), []
    for key in KEYS:  # of all runs, also those across two texts
        of = pd.util.hash_array(words, hash_key=key, categorize=False)[codes]
        h = np.zeros(len(of) - n + 1, np.uint64)
        for j in range(n):
            h = _mixed(h ^ of[j : j + len(h)])
        hashes.append(_mixed(h)[place])
    (h, g), doc = hashes, np.repeat(np.arange(len(cut)), many)
    order = np.argsort(h, kind="stable")
    h, g, doc, at = h[order], g[order], doc[order], at[order]
    once = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (g[1:] != g[:-1]))
    h, g, doc, at = h[once], g[once], doc[once], at[once]
    bucket = (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    group = bucket * len(cut) + doc
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    own, ends = np.unique(bucket, return_index=True)
    ends = np.append(ends, len(bucket))  # buckets rise with h: the second order keeps them where they are
    runs = np.searchsorted(first, ends)
    return pa.RecordBatch.from_arrays(
        [pa.array(own), _lists(runs, rows[doc[order][first]], pa.int64()), _lists(runs, np.diff(np.append(first, len(order))), pa.int32()), _lists(ends, at[order], pa.int32()),
         _lists(ends, h[order].view(np.int64), pa.int64()), _lists(ends, (g[order] >> np.uint64(32)).astype(np.uint32).view(np.int32), pa.int32())],
        ["bucket", "rows", "sizes", "at", "h", "g"],
    )


def document_frequency(texts: DataFrame, n: int, least: int = 1) -> DataFrame:
    """texts: text, a row each. gram (n words in lower case, joined by a space), df: how many texts hold it, `least` at least."""
    rows = written(texts.filter("text IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), F.lower("text").alias("text")))
    buckets = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // CHARS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, text = batch["row"].to_numpy(), batch["text"].cast(pa.binary())
            ends, low = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while low < len(row):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE, "right")))
                out = _packed(row[low:high], text.slice(low, high - low).to_pylist(), n, buckets)
                if out is not None:
                    yield out
                low = high

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        row = np.repeat(Lists(table["rows"]).values.to_numpy(), Lists(table["sizes"]).values.to_numpy())
        at, h, g = (Lists(table[c]).values.to_numpy() for c in ("at", "h", "g"))
        order = np.lexsort((g, h))
        h, g = h[order], g[order]
        first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
        df = np.diff(np.append(first, len(h)))
        one, df = order[first[df >= least]], df[df >= least]
        by_row = np.argsort(row[one], kind="stable")
        one, df = one[by_row], df[by_row]
        begins = np.flatnonzero(np.diff(row[one], prepend=-1))
        ends = np.append(begins, len(one))
        yield pa.RecordBatch.from_arrays([pa.array(row[one][begins]), _lists(ends, at[one], pa.int32()), _lists(ends, df, pa.int64())], ["row", "at", "df"])

    packed = rows.mapInArrow(pack, "bucket long, rows array<bigint>, sizes array<int>, at array<int>, h array<bigint>, g array<int>")
    # As many tasks as buckets: without a number AQE would put several buckets of small bytes into one.
    counted = packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(count, "row long, at array<int>, df array<bigint>")
    found = counted.groupBy("row").agg(F.flatten(F.collect_list(F.arrays_zip("at", "df"))).alias("found"))
    # One array, exploded as a row: inside the lambda the text would be cut anew for each run.
    cut = rows.join(found, "row").select("found", F.explode(F.array(tokenize(F.col("text")))).alias("w"))
    grams = F.transform("found", lambda x: F.struct(F.array_join(F.slice("w", x["at"] + 1, n), " ").alias("gram"), x["df"].alias("df")))
    return cut.select(F.inline(grams))
