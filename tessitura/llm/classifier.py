"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Training takes at most `max_rows` labelled rows (a documented bound: the smallest by a hash of their id), dealt into
`shards`; each shard trains by itself and the weights are averaged. Scoring is one pass of sparse dot products over whole
texts. Labels are the only other input; lang, source and ids never enter a score.
Defined results: a null or empty text has no n-grams and is scored by the bias alone; repeated labels of one document
count once, the larger value; without any labelled row each score is 0.5; repeated rows give a row each;
an empty table gives no rows; extra columns are not read, but for those in `carry`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashes_of, id_and_text, in_slices, mixed, utf8

#: Runs of letters, of digits and of signs are words of their own here: the signs of junk then meet in one feature.
WORD = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")
BITS = 18
SCALE = 20.0


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the word uni- and bigrams; a value is the share of the row's n-grams times SCALE."""
    words = [WORD.findall(utf8(t)) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    h = hashes_of([w for ws in words for w in ws])
    row = np.repeat(np.arange(len(texts)), sizes)
    inside = row[1:] == row[:-1]
    rows = np.concatenate([row, row[1:][inside]])
    at = (np.concatenate([h, mixed(h[:-1], h[1:])[inside]]) >> np.uint64(64 - BITS)).astype(np.int64)
    count = np.maximum(np.bincount(rows, minlength=len(texts)), 1)
    return rows, at, (SCALE / count)[rows]


def train_shard(texts: list[str], labels: list[int], passes: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> np.ndarray:
    """Weights, the bias last."""
    rows, at, value = features(texts)
    order = np.argsort(rows, kind="stable")
    rows, at, value = rows[order], at[order], value[order]
    cuts = np.searchsorted(rows, np.arange(len(texts) + 1))
    examples = []
    for k, y in enumerate(labels):
        i, back = np.unique(at[cuts[k] : cuts[k + 1]], return_inverse=True)
        x = np.bincount(back, value[cuts[k] : cuts[k + 1]], minlength=len(i))
        examples.append((np.append(i, 1 << BITS), np.append(x, 1.0), float(y)))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(passes):
        for i, x, y in examples:
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[i] = ni + g * g
    return weights(z, n)


def train(docs: DataFrame, labels: DataFrame, usable: Column, max_rows: int = 16384, shards: int = 8) -> np.ndarray | None:
    """Averaged weights, None without labelled rows. usable: which labelled doc_ids may be learnt from. What reaches
    the driver is `shards` vectors of 2^BITS numbers, whatever the input."""
    sample = (
        labels.filter(usable & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    rows = id_and_text(docs).join(F.broadcast(sample), "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(shards)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(order=pdf["doc_id"].map(lambda d: hash((d, 17)))).sort_values(["order", "doc_id", "text"])
        w = train_shard(pdf["text"].tolist(), pdf["quality"].tolist())
        return pd.DataFrame({"n": [len(pdf)], "w": [w.astype(np.float32).tobytes()]})

    parts = rows.groupBy("shard").applyInPandas(fit, "n long, w binary").collect()
    if not parts:
        return None
    total = sum(p["n"] for p in parts)
    return sum(np.frombuffer(p["w"], np.float32) * np.float32(p["n"] / total) for p in parts)


def classify(docs: DataFrame, weights: np.ndarray | None, threshold: float = 0.7, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, predicted for every text, and the columns in `carry`, which go with their rows."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    rows = id_and_text(docs, *([F.struct(F.col("text").isNull().alias("_null"), *(c for c in carry if c != "text")).alias("_carried")] if carry else []))
    more = ["text", "_carried"] if carry else []

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            got = [np.empty(0)]
            for ids, texts in in_slices([batch]):
                if w is None:
                    p = np.full(len(ids), 0.5)
                else:
                    at_row, at, value = features(texts)
                    p = 1 / (1 + np.exp(-np.clip(np.bincount(at_row, w[at] * value, minlength=len(ids)) + w[-1], -35, 35)))
                got.append(p)
            p = np.concatenate(got)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32)), *(batch[c] for c in more)], ["doc_id", "score", "predicted", *more]
            )

    done = rows.mapInArrow(score, ", ".join(["doc_id long, score double, predicted int", *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in more)]))
    back = lambda c: F.when(~F.col("_carried._null"), F.col("text")).alias(c) if c == "text" else F.col(f"_carried.{c}").alias(c)
    return done.select("doc_id", "score", "predicted", *map(back, carry))
