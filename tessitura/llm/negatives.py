"""Hard-negative mining by a BOND vertical scan.

Rows of the vector table lie in blocks that store one array for each dimension, whole numbers, with its least and greatest
value. An anchor reads a block's dimensions in descending magnitude of its own components and adds their products up; what the
dimensions not yet read can add at least and at most follows from their extremes, so that each row has a lower and an
upper bound. Between reads the bitmap of candidates shrinks: first to rows that may be among the best of the anchor's own label,
then, with these positives known, to rows of other labels that may be among the best of some positive's score window. Rows that
are left when all dimensions are read have exact scores.

Anchors meet all rows, a stated query set, in a grid of bounded groups: each group holds about `rows` rows and `anchors`
anchors whatever the number of labels or equal vectors, and a group hands on no more than the best few rows of each anchor. No vectors reach the driver.
Scores are inner products of floor(scale * x), as whole numbers; higher ones come first, ties by smaller id (a null one last).
Defined results: rows with a null label, a null vector or a null or non-finite component take no part; a null id can't
be an anchor; vectors of different lengths are compared as if the shorter one went on with zeros; components beyond 2^22
after scaling count as 2^22; repeated rows are rows of their own, also as anchors; an anchor without positives, and a positive without
negatives, give no rows; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import packed, unpacked, written

#: A block as stored: rows, ids, 1 for a null id, labels, then the dimensions one after the other and their extremes.
BLOCK = (np.int64, np.int64, np.uint8, np.int64, np.int32, np.int32, np.int32)
STORED = "block long, n long, payload binary, anchors array<struct<row:int,id:bigint,label:bigint,vector:binary>>"
#: Greatest magnitude of a component as a whole number: scores of 2^12 dimensions, times a percentage, fit in 64 bits.
MOST = 1 << 22
#: How many dimensions are read between two looks at the bounds.
STEP = 4


def usable(vectors: DataFrame, id: Column, label: Column, vector: Column) -> DataFrame:
    """id, label, vector of the rows that take part."""
    rows = vectors.select(id.cast("long").alias("id"), label.cast("long").alias("label"), vector.cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & sound)


def blocks_of(rows: DataFrame, every: int, scale: int, size: int) -> DataFrame:
    """STORED: blocks of at most `size` rows, and among them the anchors, whose id `every` divides."""

    def block(number: int, part: pa.RecordBatch) -> pa.RecordBatch:
        n = part.num_rows
        vectors = part.column("vector")
        lengths = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        table = np.zeros((n, int(lengths.max(initial=0))), np.int32)
        table[np.arange(table.shape[1]) < lengths[:, None]] = np.clip(flat, -MOST, MOST)
        null = part.column("id").is_null().to_numpy(zero_copy_only=False)
        ids = part.column("id").fill_null(0).to_numpy(zero_copy_only=False)
        labels = part.column("label").to_numpy(zero_copy_only=False)
        low, high = (f(axis=0, initial=v).astype(np.int32) if table.size else np.zeros(0, np.int32) for f, v in ((table.min, MOST), (table.max, -MOST)))
        payload = packed(np.array([n], np.int64), ids, null.astype(np.uint8), labels, table.T.ravel(), low, high)
        own = [{"row": k, "id": int(ids[k]), "label": int(labels[k]), "vector": table[k].tobytes()} for k in np.flatnonzero(~null & (ids % every == 0)).tolist()]
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([n]), pa.array([payload], pa.binary()), pa.array([own], anchor)], ["block", "n", "payload", "anchors"])

    anchor = pa.list_(pa.struct([("row", pa.int32()), ("id", pa.int64()), ("label", pa.int64()), ("vector", pa.binary())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, size - n))
                at, n = at + held[-1].num_rows, n + held[-1].num_rows
                if n == size:
                    yield block(number, pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    number, held, n = number + 1, [], 0
        if n:
            yield block(number, pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return rows.mapInArrow(cut, STORED)


class Block:
    def __init__(self, number: int, payload: bytes):
        n, self.ids, self.null, self.labels, values, self.low, self.high = unpacked(payload, *BLOCK)
        self.number, self.n = number, int(n[0])
        self.dims = values.reshape(-1, self.n)

    def first(self, at: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """Places in `at` of the k that come first."""
        return np.lexsort((self.ids[at], self.null[at], -score))[:k]


def vertical_scan(q: np.ndarray, x: Block, bitmap: np.ndarray, may_count: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the bitmap that the bounds leave, and their exact scores. may_count: lower and upper bounds of the candidates
    to a bitmap of those that still matter."""
    q = q[: len(x.dims)].astype(np.int64)
    order = np.argsort(-np.abs(q), kind="stable")
    order = order[: np.count_nonzero(q)]
    w = q[order]
    a, b = w * x.low[order], w * x.high[order]
    rest = lambda v: np.append(np.cumsum(v[::-1])[::-1], 0)
    least, most = rest(np.minimum(a, b)), rest(np.maximum(a, b))
    # Sums of 32 bits are enough where even the largest products together are.
    kind = np.int32 if int(np.maximum(np.abs(a), np.abs(b)).sum()) < 1 << 31 else np.int64
    at = np.flatnonzero(bitmap)
    whole = 2 * len(at) >= x.n  # whole arrays are read until half of the candidates are gone
    total, product = np.zeros(x.n if whole else len(at), kind), np.empty(x.n, kind)
    for k, dim in enumerate(order.tolist()):
        values = x.dims[dim] if whole else x.dims[dim][at]
        total += np.multiply(values, kind(w[k]), out=product[: len(values)], dtype=kind)
        if (k + 1) % STEP and k + 1 < len(order):
            continue
        now = (total[at] if whole else total).astype(np.int64)
        keep = may_count(now + least[k + 1], now + most[k + 1])
        if not keep.all():
            at, now = at[keep], now[keep]
            if not len(at):
                break
            if not whole:
                total = total[keep]
            elif 2 * len(at) < x.n:
                whole, total = False, total[at]
    return at, (total[at] if whole else total).astype(np.int64)


def best_of_label(q: np.ndarray, label: int, itself: tuple[int, int], x: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's first k rows of the anchor's label but itself: places and scores."""
    bitmap = x.labels == label
    if x.number == itself[0]:
        bitmap[itself[1]] = False

    def may_count(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        return upper >= np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) > k else np.ones(len(lower), bool)

    at, score = vertical_scan(q, x, bitmap, may_count)
    best = x.first(at, score, k)
    return at[best], score[best]


def best_in_windows(q: np.ndarray, label: int, windows: np.ndarray, x: Block, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (least, greatest score) the block's first k rows of other labels in it."""

    def may_count(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        out = np.zeros(len(lower), bool)
        for low, high in windows:
            if low > high:
                continue
            sure = lower[(lower >= low) & (upper <= high)]  # these are in the window whatever is still to be read
            bound = max(low, np.partition(sure, len(sure) - k)[len(sure) - k]) if len(sure) >= k else low
            out |= (upper >= bound) & (lower <= high)
        return out

    at, score = vertical_scan(q, x, x.labels != label, may_count)
    out = []
    for low, high in windows:
        inside = np.flatnonzero((score >= low) & (score <= high))
        best = inside[x.first(at[inside], score[inside], k)]
        out.append((at[best], score[best]))
    return out


def _score_window(score: Column, part: tuple[int, int], whole: int) -> tuple[Column, Column]:
    """Least and greatest negative score: part[0] * score <= whole * negative <= part[1] * score."""
    down = lambda a: F.call_function("div", a - F.pmod(a, F.lit(whole)), F.lit(whole))
    return -down(-part[0] * score), down(part[1] * score)


def hard_negatives(
    rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, part: tuple[int, int] = (50, 95), whole: int = 100, scale: int = 256, block: int = 8192, anchors: int = 1024
) -> DataFrame:
    """rows: of usable(). anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    stored = written(blocks_of(rows, every, scale, block))
    one = stored.agg(F.sum("n").alias("n"), F.sum(F.size("anchors")).alias("anchors")).first()
    down, across = max(1, -(-(one["n"] or 0) // block)), max(1, -(-(one["anchors"] or 0) // anchors))
    deal = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    table = stored.select("block", "payload", deal(down, "block").alias("i"), each(across).alias("j"))
    asked = stored.select("block", F.explode("anchors").alias("a")).select("block", F.col("a.row").alias("row"), F.col("a.id").alias("anchor_id"), F.col("a.label").alias("label"), F.col("a.vector").alias("vector"))

    def meet(asked: DataFrame, find, schema: str) -> DataFrame:
        side = asked.withColumn("j", deal(across, "block", "row")).withColumn("i", each(down))
        return table.groupBy("i", "j").cogroup(side.groupBy("i", "j")).applyInPandas(find, schema)

    def blocks(pdf: pd.DataFrame) -> Iterator[Block]:
        for number, payload in zip(pdf["block"], pdf["payload"], strict=True):
            yield Block(int(number), payload)

    def frame(names: list[str], rows: list[tuple]) -> pd.DataFrame:
        """rows: the names' values, then the block and the places and scores of what was found there."""
        sizes = [len(r[-1]) for r in rows]
        out = {c: np.repeat(np.array([r[k] for r in rows], np.int64), sizes) for k, c in enumerate(names)}
        join = lambda parts, kind: np.concatenate([*parts, np.empty(0, kind)]).astype(kind)
        ids = pd.arrays.IntegerArray(join([r[-3].ids[r[-2]] for r in rows], np.int64), join([r[-3].null[r[-2]] for r in rows], bool))
        return pd.DataFrame(out | {"id": ids, "score": join([r[-1] for r in rows], np.int64)})

    def find_positives(have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        for x in blocks(have) if len(ask) else ():
            for b, r, i, label, v in zip(ask["block"], ask["row"], ask["anchor_id"], ask["label"], ask["vector"], strict=True):
                out.append((b, r, x, *best_of_label(np.frombuffer(v, np.int32), label, (b, r), x, positives)))
        return frame(["block", "row"], out)

    key = W.Window.partitionBy("block", "row")
    first = lambda w: w.orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    best = meet(asked, find_positives, "block long, row int, id long, score long").withColumn("k", F.row_number().over(first(key))).filter(F.col("k") <= positives)
    low, high = _score_window(F.col("score"), part, whole)
    windows = best.groupBy("block", "row").agg(F.sort_array(F.collect_list(F.struct("k", "id", "score", low.alias("low"), high.alias("high")))).alias("positives"))
    with_windows = written(asked.join(windows, ["block", "row"]))

    def find_negatives(have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        for x in blocks(have) if len(ask) else ():
            for b, r, label, v, known in zip(ask["block"], ask["row"], ask["label"], ask["vector"], ask["positives"], strict=True):
                ranges = np.array([(p["low"], p["high"]) for p in known], np.int64)
                out += [(b, r, p["k"], x, *got) for p, got in zip(known, best_in_windows(np.frombuffer(v, np.int32), label, ranges, x, negatives), strict=True)]
        return frame(["block", "row", "k"], out)

    found = meet(with_windows, find_negatives, "block long, row int, k int, id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(first(W.Window.partitionBy("block", "row", "k")))).filter(F.col("rank") <= negatives)
    known = with_windows.select("block", "row", "anchor_id", F.explode("positives").alias("p")).select("block", "row", "anchor_id", F.col("p.k").alias("k"), F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return ranked.join(known, ["block", "row", "k"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
