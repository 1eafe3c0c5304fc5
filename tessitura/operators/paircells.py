"""All pairs of texts that share enough word n-grams, and their measures, in a grid of cells.

Equal texts are one class; a class's words are cut once. Requests and candidates are dealt into blocks by class, and a cell holds the
classes of two blocks with the n-grams that more than one class has. No row is a pair before the result: measures that need a request's whole
pool (frequencies, the largest score) are sums over cells of a row for each request, and the cells are then gone through again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import tokenize
from ..sources.shared import written

#: Counters at a time, places of n-grams or words at a time, rows of a batch of the result.
COUNTERS, PLACES, ROWS = 1 << 22, 1 << 22, 1 << 18
#: Bytes of rows that are packed at a time.
PACKED = 1 << 27
#: N-grams of a task that finds the shared ones.
RUNS = 1 << 21
#: Up to so many words of requests, their n-grams go to every task.
FEW = 1 << 20
NONE = "CAST(array() AS array<bigint>)"
#: What classes() counts: words, different ones, different n-grams and longer ones.
NUMBERS = ("size", "n_words", "n_grams", "n_long")


def _runs(w: Column, k: int) -> Column:
    """Distinct hashes of runs of k words, from the words' hashes; at least k words."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k)))))


def classes(requests: DataFrame, candidates: DataFrame, n: int, anchor_n: int, least: int, *more: str) -> DataFrame:
    """class (a number), text (words joined by a space), asked and held (ids of its requests and candidates), how many words (size), distinct ones and
    n-grams it has, of texts with enough words. more: strings that texts of one class have in common too."""
    of = dict(requests.dtypes)["id"]
    rows = requests.select(F.col("id").alias("r"), F.lit(None).cast(of).alias("c"), "text", *more).unionByName(candidates.select(F.lit(None).cast(of).alias("r"), F.col("id").alias("c"), "text", *more))
    cut = rows.select("r", "c", *more, F.explode(F.array(tokenize(F.lower("text")))).alias("w")).filter(F.size("w") >= n + least - 1)
    text = F.array_join("w", " ")
    one = cut.select("r", "c", *more, text.alias("text"), F.md5(F.concat_ws("\n", text, *more).cast("binary")).alias("digest")).groupBy("digest")
    one = one.agg(*(F.first(x).alias(x) for x in ("text", *more)), F.collect_list("r").alias("asked"), F.collect_list("c").alias("held")).withColumn("class", F.monotonically_increasing_id())
    hashed = _hashed(one, "text", *more).select("class", "text", *more, "asked", "held", "w")

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, rows = Lists(pa.chunked_array([batch["w"]])), len(batch)
            found = [w.sizes, *(np.bincount(_run_hashes(w, k)[0], minlength=rows) for k in (1, n, anchor_n))]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["w"]).columns, *(pa.array(x, pa.int32()) for x in found)], [*batch.schema.names[:-1], *NUMBERS])

    kinds = ", ".join([*(f"`{c}` {t}" for c, t in hashed.drop("w").dtypes), *(f"{x} int" for x in NUMBERS)])
    return written(hashed.mapInArrow(numbers, kinds))


def _hashed(texts: DataFrame, *more: str) -> DataFrame:
    # One array, exploded as a row: what is made of it then doesn't cut the text anew.
    return texts.select("class", "asked", "held", *more, F.explode(F.array(F.transform(F.split("text", " "), lambda w: F.xxhash64(w)))).alias("w"))


def _common(texts: DataFrame, k: int, name: str, few: bool = False, parts: int = 8) -> DataFrame:
    """class and, as arrays, its runs of k words that a class of requests and another one of candidates have: runs that the same classes have are one value (a sum
    over these classes), and `name`_n is how many they are. few: the requests' runs are few, and those that none of them has go before anything is shuffled."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, gram = _run_hashes(Lists(pa.chunked_array([batch["w"]])), k)
            for low in range(0, len(rows), ROWS):
                of = batch.select(["class", "side"]).take(pa.array(rows[low : low + ROWS]))
                yield pa.RecordBatch.from_arrays([*of.columns, pa.array(gram[low : low + ROWS])], [*of.schema.names, "gram"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A row is a batch's runs of one part: none is a row by itself before it is known to be shared.
        for batch in batches:
            of, side = batch["class"].to_numpy(), batch["side"].to_numpy()
            if "gram" in batch.schema.names:
                rows, gram = np.arange(len(batch)), batch["gram"].to_numpy()
            else:
                rows, gram = _run_hashes(Lists(pa.chunked_array([batch["w"]])), k)
            part = ((gram.view(np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            ends = np.cumsum(np.bincount(part, minlength=parts))
            cut = lambda x: pa.array([y.tobytes() for y in np.split(x[order], ends[:-1])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), cut(gram), cut(of[rows]), cut(side[rows])], ["part", "gram", "class", "side"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        gram, of, side = (np.concatenate([np.frombuffer(x.as_buffer(), t) for b in rows for x in b[c]] or [np.empty(0, t)]) for c, t in (("gram", np.int64), ("class", np.int64), ("side", np.int8)))
        if not len(gram):
            return
        r, c = (side & 1) > 0, (side & 2) > 0
        order = np.argsort(gram)
        gram, of, r, c = gram[order], of[order], r[order], c[order]
        first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        n = np.diff(first, append=len(of))
        some = np.repeat((n > 1) & np.logical_or.reduceat(r, first) & np.logical_or.reduceat(c, first), n)
        value = np.repeat(np.add.reduceat(_mixed(of.view(np.uint64) + np.uint64(1)), first), n)[some]
        of = of[some]
        order = np.lexsort((value, of))
        of, value = of[order], value[order]
        first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (value[1:] != value[:-1]))[: len(of)])
        n = np.diff(first, append=len(of))
        for low in range(0, len(first), ROWS):
            at = first[low : low + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(of[at]), pa.array(value[at].view(np.int64)), pa.array(n[low : low + ROWS], pa.int32())], ["class", "value", "n"])

    side = F.when(F.size("asked") > 0, 1).otherwise(0) + F.when(F.size("held") > 0, 2).otherwise(0)
    rows = _hashed(texts).select("class", side.cast("tinyint").alias("side"), "w")
    if few:
        rows = rows.mapInArrow(runs, "class long, side tinyint, gram long")
        rows = rows.join(F.broadcast(rows.filter("side % 2 = 1").select("gram").distinct()), "gram", "left_semi").select("class", "side", "gram")
    seen = rows.mapInArrow(packed, "part int, gram binary, class binary, side binary").groupBy("part").applyInArrow(shared, "class long, value long, n int")
    seen = seen.groupBy("class", "value").agg(F.sum("n").cast("int").alias("n"))
    lists = seen.groupBy("class").agg(F.collect_list(F.struct("value", "n")).alias("x"))
    return written(lists.select("class", F.col("x.value").alias(name), F.col("x.n").alias(f"{name}_n")))


def with_lists(rows: DataFrame, lists: DataFrame, name: str) -> DataFrame:
    """Rows with what _common() gives of their class, nothing for a class without."""
    none = {name: F.coalesce(name, F.expr(NONE)), f"{name}_n": F.coalesce(f"{name}_n", F.expr("CAST(array() AS array<int>)"))}
    return rows.join(lists, "class", "left").withColumns(none)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers (uint64) as random ones, one for one."""
    for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(by)
    return x ^ (x >> np.uint64(29))


def _run_hashes(w: Lists, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each different run of k of the rows' hashed words, row after row."""
    n = np.maximum(w.sizes - (k - 1), 0)
    rows, at = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) + np.repeat(w.starts - (np.cumsum(n) - n), n)
    words, out = w.values.to_numpy(zero_copy_only=False).view(np.uint64), np.zeros(len(at), np.uint64)
    for j in range(k):
        out = _mixed((out * np.uint64(0x9E3779B97F4A7C15)) ^ words[at + j])
    key = _mixed(out + _mixed(rows.astype(np.uint64)))  # row and run as one number
    order = np.argsort(key)
    key = key[order]
    some = np.sort(order[np.append(True, key[1:] != key[:-1])[: len(key)]])
    return rows[some], out[some].view(np.int64)


class Lists:
    """A column of lists as one array of values and where each begins."""

    def __init__(self, column: pa.ChunkedArray):
        one = column.combine_chunks()
        one = pa.concat_arrays(one.chunks) if isinstance(one, pa.ChunkedArray) else one
        self.values, self.sizes = one.flatten(), pc.list_value_length(one).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Places of the values of these rows, one row's after the other's."""
        n = self.sizes[rows]
        return np.arange(n.sum()) + np.repeat(self.starts[rows] - (np.cumsum(n) - n), n)


class Coded:
    """The values of two sides' lists as numbers that both share; a value that the right side lacks has -1."""

    def __init__(self, left: Lists, right: Lists):
        own, self.right = np.unique(right.values.to_numpy(zero_copy_only=False), return_inverse=True)
        asked = left.values.to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(own, asked), max(len(own) - 1, 0))
        self.left = np.where(own[at] == asked, at, -1) if len(own) else np.full(len(asked), -1)
        self.n = len(own)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by block, a part of a block's as one value: cells are sent copies of these, in which each hash is held once."""
    some, size = [], 0
    for batch in batches:
        if len(batch):
            some, size = [*some, batch], size + batch.nbytes
        if size >= PACKED:
            yield _pieces(some)
            some, size = [], 0
    if some:
        yield _pieces(some)


def _pieces(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches)
    block, rows = rows["block"].to_numpy(), rows.drop_columns(["block"])
    order = np.argsort(block, kind="stable")
    blocks, first = np.unique(block[order], return_index=True)
    out = []
    for at in np.split(order, first[1:]):
        part = rows.take(pa.array(at)).combine_chunks()
        for k, c in enumerate(part.column_names):
            x = part[c].combine_chunks()
            x = pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x
            if pa.types.is_list(x.type) and (pa.types.is_int64(x.type.value_type) or pa.types.is_string(x.type.value_type)):
                offsets = pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy())]), pa.int32())
                part = part.set_column(k, c, pa.ListArray.from_arrays(offsets, x.flatten().dictionary_encode(), mask=x.is_null() if x.null_count else None))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(part)
        out.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(out, pa.binary())], ["block", "packed"])


def _unpacked(data: pa.Buffer) -> pa.Table:
    rows = pa.ipc.open_stream(data).read_all().combine_chunks()
    for k, c in enumerate(rows.column_names):
        kind = rows.schema.field(c).type
        if pa.types.is_list(kind) and pa.types.is_dictionary(kind.value_type):
            x = rows[c].chunk(0) if rows[c].num_chunks else rows[c].combine_chunks()
            rows = rows.set_column(k, c, pa.ListArray.from_arrays(x.offsets, x.values.dictionary_decode(), mask=x.is_null() if x.null_count else None))
    return rows


class Cell:
    def __init__(self, batches: Iterator[pa.RecordBatch], least: int):
        rows = pa.Table.from_batches(list(batches))
        if "packed" in rows.column_names:
            rows = pa.concat_tables(_unpacked(x.as_buffer()) for x in rows["packed"]).combine_chunks()
        self.least, self.r, self.c = least, rows.filter(rows["asks"]), rows.filter(pc.invert(rows["asks"]))
        self.ids = tuple(Lists(x["ids"]) for x in (self.r, self.c))
        own, other = (x["class"].to_numpy() for x in (self.r, self.c))
        order = np.argsort(other)
        at = np.minimum(np.searchsorted(other[order], own), max(len(other) - 1, 0))
        self.same = np.where(other[order][at] == own, order[at], -1) if len(other) else np.full(len(own), -1)
        self.is_held = self.r["is_held"].to_numpy(zero_copy_only=False).astype(bool)

    def number(self, side: str, name: str) -> np.ndarray:
        return getattr(self, side)[name].to_numpy()

    def lists(self, name: str) -> tuple[Lists, Lists]:
        return Lists(self.r[name]), Lists(self.c[name])

    def members(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """How many candidates of c a request of r has: itself is none."""
        return self.ids[1].sizes[c] - ((self.same[r] == c) & self.is_held[r])

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of both sides, those of the left in order, and how many n-grams they share; all pairs of a left row in one batch."""
        width = len(self.c)
        if not width:
            return
        grams, n_grams = Sums(self, "grams"), self.number("r", "n_grams")
        step = max(1, COUNTERS // width)
        for low in range(0, len(self.r), step):
            high = min(low + step, len(self.r))
            counts = grams.table(low, high)
            own = np.arange(low, high)[self.same[low:high] >= 0]
            counts[(own - low) * width + self.same[own]] = n_grams[own]
            hit = np.flatnonzero(counts >= self.least)
            r, c = hit // width + low, hit % width
            some = self.members(r, c) > 0
            yield r[some], c[some], counts[hit[some]].astype(np.int64)

    def expanded(self, r: np.ndarray, c: np.ndarray, **values: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A row for each pair of different ids of the two classes."""
        wide = self.ids[1].sizes[c]
        ends = np.cumsum(self.ids[0].sizes[r] * wide)
        for low in range(0, int(ends[-1]) if len(ends) else 0, ROWS):
            at = np.arange(low, min(low + ROWS, int(ends[-1])))
            p = np.searchsorted(ends, at, "right")
            at -= np.concatenate([[0], ends])[p]
            a = self.ids[0].values.take(pa.array(self.ids[0].starts[r[p]] + at // wide[p]))
            b = self.ids[1].values.take(pa.array(self.ids[1].starts[c[p]] + at % wide[p]))
            yield pa.RecordBatch.from_arrays([a, b, *(pa.array(v[p]) for v in values.values())], ["request_id", "candidate_id", *values]).filter(pc.not_equal(a, b))


def _each(cell: Cell, r: np.ndarray, c: np.ndarray, right: Lists) -> Iterator[tuple[int, slice, np.ndarray]]:
    """For each left row, and about PLACES values of its partners at a time: the row, which of the pairs, places of their values."""
    at = np.flatnonzero(np.diff(r, prepend=-1))
    for k, low in zip(r[at].tolist(), at.tolist(), strict=True):
        high = low + int(np.searchsorted(r[low:], k, "right"))
        ends = np.cumsum(right.sizes[c[low:high]])
        a = 0
        while a < high - low:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PLACES, "right")))
            yield k, slice(low + a, low + b), right.places(c[low + a : low + b])
            a = b


class Sums:
    """For pairs: the sum, over the values that both sides' lists have, of a weight of the left's value (how many n-grams it stands for, if none is given).
    Values with the same holders on both sides are one group, so that a passage of many values costs as much as one."""

    def __init__(self, cell: Cell, name: str):
        self.cell, (self.left, self.right) = cell, cell.lists(name)
        self.n = Lists(cell.r[f"{name}_n"]).values.to_numpy(zero_copy_only=False)
        codes = Coded(self.left, self.right)
        at, of = np.flatnonzero(codes.left >= 0), np.repeat(np.arange(len(self.right.sizes)), self.right.sizes)
        asker, code = np.repeat(np.arange(len(self.left.sizes)), self.left.sizes)[at], codes.left[at]
        group, first = _alike(codes.n, (asker, code), (of, codes.right))
        n_groups = int(group.max(initial=-1)) + 1
        held = first[codes.right]
        own, holders = group[codes.right[held]], of[held]
        self.holders, self.lists = holders[np.argsort(own, kind="stable")], np.bincount(own, minlength=n_groups)
        self.starts = np.cumsum(self.lists) - self.lists
        #: Each left row's groups (slots), and the left values of a slot.
        keys, self.slot = np.unique(asker * n_groups + group[code], return_inverse=True)
        self.at, (self.asker, self.group) = at, np.divmod(keys, max(n_groups, 1))
        self.ends = np.cumsum(self.lists[self.group])
        self.first = np.searchsorted(self.asker, np.arange(len(self.left.sizes) + 1))

    def _places(self, low: int, high: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """About PLACES at a time: which slots of the left rows low to high, how many holders each has, and the holders."""
        a, last = int(self.first[low]), int(self.first[high])
        while a < last:
            b = max(a + 1, min(int(np.searchsorted(self.ends, (self.ends[a - 1] if a else 0) + PLACES, "right")), last))
            n = self.lists[self.group[a:b]]
            yield a, b, n, self.holders[np.arange(n.sum()) + np.repeat(self.starts[self.group[a:b]] - (np.cumsum(n) - n), n)]
            a = b

    def table(self, low: int, high: int, weights: np.ndarray | None = None) -> np.ndarray:
        """The sums of the left rows low to high and every right row, one left row's after the other's."""
        width = len(self.right.sizes)
        out = np.zeros((high - low) * width)
        weight = np.bincount(self.slot, (self.n if weights is None else weights)[self.at], len(self.asker))
        for a, b, n, holders in self._places(low, high):
            at = np.repeat((self.asker[a:b] - low) * width, n)
            at += holders
            out += np.bincount(at, np.repeat(weight[a:b], n), len(out))
        return out

    def of(self, r: np.ndarray, c: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """r: in order."""
        width, out = len(self.right.sizes), np.zeros(len(r))
        for low, high, which in _strips(r, width):
            out[which] = self.table(low, high, weights)[(r[which] - low) * width + c[which]]
        return out

    def members(self, r: np.ndarray, c: np.ndarray, out: np.ndarray) -> None:
        """Adds to out, for each left value, how many members of the partners have it. r: in order."""
        width, of_slots = len(self.right.sizes), np.zeros(len(self.asker), np.int64)
        for low, high, which in _strips(r, width):
            partners = np.zeros((high - low) * width, np.int64)
            partners[(r[which] - low) * width + c[which]] = self.cell.members(r[which], c[which])
            for a, b, n, holders in self._places(low, high):
                at = np.repeat((self.asker[a:b] - low) * width, n)
                at += holders
                of_slots[a:b] = np.add.reduceat(partners[at], np.cumsum(n) - n)
        out[self.at] += of_slots[self.slot]


def _strips(r: np.ndarray, width: int) -> Iterator[tuple[int, int, slice]]:
    """Left rows of pairs, in order, some COUNTERS of places at a time."""
    step, a = max(1, COUNTERS // max(width, 1)), 0
    while a < len(r):
        b = int(np.searchsorted(r, r[a] + step))
        yield int(r[a]), int(r[b - 1]) + 1, slice(a, b)
        a = b


def _alike(n: int, *sides: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """sides: rows and the values (0 to n - 1) that they hold. Each value's group (-1 if the first side lacks it), equal for values that the same rows of all sides
    hold, and whether it stands for its group. Holders are told apart by two sums of 64 random bits."""
    rnd, sums = np.random.default_rng(1), np.zeros((2, n), np.uint64)
    for rows, values in sides:
        bits = rnd.integers(0, 1 << 64, (2, int(rows.max(initial=-1)) + 1), dtype=np.uint64)
        for k in (0, 1):
            np.add.at(sums[k], values, bits[k][rows])
    order = np.lexsort(sums)
    order = order[np.bincount(sides[0][1], minlength=n)[order] > 0]
    new = np.ones(len(order), bool)
    new[1:] = (sums[:, order[1:]] != sums[:, order[:-1]]).any(axis=0)
    group, first = np.full(n, -1), np.zeros(n, bool)
    group[order], first[order] = np.cumsum(new) - 1, new
    return group, first


class Common:
    """For pairs: how many values both sides' lists have. The values in most pairs are bits of a row, the others are counted by their holders."""

    def __init__(self, cell: Cell, name: str, bits: int = 2048):
        left, right = cell.lists(name)
        codes = Coded(left, right)
        self.width = len(right.sizes)
        rows = [np.repeat(np.arange(len(x.sizes)), x.sizes) for x in (left, right)]
        at = np.flatnonzero(codes.left >= 0)
        asker, asked = rows[0][at], codes.left[at]
        asks, holds = np.bincount(asked, minlength=codes.n), np.bincount(codes.right, minlength=codes.n)
        place = np.full(codes.n, -1)
        often = np.argsort(-asks * holds, kind="stable")[:bits]
        place[often] = np.arange(len(often))
        self.bits = tuple(_bits(len(x.sizes), of, place[values], bits) for x, of, values in ((left, asker, asked), (right, rows[1], codes.right)))
        rare = (place < 0) & (asks > 0)
        some = rare[codes.right]
        self.holders = rows[1][some][np.argsort(codes.right[some], kind="stable")]
        self.lists = np.where(rare, holds, 0)
        self.starts = np.cumsum(self.lists) - self.lists
        some = rare[asked]
        self.asker, self.asked = asker[some], asked[some]
        self.ends = np.cumsum(self.lists[self.asked])
        self.first = np.searchsorted(self.asker, np.arange(len(left.sizes) + 1))

    def of(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """r: in order."""
        out = np.zeros(len(r), np.int64)
        for low, high, which in _strips(r, self.width):
            table = np.zeros((high - low) * self.width, np.int64)
            a, last = int(self.first[low]), int(self.first[high])
            while a < last:
                b = max(a + 1, min(int(np.searchsorted(self.ends, (self.ends[a - 1] if a else 0) + PLACES, "right")), last))
                n = self.lists[self.asked[a:b]]
                at = np.repeat(self.starts[self.asked[a:b]] - (np.cumsum(n) - n), n)
                at += np.arange(len(at))
                at = self.holders[at]
                at += np.repeat((self.asker[a:b] - low) * self.width, n)
                table += np.bincount(at, minlength=len(table))
                a = b
            out[which] = table[(r[which] - low) * self.width + c[which]]
        step = max(1, (1 << 16) // max(self.bits[0].shape[1], 1))
        for low in range(0, len(r), step):
            both = self.bits[0][r[low : low + step]]
            both &= self.bits[1][c[low : low + step]]
            out[low : low + step] += np.bitwise_count(both).sum(axis=1, dtype=np.uint32)
        return out


def _bits(n: int, rows: np.ndarray, places: np.ndarray, bits: int) -> np.ndarray:
    """n rows of bits: those at the places (-1: none) of each row."""
    out, some = np.zeros((n, -(-bits // 64)), np.uint64), places >= 0
    np.bitwise_or.at(out, (rows[some], places[some] >> 6), np.uint64(1) << (places[some] & 63).astype(np.uint64))
    return out


class Grid:
    """requests, candidates: id (of one type, unique), text, and `more`. Measures of all pairs with at least `least` common n-grams."""

    def __init__(self, requests: DataFrame, candidates: DataFrame, n: int = 4, anchor_n: int = 5, least: int = 3, block: int | None = None, more: tuple[str, ...] = ()):
        self.n, self.anchor_n, self.least, self.id = n, anchor_n, least, dict(requests.dtypes)["id"]
        self.other_id = dict(candidates.dtypes)["id"]
        self.texts = classes(requests, candidates, n, anchor_n, least, *more)
        sizes = self.texts.agg(F.count_if(F.size("asked") > 0).alias("r"), F.count_if(F.size("held") > 0).alias("c"), F.sum(F.when(F.size("asked") > 0, F.col("size"))).alias("words"), F.sum("size").alias("all")).first()
        self.few = (sizes["words"] or 0) <= FEW
        deal = lambda k, parts, low, high: max(1, -(-sizes[k] // (block or min(max(-(-sizes[k] // parts), low), high))))
        self.cells = deal("r", 2, 256, 1 << 14), deal("c", 8, 1024, 1 << 15)
        self.parts = max(8, -(-(sizes["all"] or 0) // RUNS))
        many = with_lists(self.texts.drop("text", *more), self.common(self.texts, n, "grams"), "grams")
        # Of a class without such n-grams only its own requests and candidates can be pairs.
        own = (F.size("asked") > 0) & (F.size("held") > 0) & (F.size(F.array_union("asked", "held")) > 1)
        self.rows = many.filter((F.aggregate("grams_n", F.lit(0), lambda a, x: a + x) >= least) | own)
        if self.few:
            self.rows = written(self.rows)

    def common(self, texts: DataFrame, k: int, name: str) -> DataFrame:
        return _common(texts, k, name, self.few, self.parts)

    def placed(self, rows: DataFrame, of_requests: DataFrame | None = None):
        """Rows by cell. of_requests: class, is_held and what only requests have."""
        (ni, nj), deal = self.cells, lambda n: F.pmod(F.xxhash64("class"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        ways = F.explode(F.array(F.struct(F.lit(True).alias("is_held"), F.array_intersect("asked", "held").alias("ids")), F.struct(F.lit(False).alias("is_held"), F.array_except("asked", "held").alias("ids")))).alias("way")
        plain = [c for c in rows.columns if c not in ("asked", "held")]
        asks = rows.select(*plain, ways).filter(F.size("way.ids") > 0).select(*plain, "way.*")
        more = [c for c in of_requests.columns if c not in ("class", "is_held")] if of_requests is not None else []
        if more:
            asks = asks.join(of_requests, ["class", "is_held"], "left")
        holds = rows.filter(F.size("held") > 0).select(*plain, F.lit(False).alias("is_held"), F.col("held").alias("ids"), *(F.lit(None).cast(dict(of_requests.dtypes)[c]).alias(c) for c in more))
        names = ["asks", *plain, "is_held", "ids", *more]
        left = asks.select(deal(ni).alias("block"), F.lit(True).alias("asks"), *plain, "is_held", "ids", *more).select("block", *names)
        right = holds.select(deal(nj).alias("block"), F.lit(False).alias("asks"), *plain, "is_held", "ids", *more).select("block", *names)
        packed = lambda x: x.mapInArrow(_packed, "block int, packed binary")
        left = packed(left).select(F.col("block").alias("i"), every(nj).alias("j"), "packed")
        return left.unionByName(packed(right).select(every(ni).alias("i"), F.col("block").alias("j"), "packed")).groupBy("i", "j")

    def pairs(self) -> DataFrame:
        """request_id, candidate_id, shared."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell = Cell(batches, least)
            for r, c, shared in cell.pairs():
                yield from cell.expanded(r, c, shared=shared)

        least = self.least
        return self.placed(self.rows).applyInArrow(run, f"request_id {self.id}, candidate_id {self.other_id}, shared long")

    def _pools(self, rows: DataFrame) -> DataFrame:
        """class, is_held, df (of each of the class's `long`: how many of the request's candidates have it), most (the largest raw anchor)."""
        least = self.least

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell = Cell(batches, least)
            sums = Sums(cell, "long")
            df = np.zeros(len(sums.left.values), np.int64)
            for r, c, _ in cell.pairs():
                sums.members(r, c, df)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([sums.left.starts, [len(df)]]).astype(np.int32)), pa.array(df))
            yield pa.RecordBatch.from_arrays([cell.r["class"].combine_chunks(), pa.array(cell.is_held), lists], ["class", "is_held", "df"])

        def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell = Cell(batches, least)
            raw, most = Raw(cell), np.zeros(len(cell.r))
            for r, c, _ in cell.pairs():
                own = np.flatnonzero(np.diff(r, prepend=-1))
                most[r[own]] = np.maximum.reduceat(raw.of(r, c), own) if len(own) else 0.0
            yield pa.RecordBatch.from_arrays([cell.r["class"].combine_chunks(), pa.array(cell.is_held), pa.array(most)], ["class", "is_held", "most"])

        parts = self.placed(rows).applyInArrow(count, "class long, is_held boolean, df array<bigint>").groupBy("class", "is_held").agg(F.collect_list("df").alias("dfs"))
        df = written(parts.select("class", "is_held", F.aggregate(F.slice("dfs", 2, F.size("dfs")), F.col("dfs")[0], lambda a, x: F.zip_with(a, x, lambda p, q: p + q)).alias("df")))
        most = self.placed(rows, df).applyInArrow(largest, "class long, is_held boolean, most double").groupBy("class", "is_held").agg(F.max("most").alias("most"))
        return written(df.join(most, ["class", "is_held"]))

    def measures(self, words: bool = True, anchor: bool = False) -> DataFrame:
        """request_id, candidate_id; words: coverage_request, coverage_candidate, ngram, length; anchor: anchor."""
        least, names = self.least, [*(("coverage_request", "coverage_candidate", "ngram", "length") if words else ()), *(("anchor",) if anchor else ())]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell = Cell(batches, least)
            for r, c, values in measured(cell, words, anchor):
                yield from cell.expanded(r, c, **values)

        return self._measured(words, anchor).applyInArrow(run, f"request_id {self.id}, candidate_id {self.other_id}, " + ", ".join(f"{x} double" for x in names))

    def best(self, score, keep: int = 2) -> DataFrame:
        """request_id, candidate_id, score: `score` takes a measure's values by name as arrays; of each request the best of each cell, at
        least `keep` in all, ties by the smaller candidate_id."""
        least = self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell = Cell(batches, least)
            for r, c, values in measured(cell, True, True):
                top: pa.Table | None = None
                scores = score(**values)
                some = _leading(r, scores, keep + 1)  # of one pair of classes a request may be the only candidate itself
                for batch in cell.expanded(r[some], c[some], score=scores[some]):
                    rows = pa.Table.from_batches([batch] if top is None else [*top.to_batches(), batch])
                    frame = rows.to_pandas().sort_values(["request_id", "score", "candidate_id"], ascending=[True, False, True])
                    top = pa.Table.from_pandas(frame.groupby("request_id", sort=False).head(keep), schema=rows.schema, preserve_index=False)
                if top is not None:
                    yield from top.combine_chunks().to_batches()

        return self._measured(True, True).applyInArrow(run, f"request_id {self.id}, candidate_id {self.other_id}, score double")

    def lacking(self, features: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        """features: id (a class of self.texts), word, count, keys. What wordmatch.lacking_words() gives, as request_id, candidate_id, words, occurrences, found."""
        least = self.least
        hashed = [F.when(F.col(k) != "", F.xxhash64(k)).otherwise(0).alias(k) for k in keys]
        packed = features.select("id", F.struct(F.xxhash64("word").alias("words"), "count", *hashed).alias("x")).groupBy("id").agg(F.collect_list("x").alias("x"))
        rows = self.rows.join(packed.select(F.col("id").alias("class"), *(F.col(f"x.{c}").alias(c) for c in ("words", "count", *keys))), "class")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell = Cell(batches, least)
            lost = Lost(cell, keys)
            for r, c, _ in cell.pairs():
                words, occurrences, found = lost.of(r, c)
                some = words > 0
                yield from cell.expanded(r[some], c[some], words=words[some], occurrences=occurrences[some], found=found[some])

        return self.placed(rows).applyInArrow(run, f"request_id {self.id}, candidate_id {self.other_id}, words long, occurrences long, found long")

    def _measured(self, words: bool, anchor: bool):
        rows, of_requests = self.rows, None
        if anchor:
            rows = written(with_lists(rows, self.common(self.texts, self.anchor_n, "long"), "long"))
            of_requests = self._pools(rows)
        if words:
            rows = rows.join(_hashed(self.texts).select("class", F.array_distinct("w").alias("words")), "class")
        return self.placed(rows, of_requests)


def _leading(r: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """r: in order. Which pairs have one of the n highest different scores of their left row."""
    first = np.flatnonzero(np.diff(r, prepend=-1))
    if not len(first):
        return first
    wide, left = np.diff(first, append=len(r)), scores.copy()
    for _ in range(n - 1):
        left[left == np.repeat(np.maximum.reduceat(left, first), wide)] = -np.inf
    return np.flatnonzero(scores >= np.repeat(np.maximum.reduceat(left, first), wide))


class Lost:
    """For pairs: the left's words that the right lacks, how often they occur, and how many of them the right has by an equal key."""

    def __init__(self, cell: Cell, keys: tuple[str, ...]):
        self.cell, (self.left, self.right) = cell, cell.lists("words")
        self.words, self.count = Coded(self.left, self.right), Lists(cell.r["count"]).values.to_numpy()
        self.keys = [(Coded(*cell.lists(k)), Lists(cell.r[k]).values.to_numpy()) for k in keys]
        self.at = np.full(max([self.words.n, *(k.n for k, _ in self.keys)]) + 1, -1)

    def _places(self, codes: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Where each of the asked codes stands among `codes`; -1: nowhere."""
        self.at[codes] = np.arange(len(codes))
        self.at[-1] = -1
        out = self.at[asked]
        self.at[codes] = -1
        return out

    def of(self, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, occurrences, found = (np.zeros(len(r), np.int64) for _ in range(3))
        for k, which, places in _each(self.cell, r, c, self.right):
            own = np.arange(self.left.starts[k], self.left.starts[k] + self.left.sizes[k])
            sizes = self.right.sizes[c[which]]
            pair = np.repeat(np.arange(len(sizes)), sizes)
            at = self._places(self.words.left[own], self.words.right[places])
            hit = at >= 0
            words[which] = len(own) - np.bincount(pair[hit], minlength=len(sizes))
            occurrences[which] = self.count[own].sum() - np.bincount(pair[hit], self.count[own][at[hit]], len(sizes)).astype(np.int64)
            have = np.zeros((len(sizes), len(own)), bool)
            for coded, values in self.keys:
                one, group = np.unique(coded.left[own], return_inverse=True)
                by_key = self._places(one, coded.right[places])
                seen = np.zeros((len(sizes), len(one)), bool)
                seen[pair[by_key >= 0], by_key[by_key >= 0]] = True
                have |= seen[:, group] & (values[own] != 0)
            have[pair[hit], at[hit]] = False
            found[which] = have.sum(axis=1)
        return words, occurrences, found


class Raw:
    """Raw anchors: the sum of 1 / df over a pair's common `long` by the candidate's number of them."""

    def __init__(self, cell: Cell):
        self.cell, self.sums = cell, Sums(cell, "long")
        df = Lists(cell.r["df"]).values.to_numpy(zero_copy_only=False)
        self.weights = np.divide(self.sums.n, df, out=np.zeros(len(df)), where=df > 0)
        left = self.sums.left
        known = np.bincount(np.repeat(np.arange(len(left.sizes)), left.sizes), self.sums.n, len(left.sizes))
        self.alone, self.size = cell.number("r", "n_long") - known, cell.number("c", "n_long")

    def of(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        total = self.sums.of(r, c, self.weights)
        # What no other class has: its members alone.
        own = np.flatnonzero(self.cell.same[r] == c)
        total[own] += self.alone[r[own]] / self.cell.members(r[own], c[own])
        return total / np.maximum(self.size[c], 1)


def measured(cell: Cell, words: bool, anchor: bool) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    common, raw = Common(cell, "words") if words else None, Raw(cell) if anchor else None
    of = lambda name, r, c: (cell.number("r", name)[r], cell.number("c", name)[c])
    for r, c, shared in cell.pairs():
        values = {}
        if common:
            both, (a, b), (x, y), (p, q) = common.of(r, c), of("n_words", r, c), of("n_grams", r, c), of("size", r, c)
            values |= {"coverage_request": both / a, "coverage_candidate": both / b, "ngram": shared / (x + y - shared), "length": np.minimum(1.0, np.abs(np.log(q / p)))}
        if raw:
            most = cell.number("r", "most")[r]
            values["anchor"] = np.divide(raw.of(r, c), most, out=np.zeros(len(r)), where=most > 0)
        yield r, c, values
