"""Words of texts against words of other texts, in the cells of a grid: no row is a pair of texts or a word of one before the result.

A cell's distinct words are numbered by length. Each distinct word that a text's partners have is compared with the text's own words
once: by equal words and keys first, then by the similarity ratio with words whose length differs by at most `band`. A product of bit sets
rules most of these out; common subsequences of the others are worked out for all of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import partial_ratio, ratio
from ..functions.text import skeleton
from ..sources.shared import written
from .paircells import ROWS, Cell, Grid, Lists, Raw, Sums, _each, _hashed, _runs, with_lists
from .wordmatch import KEYS, Words, best_ratios

#: Bits compared at a time; words of more letters than LONG are compared one at a time.
BITS, LONG = 1 << 18, 61


class Vocabulary:
    """The distinct words of both sides of a cell, shorter ones first, and each text's words by number."""

    def __init__(self, cell: Cell):
        self.lists = cell.lists("words")
        both = pa.concat_arrays([x.values for x in self.lists]).dictionary_encode()
        words = both.dictionary.to_pylist()
        order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
        number = np.empty(len(words), np.int64)
        number[order] = np.arange(len(words))
        self.at = number[both.indices.to_numpy()]
        self.letters: dict[str, int] = {}
        self.words = Words([words[k] for k in order.tolist()], self.letters)
        n = len(self.lists[0].values)
        self.codes = self.at[:n], self.at[n:]


class Levels:
    """For pairs: coverage and rate of the left's words, coverage of the right's; what word_scores() gives."""

    def __init__(self, cell: Cell, band: int = 2):
        self.band, v = band, Vocabulary(cell)
        self.lists, self.codes, self.words, self.n_letters = v.lists, v.codes, v.words, len(v.letters)
        self.bits, self.sizes = self.words.bits, self.words.sizes
        self.hidden = np.minimum(self.sizes - np.bitwise_count(self.bits), 64).astype(np.uint8)  # letters without a bit of their own
        self.counts = tuple(Lists(x["count"]).values.to_numpy() for x in (cell.r, cell.c))
        self.totals = tuple(np.bincount(np.repeat(np.arange(len(x.sizes)), x.sizes), n, len(x.sizes)) for x, n in zip(self.lists, self.counts, strict=True))
        self.keys = []
        for k in KEYS:
            of = np.zeros(len(self.sizes), np.int64)
            of[v.at] = np.concatenate([Lists(x[k]).values.to_numpy() for x in (cell.r, cell.c)])
            one, number = np.unique(of, return_inverse=True)
            self.keys.append((number, of != 0, np.zeros(len(one), bool)))
        self.same, self.points = np.zeros(len(self.sizes), bool), np.zeros(len(self.sizes), np.int64)

    def of(self, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        coverage, rate = self._one(0, r, c)
        return coverage, rate, self._one(1, c, r)[0]

    def _one(self, side: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of texts x of a side, by those of texts y of the other."""
        asked, own, order = self.lists[side], self.lists[1 - side], np.argsort(y, kind="stable")
        x, y = x[order], y[order]
        covered, points = np.zeros(len(x)), np.zeros(len(x))
        for k, which, places in _each(None, y, x, asked):
            codes, n = self.codes[side][places], self.counts[side][places]
            pair = np.repeat(np.arange(which.stop - which.start), asked.sizes[x[which]])
            words = np.unique(codes)
            self.points[words] = self._level(words, np.sort(self.codes[1 - side][own.starts[k] : own.starts[k] + own.sizes[k]]))
            got = self.points[codes]
            covered[which] = np.bincount(pair, n * (got >= 2), which.stop - which.start)
            points[which] = np.bincount(pair, n * got, which.stop - which.start)
        total, out = self.totals[side][x], (np.zeros(len(x)), np.zeros(len(x)))
        out[0][order] = np.divide(covered, total, out=np.zeros(len(x)), where=total > 0)
        out[1][order] = np.divide(points, 3 * total, out=np.zeros(len(x)), where=total > 0)
        return out

    def _level(self, words: np.ndarray, own: np.ndarray) -> np.ndarray:
        """words, own: in order. 3 for a word that own has, 2 by an equal key or a ratio of 80, 1 by a ratio of 60."""
        self.same[own] = True
        out = np.where(self.same[words], 3, 0)
        self.same[own] = False
        for number, known, seen in self.keys:
            seen[number[own]] = True
            out[(out == 0) & seen[number[words]] & known[words]] = 2
            seen[number[own]] = False
        open_ = np.flatnonzero(out == 0)
        if len(open_) and len(own):
            out[open_] = self._near(words[open_], own)
        return out

    def _near(self, words: np.ndarray, own: np.ndarray) -> np.ndarray:
        sizes, own_sizes = self.sizes[words], self.sizes[own]
        out, found = np.zeros(len(words), np.int64), []
        lengths, begins = np.unique(sizes, return_index=True)
        for size, begin, end in zip(lengths.tolist(), begins.tolist(), [*begins[1:].tolist(), len(words)], strict=True):
            first, last = np.searchsorted(own_sizes, (size - self.band, size + self.band + 1)).tolist()
            if first == last:
                continue
            if size > LONG:
                others = [self.words.words[k] for k in own[first:last].tolist()]
                best = [max(ratio(self.words.words[k], o) for o in others) for k in words[begin:end].tolist()]
                out[begin:end] = [2 if b >= 80 else 1 if b >= 60 else 0 for b in best]
                continue
            other, least = self.bits[own[first:last]], -(-(60 * (size + own_sizes[first:last])) // 200)
            step = max(1, BITS // (last - first))
            for low in range(begin, end, step):
                some = words[low : min(low + step, end)]
                common = np.bitwise_count(self.bits[some][:, None] & other)
                common += self.hidden[some][:, None]
                i, j = np.nonzero(common >= least.astype(np.uint8))
                found.append((i + low, j + first, common[i, j]))
        if found:
            i, j, most = (np.concatenate(x) for x in zip(*found, strict=True))
            table = np.zeros((len(own), self.n_letters + 1), np.uint64)
            letters = self.words.letters[own]
            for k in range(min(int(own_sizes.max()), letters.shape[1])):
                table[np.arange(len(own)), letters[:, k]] |= np.uint64(1) << np.uint64(k)
            table[:, 0] = 0  # behind the end
            total = sizes[i] + own_sizes[j]
            # Those that may have 80 first; then of each word without one the likeliest, then the others of words that still have none.
            high = 200 * most.astype(np.int64) >= 80 * total
            self._judge(out, words, table, own_sizes, i[high], j[high], total[high])
            rest = np.flatnonzero(out[i] == 0)
            if len(rest):
                rest = rest[np.lexsort((-(most[rest] / total[rest]), i[rest]))]
                top = np.diff(i[rest], prepend=-1) > 0
                a, b = rest[top], rest[~top]
                self._judge(out, words, table, own_sizes, i[a], j[a], total[a])
                b = b[out[i[b]] == 0]
                self._judge(out, words, table, own_sizes, i[b], j[b], total[b])
        return out

    def _judge(self, out: np.ndarray, words: np.ndarray, table: np.ndarray, own_sizes: np.ndarray, i: np.ndarray, j: np.ndarray, total: np.ndarray) -> None:
        if not len(i):
            return
        x = words[i]
        got = _common_lengths(table, j, own_sizes[j], self.words.letters, x, int(self.sizes[x].max()))
        out[i[200 * got >= 60 * total]] = np.maximum(out[i[200 * got >= 60 * total]], 1)
        out[i[200 * got >= 80 * total]] = 2


def _common_lengths(table: np.ndarray, j: np.ndarray, sizes: np.ndarray, letters: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Lengths of the longest common subsequences of words by their letters' places (table) and of words by their letters."""
    row, ones, flat, at = np.full(len(j), np.uint64(0xFFFFFFFFFFFFFFFF)), np.uint64(1), table.ravel(), j * table.shape[1]
    for k in range(most):
        hit = row & flat[at + letters[x, k]]
        row = (row + hit) | (row - hit)
    return np.bitwise_count(~row & ((ones << sizes.astype(np.uint64)) - ones)).astype(np.int64)


class Names:
    """Names of a cell's ids, and the hint score of pairs of ids: by the best part of the longer name."""

    def __init__(self, cell: Cell):
        known, names = {}, {}
        for side in (cell.r, cell.c):
            for of in side["named"].to_pylist():
                known.update((x["id"], names.setdefault(x["name"].casefold(), len(names))) for x in of)
        self.known, self.letters = known, {}
        self.names = Words(list(names), self.letters)
        self.table = np.zeros((len(names), len(self.letters) + 1), np.uint64)
        for k in range(self.names.letters.shape[1]):
            self.table[np.arange(len(names)), self.names.letters[:, k]] |= np.uint64(1) << np.uint64(k)
        self.table[:, 0] = 0

    def scores(self, a: list, b: list) -> np.ndarray:
        x, y = (np.fromiter((self.known.get(k, -1) for k in ids), np.int64, len(ids)) for ids in (a, b))
        out, both = np.zeros(len(x)), np.flatnonzero((x >= 0) & (y >= 0))
        for low in range(0, len(both), 1 << 15):
            some = both[low : low + (1 << 15)]
            best = self._parts(x[some], y[some]) / 100
            out[some] = np.where(best < 0.65, 0.0, np.round((best - 0.65) / 0.35, 6))
        return out

    def _parts(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        sizes, out = self.names.sizes, np.zeros(len(x))
        x, y = np.where(sizes[x] <= sizes[y], x, y), np.where(sizes[x] <= sizes[y], y, x)
        long = sizes[y] > 63
        out[long] = [partial_ratio(self.names.words[p], self.names.words[q]) for p, q in zip(x[long].tolist(), y[long].tolist(), strict=True)]
        plain = np.flatnonzero(~long & (sizes[x] > 0))
        if not len(plain):
            return out
        x, y = x[plain], y[plain]
        n = sizes[y] - sizes[x] + 1
        pair = np.repeat(np.arange(len(x)), n)
        start = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        p, q, size = x[pair], y[pair], sizes[x][pair]
        row, one, wide = np.full(len(pair), np.uint64(0xFFFFFFFFFFFFFFFF)), np.uint64(1), self.names.letters.shape[1]
        for k in range(int(size.max())):
            letter = np.where(k < size, self.names.letters[q, np.minimum(start + k, wide - 1)], 0)
            hit = row & self.table[p, letter]
            row = (row + hit) | (row - hit)
        got = np.bitwise_count(~row & ((one << size.astype(np.uint64)) - one)).astype(np.int64)
        out[plain] = 200.0 * np.maximum.reduceat(got, np.cumsum(n) - n) / (2 * sizes[x])
        return out


def _bones(clean: Column) -> Column:
    return F.array_join(F.transform(F.split(clean, " "), lambda w: F.when(skeleton(w) != "", skeleton(w)).otherwise("?")), " ")


def best_matches(grid: Grid, words: DataFrame, names: DataFrame | None = None, keep: int = 2) -> DataFrame:
    """grid: with `clean`; words: of word_rows() of its classes. request_id, candidate_id, score as match_words() gives them: of each request the best of
    each cell, at least `keep` in all, ties by the smaller candidate_id."""
    some = written(grid.texts.join(grid.rows.select("class"), "class", "left_semi").select("class", "asked", "held", "clean", _bones(F.col("clean")).alias("bones")))
    clean, bones = (some.select("class", "asked", "held", F.col(c).alias("text")) for c in ("clean", "bones"))
    count = lambda t, k, name: _hashed(t).select("class", F.when(F.size("w") >= k, F.size(_runs(F.col("w"), k))).otherwise(0).alias(name))
    sizes = clean.select("class", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", " "))).alias("clean_size"))
    rows = grid.rows.drop("size", "n_words", "n_long").join(sizes, "class").join(count(clean, grid.anchor_n, "n_long"), "class")
    rows = written(with_lists(rows, grid.common(clean, grid.anchor_n, "long"), "long"))
    pools = grid._pools(rows)
    hashed = [F.when(F.col(k) != "", F.xxhash64(F.lit(k[0]), k)).otherwise(0).alias(k) for k in KEYS]
    packed = words.select("id", F.struct("word", "count", *hashed).alias("x")).groupBy("id").agg(F.collect_list("x").alias("x"))
    rows = with_lists(rows.join(count(bones, grid.n, "n_bones"), "class"), grid.common(bones, grid.n, "bones"), "bones")
    rows = rows.join(packed.select(F.col("id").alias("class"), F.col("x.word").alias("words"), *(F.col(f"x.{c}").alias(c) for c in ("count", *KEYS))), "class", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.expr(f"CAST(array() AS {'array<string>' if c == 'words' else 'array<bigint>'})")) for c in ("words", "count", *KEYS)})
    if names is not None:
        ids = some.select("class", F.explode(F.array_union("asked", "held")).alias("id"))
        named = ids.join(names.filter("name IS NOT NULL").select("id", "name"), "id").groupBy("class").agg(F.collect_list(F.struct("id", "name")).alias("named"))
        rows = rows.join(named, "class", "left").withColumn("named", F.coalesce("named", F.expr(f"CAST(array() AS {dict(named.dtypes)['named']})")))
    least, hinted = grid.least, names is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = Cell(batches, least)
        if not len(cell.r) or not len(cell.c):
            return
        levels, raw, bones, by_name = Levels(cell), Raw(cell), Sums(cell, "bones"), Names(cell) if hinted else None
        (p, q), (a, b) = ((cell.number("r", x), cell.number("c", x)) for x in ("clean_size", "n_bones"))
        most = cell.number("r", "most")
        for r, c, _ in cell.pairs():
            coverage, rate, back = levels.of(r, c)
            total = coverage + back
            f1 = np.divide(2 * coverage * back, total, out=np.zeros(len(r)), where=total > 0)
            shared = np.where(cell.same[r] == c, a[r], bones.of(r, c))
            union = a[r] + b[c] - shared
            ngram = np.divide(shared, union, out=np.zeros(len(r)), where=union > 0)
            anchor = np.divide(raw.of(r, c), most[r], out=np.zeros(len(r)), where=most[r] > 0)
            both = (p[r] > 0) & (q[c] > 0)
            length = np.minimum(1.0, np.abs(np.log(np.where(both, q[c], 3) / np.where(both, p[r], 1))))
            yield from _top(cell, r, c, 0.55 * f1 + 0.15 * rate + 0.10 * ngram + 0.20 * anchor, 0.10 * length, by_name, keep)

    return grid.placed(rows, pools).applyInArrow(run, f"request_id {grid.id}, candidate_id {grid.other_id}, score double")


def _top(cell: Cell, r: np.ndarray, c: np.ndarray, plus: np.ndarray, minus: np.ndarray, by_name: Names | None, keep: int) -> Iterator[pa.RecordBatch]:
    top: pa.Table | None = None
    for batch in cell.expanded(r, c, plus=plus, minus=minus):
        if not len(batch):
            continue
        hint = by_name.scores(batch["request_id"].to_pylist(), batch["candidate_id"].to_pylist()) if by_name else 0.0
        score = np.round(np.clip(batch["plus"].to_numpy() + 0.30 * hint - batch["minus"].to_numpy(), 0.0, 1.0), 9)
        rows = pa.table({"request_id": batch["request_id"], "candidate_id": batch["candidate_id"], "score": score})
        frame = pa.concat_tables([rows] if top is None else [top, rows]).to_pandas().sort_values(["request_id", "score", "candidate_id"], ascending=[True, False, True])
        top = pa.Table.from_pandas(frame.groupby("request_id", sort=False).head(keep), schema=rows.schema, preserve_index=False)
    if top is not None:
        yield from top.combine_chunks().to_batches()


def best_words(grid: Grid, band: int = 2) -> DataFrame:
    """request_id, candidate_id, word (a distinct one of the request), best: its highest ratio with a word of the candidate whose length differs by at most
    `band`; no row without one."""
    rows = grid.rows.join(grid.texts.select("class", "text"), "class").withColumn("words", F.array_distinct(F.split("text", " "))).drop("text")
    least = grid.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = Cell(batches, least)
        if not len(cell.r) or not len(cell.c):
            return
        v = Vocabulary(cell)
        (left, right), best, words = v.lists, np.zeros(len(v.words.words)), pa.array(v.words.words, pa.string())

        def rows_of(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            r, c, word, ratios = (np.concatenate(x) for x in zip(*parts, strict=True))
            for batch in cell.expanded(r, c, word=word, best=ratios):
                yield pa.RecordBatch.from_arrays([batch["request_id"], batch["candidate_id"], words.take(batch["word"]), batch["best"]], ["request_id", "candidate_id", "word", "best"])

        parts: list[tuple[np.ndarray, ...]] = []
        for r, c, _ in cell.pairs():
            order = np.argsort(c, kind="stable")
            r, c = r[order], c[order]
            for k, which, places in _each(None, c, r, left):
                codes, n = v.codes[0][places], left.sizes[r[which]]
                asked, own = np.unique(codes), v.codes[1][right.starts[k] : right.starts[k] + right.sizes[k]]
                best[asked] = -2.0
                best[own[best[own] == -2.0]] = 100.0
                rest = asked[best[asked] == -2.0]
                best[rest] = best_ratios(v.words, rest, v.words, own, len(v.letters), band, 0.0)
                some = best[codes] >= 0
                parts.append((np.repeat(r[which], n)[some], np.full(int(some.sum()), k), codes[some], best[codes[some]]))
                if sum(len(x[0]) for x in parts) >= ROWS or len(parts) >= 1024:
                    yield from rows_of(parts)
                    parts = []
        if parts:
            yield from rows_of(parts)

    return grid.placed(rows).applyInArrow(run, f"request_id {grid.id}, candidate_id {grid.other_id}, word string, best double")
