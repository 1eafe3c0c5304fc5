"""Best-fit packing of documents into sequences of a fixed number of tokens, by swap-based local search.

A document longer than a sequence is cut into pieces of which only the first may be shorter; full pieces are sequences
by themselves. The others are dealt into groups of about `group` pieces by a hash, so that a task's work is bounded and the
number of groups follows the input; equal rows are dealt like any others. In a group, pieces go in the order of their documents (those
over half a sequence first) into the fullest sequence that takes them. Then the local search empties sequences: the emptiest underfull one gives, and a fuller one takes a piece, or
one or two pieces for a smaller one of its own. Each exchange increases the sum of squared fills, so that the search ends; it ends
when as few sequences are left as the tokens need, or when no underfull one can give anything to a fuller one.
Defined results: a null text counts as empty: one end token; repeated rows are pieces of their own; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, in_slices, written
from .tokens import added_tokens, encoding

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, path: str, json_path: str, pattern: str, size: int, end: int) -> DataFrame:
    """A row for each piece. path: the ranks of the vocabulary; a token that its json file adds is one token inside a text."""
    added = added_tokens(json_path)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern, added)
        names = {s for s, _ in added}
        for ids, texts in in_slices(batches):
            out: list[tuple] = []
            for doc, text in zip(ids, texts, strict=True):
                some = names if any(s in text for s in names) else set()
                got = np.append(enc.encode_to_numpy(text, allowed_special=some, disallowed_special=()), end).astype("<u4")
                first = len(got) % size or size
                for k, at in enumerate([0, *range(first, len(got), size)]):
                    part = got[at : first if k == 0 else at + size]
                    out.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
            cols = zip(*out, strict=True)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in PIECE.split(", ")])

    return id_and_text(docs).mapInArrow(pieces, PIECE)


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indices: in the given order, each piece into the fullest bin that takes it. One bit for each free length
    that some bin has."""
    free: list[list[int]] = [[] for _ in range(size + 1)]
    have, bins = 0, []
    for i, n in enumerate(lengths):
        fitting = have >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                have &= ~(1 << room)
        else:
            room, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            free[room - n].append(b)
            have |= 1 << (room - n)
    return bins


class _Offers:
    """What underfull bins could take, by length: bit n is set where some bin takes n at most, either into its free room or
    for one of its own pieces. For n itself an ordered set of (bin, piece), piece -1 for free room."""

    def __init__(self, size: int):
        self.at: list[dict[tuple[int, int], None]] = [{} for _ in range(size + 1)]
        self.have = 0

    def put(self, n: int, offer: tuple[int, int]) -> None:
        self.at[n][offer] = None
        self.have |= 1 << n

    def drop(self, n: int, offer: tuple[int, int]) -> None:
        del self.at[n][offer]
        if not self.at[n]:
            self.have &= ~(1 << n)

    def least(self, n: int, usable) -> tuple[int, tuple[int, int]] | None:
        """The offer nearest to n, not below, that is usable."""
        left = self.have >> n
        while left:
            m = n + (left & -left).bit_length() - 1
            for offer in self.at[m]:
                if usable(offer):
                    return m, offer
            left &= left - 1 if m == n else ~((1 << (m - n + 1)) - 1)
        return None


def local_search(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Empties underfull bins by exchanges; each takes what fills a fuller bin best."""
    bins = [list(b) for b in bins]
    fill = [sum(lengths[i] for i in b) for b in bins]
    least, count = -(-sum(fill) // size), sum(bool(b) for b in bins)
    rooms, slots = _Offers(size), _Offers(size)

    def offers(b: int, change) -> None:
        """All that bin b could take; each length of its pieces once."""
        room = size - fill[b]
        if not room or not bins[b]:
            return
        change(rooms, room, (b, -1))
        for n in sorted({lengths[i] for i in bins[b]}):
            change(slots, n + room, (b, n))

    for b in range(len(bins)):
        offers(b, _Offers.put)
    order = [(fill[b], b) for b in range(len(bins)) if 0 < fill[b] < size]
    heapq.heapify(order)
    idle: set[int] = set()  # bins that could give nothing since the last exchange

    def step(giver: int) -> bool:
        own = sorted({lengths[i] for i in bins[giver]}, reverse=True)
        fuller = lambda o: o[0] != giver and fill[o[0]] >= fill[giver]
        pairs = lambda: (own[k] + own[j] for k in range(len(own)) for j in range(k + 1, len(own)) if own[k] + own[j] <= size)
        best: tuple[int, int, tuple[int, int]] | None = None  # what stays free in the taker, what is given, offer
        for given, table in chain(((n, rooms) for n in own), ((n, slots) for n in own), ((n, slots) for n in pairs())):
            found = table.least(given, lambda o, given=given: fuller(o) and o[1] < given)
            if found and (best is None or found[0] - given < best[0]):
                best = (found[0] - given, given, found[1])
                if not best[0]:
                    break
        if best is None:
            return False
        _, given, (taker, back) = best
        offers(giver, _Offers.drop)
        offers(taker, _Offers.drop)
        gone = [i for i in bins[giver] if lengths[i] == given][:1]
        if not gone:
            by = {lengths[i]: i for i in bins[giver]}
            gone = next([by[n], by[given - n]] for n in own if given - n in by and given - n != n)
        returned = [i for i in bins[taker] if lengths[i] == back][:1]
        bins[giver] = [i for i in bins[giver] if i not in gone] + returned
        bins[taker] = [i for i in bins[taker] if i not in returned] + gone
        gain = given - max(back, 0)
        fill[giver] -= gain
        fill[taker] += gain
        offers(giver, _Offers.put)
        offers(taker, _Offers.put)
        return True

    while count > least and order:
        known, giver = heapq.heappop(order)
        if known != fill[giver] or giver in idle or not bins[giver] or fill[giver] == size:
            continue
        moved = step(giver)
        if moved:
            if bins[giver]:
                heapq.heappush(order, (fill[giver], giver))
            else:
                count -= 1
            for b in idle:
                heapq.heappush(order, (fill[b], b))
            idle.clear()
        else:
            idle.add(giver)
    return [b for b in bins if b]


def first_deal(lengths: list[int], size: int) -> list[list[int]]:
    """Best fit in the given order, the pieces first that are longer than half a sequence: no two of them fit together."""
    order = sorted(range(len(lengths)), key=lambda i: 2 * lengths[i] <= size)
    return [[order[k] for k in b] for b in best_fit([lengths[i] for i in order], size)]


def longest_first(lengths: list[int], size: int) -> list[list[int]]:
    """Best fit of the pieces by length, the longest first."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    return [[order[k] for k in b] for b in best_fit([lengths[i] for i in order], size)]


def pack_lengths(lengths: list[int], size: int) -> list[list[int]]:
    """The search from one start, and from the next one where that leaves more sequences than the tokens need."""
    best = local_search(first_deal(lengths, size), lengths, size)
    if len(best) > -(-sum(lengths) // size):
        best = min(best, local_search(longest_first(lengths, size), lengths, size), key=len)
    return best


def pack_documents(docs: DataFrame, path: str, json_path: str, pattern: str, size: int = 2048, end: int = 0, group: int = 16384) -> DataFrame:
    """PIECE and sequence_id, offset. Every piece has a place; sequences have no gaps."""
    pieces = written(cut(docs, path, json_path, pattern, size, end))
    n = pieces.filter(F.col("length") < size).count()
    groups = max(1, -(-n // group))
    full = pieces.filter(F.col("length") == size).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # By the row's number in the written table, so that equal rows are dealt too.
    dealt = pieces.filter(F.col("length") < size).withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
        lengths = pdf["length"].tolist()
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for k, b in enumerate(pack_lengths(lengths, size)):
            at = 0
            for i in b:
                sequence[i], offset[i] = k, at
                at += lengths[i]
        # A group's numbers lie apart from any other's: a group has far fewer than 2^31 sequences.
        pdf["sequence_id"], pdf["offset"] = int(pdf["_group"].iloc[0]) * (1 << 31) + sequence, offset
        return pdf.drop(columns="_group").astype({"doc_id": "Int64"})

    return full.unionByName(dealt.groupBy("_group").applyInPandas(pack, PIECE + ", sequence_id long, offset long"))
