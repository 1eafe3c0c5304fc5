"""Substring dedup: words covered by a window of `size` words whose sequence also starts earlier are removed.

Super-k-mer partitioning: each window has a minimiser, the least hash among its runs of `mini` words; consecutive
windows with the same minimiser travel as one packed string to the bucket of that minimiser. Equal windows have equal
minimisers, so they meet in one bucket, where the windows of minimisers that came more than once are sorted with their places.
All but the first place of a sequence are removed; equal hashes are compared word by word. A task packs what it sends to a bucket
into one compressed value; a super-k-mer that equals an earlier one of the same slice is decided there: its range is
sent to a bucket that depends on the slice alone, so that the copies of one passage, however many, are spread over all buckets, and only
one text a slice goes to the passage's own. A minimiser that many
different super-k-mers have is found by a count before: its windows are dealt by a second minimiser too, so that they
spread over the buckets, and equal windows still meet.
Earlier means: smaller doc_id, or the same document and an earlier start. The number of buckets follows the bytes of the
input (`per_bucket` each), and so does the number of tasks that compare them.
Defined results: null and empty texts and texts shorter than a window keep all words; every row is a document of its own, also
where doc_ids are null (these come first) or repeated (then in the order of a hash of their texts), but rows of one doc_id
and text count as one and get equal results; an empty table gives no rows; extra columns are not read, but for those in `carry`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashes_of, id_and_text, in_slices, mixed, numbered, packed, unpacked, window_hashes, words_of, written

#: Super-k-mers: key, document, place, number of windows, length of the text; the texts; ranges to remove: document, from, to.
KINDS = (np.uint64, np.int64, np.int64, np.int32, np.int32, None, np.int64, np.int64, np.int64)


def _ends(words: list[bytes]) -> np.ndarray:
    """Where each word ends when they are joined by one space."""
    return np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1


def _least(v: np.ndarray, reach: int) -> np.ndarray:
    """For each place but the last ones: the place of the leftmost least value among the next `reach`."""
    at, wide = np.arange(len(v)), 1
    while wide < reach:  # among the next 1, 2, 4 ...
        step = min(wide, reach - wide)
        a, b = at[: len(at) - step], at[step:]
        at, wide = np.where(v[b] < v[a], b, a), wide + step
    return at


def super_kmers(h: np.ndarray, last: np.ndarray, size: int, mini: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and key of each super-k-mer. h: the words' hashes, text after text; last: for each
    word, where its text ends. The key is the minimiser; windows of a hot one (hot: sorted) also have to share a second
    minimiser, by another order of the same runs, and their key is made of both."""
    mm = window_hashes(h, mini)
    n = len(h) - size + 1
    starts = np.flatnonzero(np.arange(max(n, 0)) + size <= last[: max(n, 0)])
    if not len(starts):
        return starts, starts, np.empty(0, np.uint64)
    place = _least(mm, size - mini + 1)[starts]
    key = mm[place]
    fresh = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    if hot is not None and len(hot):
        many = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
        if many.any():
            other = mixed(mm, 1)
            second = _least(other, size - mini + 1)[starts]
            fresh |= many[1:] & (second[1:] != second[:-1])
            key = np.where(many, mixed(key, other[second]), key)
    fresh = np.flatnonzero(np.append(True, fresh))
    return starts[fresh], np.diff(np.append(fresh, len(starts))), key[fresh]


def _words_in_order(ids: list, texts: list[str], size: int) -> tuple[list[bytes], np.ndarray, list]:
    """The words of the texts that hold a window, in the order of their ids; how many each has; its id."""
    words, sizes, of = [], [], []
    for k in sorted(range(len(ids)), key=ids.__getitem__):
        w = words_of(texts[k])
        if len(w) >= size:
            words += w
            sizes.append(len(w))
            of.append(ids[k])
    return words, np.array(sizes, np.int64), of


def hot_minimisers(docs: DataFrame, size: int, mini: int, limit: int, least: int = 4096, most: int = 1 << 16) -> np.ndarray:
    """Minimisers of more than `least` different super-k-mers, and of more than one in `most` of all: so there are `most` at most,
    whatever the input. A slice counts its own and leaves out those with less than four."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_slices(batches, limit):
            words, sizes, _ = _words_in_order(ids, texts, size)
            if not words:
                continue
            h = hashes_of(words)
            del words
            start, n, mm = super_kmers(h, np.repeat(np.cumsum(sizes), sizes), size, mini)
            own = mixed(window_hashes(h, size)[start], n.astype(np.uint64))
            order = np.lexsort((own, mm))
            mm, own = mm[order], own[order]
            mm = mm[np.append(True, (mm[1:] != mm[:-1]) | (own[1:] != own[:-1]))]
            first = np.flatnonzero(np.append(True, mm[1:] != mm[:-1]))
            many = np.diff(np.append(first, len(mm)))
            some = many >= 4
            yield pa.RecordBatch.from_arrays([pa.array([None, *mm[first[some]].view(np.int64).tolist()], pa.int64()), pa.array([len(mm), *many[some].tolist()], pa.int64())], ["key", "n"])

    counts = written(id_and_text(docs).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    total = counts.filter("key IS NULL").select("n").first()
    bound = max(least, (total[0] if total else 0) // most)
    return np.sort(np.array([r["key"] for r in counts.filter(F.col("key").isNotNull() & (F.col("n") > bound)).select("key").collect()], np.int64).view(np.uint64))


def _dealt(docs: DataFrame, size: int, mini: int, buckets: int, limit: int, hot: np.ndarray) -> DataFrame:
    """bucket, payload: what one slice of documents sends to one bucket."""
    known = docs.sparkSession.sparkContext.broadcast(hot)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for ids, texts in in_slices(batches, limit):
            words, count, of = _words_in_order(ids, texts, size)
            if not words:
                continue
            last = np.repeat(np.cumsum(count), count)
            first = np.repeat(np.cumsum(count) - count, count)
            doc = np.repeat(np.array(of, np.int64), count)
            start, n, mm = super_kmers(hashes_of(words), last, size, mini, known.value)
            end = _ends(words)
            text = b" ".join(words)
            del words
            low, high = np.append(0, end[:-1] + 1)[start].tolist(), end[start + n + size - 2].tolist()
            parts = [text[a:b] for a, b in zip(low, high, strict=True)]
            seen: dict[bytes, int] = {}
            earliest = np.fromiter((seen.setdefault(p, k) for k, p in enumerate(parts)), np.int64, len(parts))
            del seen
            to = (mm % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order], prepend=-1)).tolist()
            place, of_doc = start - first[start], doc[start]
            new = earliest == np.arange(len(parts))
            copy = (of_doc != of_doc[earliest]) | (place != place[earliest])
            out_to, out, ranges = [], [], (of_doc[:0], place[:0], place[:0])
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                mine = order[a:b]
                fresh = mine[new[mine]]
                if not len(fresh):
                    continue
                own = [parts[k] for k in fresh.tolist()]
                lengths = np.fromiter(map(len, own), np.int32, len(own))
                out_to.append(int(to[mine[0]]))
                out.append(packed(mm[fresh], of_doc[fresh], place[fresh], n[fresh].astype(np.int32), lengths, b"".join(own), *(x[:0] for x in ranges)))
            gone = np.flatnonzero(copy)
            if len(gone):
                ranges = _merged(of_doc[gone], place[gone], place[gone] + n[gone] + size - 1)
                out_to.append(int(mixed(of_doc[:1].view(np.uint64), part)[0] % np.uint64(buckets)))
                out.append(packed(mm[:0], of_doc[:0], place[:0], np.empty(0, np.int32), np.empty(0, np.int32), b"", *ranges))
            yield pa.RecordBatch.from_arrays([pa.array(out_to, pa.int32()), pa.array(out, pa.binary())], ["bucket", "payload"])

    return id_and_text(docs).mapInArrow(deal, "bucket int, payload binary")


def repeated_windows(doc: np.ndarray, place: np.ndarray, parts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the windows in these super-k-mers whose sequence starts earlier in another."""
    words = [p.split() for p in parts]
    count = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    del words
    h, end = window_hashes(hashes_of(flat), size), _ends(flat)
    text = b" ".join(flat)
    del flat
    row = np.repeat(np.arange(len(parts)), count)
    first = np.cumsum(count) - count
    at = np.flatnonzero(np.arange(len(h)) + size <= (first + count)[row[: len(h)]])
    d, s, key = doc[row[at]], place[row[at]] + at - first[row[at]], h[at]
    order = np.lexsort((s, d, key))
    at, d, s, key = at[order], d[order], s[order], key[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    heads = np.repeat(head, np.diff(np.append(head, len(key))))
    later = (d != d[heads]) | (s != s[heads])
    low = np.append(0, end[:-1] + 1)
    window = lambda k: text[low[at[k]] : end[at[k] + size - 1]]
    wrong = {int(heads[k]) for k in np.flatnonzero(later).tolist() if window(k) != window(int(heads[k]))}
    for start in wrong:  # two sequences with one hash: told apart by their words
        own: dict[bytes, tuple] = {}
        for k in range(start, start + int((heads == start).sum())):
            later[k] = own.setdefault(window(k), (d[k], s[k])) != (d[k], s[k])
    return d[later], s[later]


def _merged(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching ranges of words of one document as one."""
    order = np.lexsort((low, doc))
    doc, low, high = doc[order], low[order], high[order]
    if not len(doc):
        return doc, low, high
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    # The greatest end so far within the document: documents are lifted apart so that one running maximum does.
    lift = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(doc)))) * (int(high.max()) + 2)
    far = np.maximum.accumulate(high + lift)
    fresh = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (low[1:] + lift[1:] > far[:-1])))
    ends = np.append(fresh[1:], len(doc)) - 1
    return doc[fresh], low[fresh], (far - lift)[ends]


def repeated_ranges(docs: DataFrame, size: int = 20, mini: int = 5, limit: int = 8 << 20, per_bucket: int = 16 << 20, least: int = 4096) -> DataFrame:
    """key (a doc_id, unique and not null), low, high: ranges of words to remove, high excluded."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // per_bucket))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        cols = list(zip(*(unpacked(x, *KINDS) for x in pdf["payload"]), strict=True))
        mm, doc, place, n, lengths = (np.concatenate(c) for c in cols[:5])
        cuts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        # Where each payload's text begins among all of them.
        bases = np.repeat(np.arange(len(cols[5])), [len(x) for x in cols[4]])
        begins = np.cumsum([0, *map(len, cols[5])])
        order = np.argsort(mm, kind="stable")
        fresh = np.flatnonzero(np.append(True, mm[order][1:] != mm[order][:-1])) if len(mm) else np.empty(0, np.int64)
        sizes = np.diff(np.append(fresh, len(mm)))
        many = order[np.repeat(sizes > 1, sizes)]
        found = [tuple(np.concatenate(c) for c in cols[6:])]
        # Some minimisers at a time, so that what is unpacked at once stays small.
        at = 0
        while at < len(many):
            end = min(at + 20_000, len(many))
            while end < len(many) and mm[many[end]] == mm[many[end - 1]]:
                end += 1
            some = many[at:end]
            parts = [cols[5][p][a - g : b - g] for p, a, b, g in zip(bases[some].tolist(), cuts[some].tolist(), cuts[some + 1].tolist(), begins[bases[some]].tolist(), strict=True)]
            d, s = repeated_windows(doc[some], place[some], parts, size)
            found.append((d, s, s + size))
            at = end
        d, low, high = _merged(*(np.concatenate(x) for x in zip(*found, strict=True)))
        return pd.DataFrame({"key": d, "low": low, "high": high})

    hot = hot_minimisers(docs, size, mini, limit // 4, least)  # smaller slices: nothing is packed here
    return _dealt(docs, size, mini, buckets, limit, hot).repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInPandas(compare, "key long, low long, high long")


def remove_repeats(docs: DataFrame, size: int = 20, mini: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), kept_text (the text itself where
    nothing goes), and the columns in `carry`, which go with their rows so that no join has to bring them back."""
    own = numbered(docs, *(c for c in carry if c != "doc_id"), equal_as_one=True)
    ranges = repeated_ranges(own.select(F.col("row").alias("doc_id"), "text"), size, mini).groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    rows = own.select(F.col("row").alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("carried"))
    both = rows.join(ranges, "key", "left").select("doc_id", "text", F.col("ranges.low").alias("low"), F.col("ranges.high").alias("high"), "carried")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, low, high in zip(*(b[c].to_pylist() for c in ("doc_id", "text", "low", "high")), strict=True):
                words = words_of(text)
                n, gone = len(words), 0
                if low:
                    keep = np.ones(n, bool)
                    for a, z in zip(low, high, strict=True):
                        keep[a:z] = False
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                    gone = n - len(words)
                joined = b" ".join(words)
                out.append((doc, n, gone, hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "replace") if gone else text))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)), b["carried"]], [*(x.split()[0] for x in schema.split(", ")), "carried"])

    done = both.mapInArrow(cut, f"{schema}, carried {both.schema['carried'].dataType.simpleString()}")
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", *(F.col(f"carried.{c}").alias(c) for c in carry))
