"""Byte-level BPE: encoding of whole texts by overlapping chunks, decoding, and counting of tokens.

Ranks come from a vocabulary file whose path is a parameter; no tokenizer is trained. Every text goes one way: it is cut into
chunks of 1,024 characters that overlap, each chunk is pre-tokenised by itself, the chunks are stitched at places where the
pre-token boundaries of both sides agree (what follows such a place depends on the text behind it only), and then the
stitched pieces are encoded, one pre-token after the other. Where an overlap has no such place, the left chunk's last
sure boundary is kept and the text behind it is pre-tokenised again. Tasks take these steps for the texts that they
read; of a text of more than `deal` characters the chunks, and then the pieces, are dealt over the tasks, and the same functions work on them.
Decoding joins the bytes that the ids stand for.
Defined results: a null text counts as empty and gives no ids; repeated rows give a row each; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, in_slices, utf8

ENCODED = "doc_id long, ids binary, n_tokens long"


@functools.lru_cache(4)
def encoding(path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


@functools.lru_cache(4)
def cutter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


class Bounded(dict):
    """What a worker has worked out already, by pre-token: `first` stays, the rest goes when there is too much of it."""

    def __init__(self, make, first=(), most: int = 200_000):
        super().__init__(first)
        self.make, self.first, self.most = make, dict(first), most

    def __missing__(self, piece: str):
        if len(self) > self.most:
            self.clear()
            self.update(self.first)
        out = self[piece] = self.make(piece)
        return out


@functools.lru_cache(4)
def known_ids(path: str, pattern: str) -> Bounded:
    """The ids of a pre-token as bytes. One for a worker: it outlives tasks."""
    enc = encoding(path, pattern)
    return Bounded(lambda p: id_bytes(enc.encode_ordinary(p)))


def id_bytes(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def boundaries(text: str, pattern: str) -> list[int]:
    """Ends of the pre-tokens. The pattern matches every character."""
    return list(accumulate(map(len, cutter(pattern).findall(text))))


def chunks(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """(start, text) of chunks of `chunk` characters, each followed by `overlap` more."""
    return [(at, text[at : at + chunk + overlap]) for at in range(0, max(len(text), 1), chunk)]


def stitch(parts: Iterable[tuple[int, str, list[int]]], pattern: str) -> list[tuple[str, list[int]]]:
    return list(stitched(parts, pattern))


def stitched(parts: Iterable[tuple[int, str, list[int]]], pattern: str) -> Iterator[tuple[str, list[int]]]:
    """A text's chunks (start, text, ends of its pre-tokens), in order of start, as pieces (text, ends) that make up
    the whole text and its pre-tokens. Two neighbours are held at a time.

    A chunk's pre-tokens are right from the place where it took over, up to its last two, which its cut may have changed."""
    parts = iter(parts)
    start, text, ends = next(parts)
    done = start  # everything before it has been given out

    def piece(high: int) -> tuple[str, list[int]]:
        low = done - start
        own = ends[bisect_right(ends, low) : bisect_right(ends, high - start)]
        return text[low : high - start], [e - low for e in own] if low else own

    for start2, text2, ends2 in parts:
        sure = [e + start for e in ends[bisect_left(ends, max(done, start2) - start) : -2]]
        other = {start2, *(e + start2 for e in ends2[: bisect_right(ends2, sure[-1] - start2)])} if sure else ()
        p = next((e for e in sure if e in other), None)
        if p is not None:
            if p > done:
                yield piece(p)
            start, text, ends, done = start2, text2, ends2, p
        else:  # no place in common: pre-tokenise the text of both from the last sure place
            k = bisect_left(ends, done - start)
            p = ends[-3] + start if len(ends) - 2 > k else done
            if p > done:
                yield piece(p)
            text = text[p - start :] + text2[start + len(text) - start2 :]
            start, ends, done = p, boundaries(text, pattern), p
    if len(text) > done - start:
        yield piece(start + len(text))


def encode_piece(text: str, ends: list[int], known: Bounded) -> bytes:
    """The ids of a piece, 4 bytes each."""
    return b"".join(map(known.__getitem__, [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]))


def encode_documents(docs: DataFrame, path: str, pattern: str, chunk: int = 896, overlap: int = 128, deal: int = 1 << 20) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, as binary), n_tokens: every text encoded without special tokens."""
    rows = id_and_text(docs)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_ids(path, pattern)
        for docs_, texts in in_slices(batches):
            got = []
            for text in texts:
                parts = ((at, t, boundaries(t, pattern)) for at, t in chunks(text, chunk, overlap))
                got.append(b"".join(encode_piece(t, ends, known) for t, ends in stitched(parts, pattern)))
            yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(got, pa.binary()), pa.array([len(x) // 4 for x in got], pa.int64())], ["doc_id", "ids", "n_tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, doc, text in zip(b["key"].to_pylist(), b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                got = chunks(text, chunk, overlap)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(got), pa.int64()), pa.array([doc] * len(got), pa.int64()), pa.array([a for a, _ in got], pa.int64()), pa.array([t for _, t in got], pa.string())], ["key", "doc_id", "start", "text"]
                )

    def pre_tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = [np.array(boundaries(t, pattern), np.int32).tobytes() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends, pa.binary())], ["key", "doc_id", "start", "text", "ends"])

    def join_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        parts = [(int(s), t, np.frombuffer(e, np.int32).tolist()) for s, t, e in zip(pdf["start"], pdf["text"], pdf["ends"], strict=True)]
        got = stitch(parts, pattern)
        return pd.DataFrame({"key": pdf["key"].iloc[0], "doc_id": pdf["doc_id"].iloc[0], "start": range(len(got)), "text": [t for t, _ in got], "ends": [np.array(e, np.int32).tobytes() for _, e in got]}).astype({"doc_id": "Int64"})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_ids(path, pattern)
        for b in batches:
            ids = [encode_piece(t, np.frombuffer(e, np.int32).tolist(), known) for t, e in zip(b["text"].to_pylist(), b["ends"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["key"], b["doc_id"], b["start"], pa.array(ids, pa.binary())], ["key", "doc_id", "start", "ids"])

    def join_ids(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = b"".join(pdf.sort_values("start")["ids"])
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1].astype("Int64"), "ids": [ids], "n_tokens": [len(ids) // 4]})

    short = rows.filter(F.length("text") <= deal).mapInArrow(whole, ENCODED)
    # A key of its own for each long row: repeated rows and null ids then stay apart.
    long = rows.filter(F.length("text") > deal).withColumn("key", F.monotonically_increasing_id())
    piece = "key long, doc_id long, start long, text string, ends binary"
    dealt = long.mapInArrow(cut, "key long, doc_id long, start long, text string").repartition(F.col("key"), F.col("start"))
    pieces = dealt.mapInArrow(pre_tokenise, piece).groupBy("key").applyInPandas(join_chunks, piece).repartition(F.col("key"), F.col("start"))
    done = pieces.mapInArrow(encode, "key long, doc_id long, start long, ids binary")
    return short.unionByName(done.groupBy("key").applyInPandas(join_ids, ENCODED))


def with_digests(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ids_sha256, and decoded_sha256 of the bytes that the ids stand for."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for b in batches:
            raw = b["ids"].to_pylist()
            both = [(hashlib.sha256(x).hexdigest(), hashlib.sha256(enc.decode_bytes(np.frombuffer(x, "<u4").tolist())).hexdigest()) for x in raw]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_tokens"], pa.array([x for x, _ in both], pa.string()), pa.array([y for _, y in both], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(decode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def added_tokens(json_path: str) -> tuple[tuple[str, int], ...]:
    """(text, id) of the tokens that a tokenizer file adds to its vocabulary: inside texts they are one token each."""
    with open(json_path, encoding="utf-8") as f:
        return tuple((t["content"], t["id"]) for t in json.load(f)["added_tokens"])


def pieces_and_added(text: str, added: tuple[tuple[str, int], ...]) -> tuple[list[str], int]:
    """The text between added tokens, and how many of these it holds."""
    parts = [text]
    for token, _ in added:
        if token in text:
            parts = [x for p in parts for x in p.split(token)]
    return parts, len(parts) - 1


def frequent_lengths(docs: DataFrame, path: str, pattern: str, sample: int = 4096, parts: int = 8, size: int = 16384) -> tuple[bytes, bytes]:
    """The first tier: the `size` most frequent pre-tokens of about `sample` documents (a fixed bound), as a JSON list, and their token counts. It only decides which lengths are at hand at
    once: a pre-token that it lacks is encoded, so that counts never depend on it. No pre-token is shuffled: the sampled
    texts are dealt over `parts` tasks, each of which returns its own `size` most frequent."""
    rows = id_and_text(docs)
    n = max(docs.count(), 1)
    chosen = rows if n <= sample else rows.sample(sample / n, seed=1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        find = cutter(pattern).findall
        for b in batches:
            for text in b["text"].to_pylist():
                seen.update(find(text))
                if len(seen) > 400_000:  # a task's memory stays bounded: rare ones go
                    seen = Counter(dict(seen.most_common(50_000)))
        top = seen.most_common(size)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    total: Counter[str] = Counter()
    for r in chosen.select("text").repartition(parts).mapInArrow(count, "piece string, n long").collect():
        total[r["piece"]] += r["n"]
    enc = encoding(path, pattern)
    top = sorted(total, key=lambda p: (-total[p], p))[:size]
    return json.dumps(top, ensure_ascii=False).encode(), np.array([len(enc.encode_ordinary(p)) for p in top], np.uint32).tobytes()


@functools.lru_cache(2)
def known_lengths(path: str, pattern: str, pieces: bytes, lengths: bytes) -> Bounded:
    """One for a worker: the table's lengths, and those of the other pre-tokens that it has met."""
    enc = encoding(path, pattern)
    return Bounded(lambda p: len(enc.encode_ordinary(p)), zip(json.loads(pieces), np.frombuffer(lengths, np.uint32).tolist(), strict=True))


def count_tokens(docs: DataFrame, path: str, json_path: str, pattern: str, limit: int = 1024, sample: int = 4096, size: int = 16384) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: lengths of pre-tokens come from the broadcast table, then from the
    worker's cache of the others, and are added up per text. Tokens that the json file adds count as one each."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, pattern, sample, size=size))
    added = added_tokens(json_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, find = known_lengths(path, pattern, *table.value).__getitem__, cutter(pattern).findall
        for ids, texts in in_slices(batches):
            sizes = []
            for t in texts:
                parts, n = pieces_and_added(t, added)
                sizes.append(n + sum(sum(map(length, find(p))) for p in parts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(utf8(t)) for t in texts], pa.int64()), pa.array(sizes, pa.int64()), pa.array([n > limit for n in sizes])], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return id_and_text(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
