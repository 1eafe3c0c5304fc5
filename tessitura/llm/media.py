"""Media columns: 8-bit images as PNG in binary columns, read back with checksum tests, and cosine-transform hashes.

Writing: filtered scan lines, zlib, chunks with their CRC. Reading: every chunk's CRC is tested, scan lines are
unfiltered with numpy (the two filters that follow the left neighbour go pixel by pixel). The hash takes the image
averaged to 32 x 32, its two-way cosine transform, and the signs of the 8 x 8 low frequencies against their median.
Defined results: a null text counts as empty and gives an image of padding; damaged bytes raise ValueError; repeated
rows give a row each; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, in_slices, utf8

#: Fixed value: the first bytes of every PNG.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(image: np.ndarray, level: int = 6) -> bytes:
    """image: uint8, height x width grey or height x width x channels. Each line takes the filter (none, left, above)
    whose bytes lie nearest to zero."""
    h, w = image.shape[:2]
    c = image.shape[2] if image.ndim == 3 else 1
    x = image.reshape(h, w * c)
    left, above = x.copy(), x.copy()
    left[:, c:] -= x[:, :-c]
    above[1:] -= x[:-1]
    tried = np.stack([x, left, above])
    best = np.minimum(tried, 0 - tried).sum(axis=2, dtype=np.int64).argmin(axis=0)
    lines = np.concatenate([best.astype(np.uint8)[:, None], tried[best, np.arange(h)]], axis=1)
    colour = {v: k for k, v in CHANNELS.items()}[c]
    head = struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray, c: int) -> np.ndarray:
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    above = np.zeros(out.shape[1], np.uint8)
    for kind, row in zip(kinds.tolist(), out, strict=True):
        if kind == 1:
            row[:] = np.add.accumulate(row.reshape(-1, c), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            for i in range(len(row)):
                a, b = (int(row[i - c]) if i >= c else 0), int(above[i])
                if kind == 3:
                    near = (a + b) // 2
                else:
                    d = int(above[i - c]) if i >= c else 0
                    p = a + b - d
                    near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                row[i] = (int(row[i]) + near) & 255
        elif kind:
            raise ValueError(f"PNG: no filter {kind}")
        above = row
    return out


def decode_png(data: bytes) -> np.ndarray:
    if data[:8] != SIGNATURE:
        raise ValueError("PNG: wrong signature")
    at, body, head, ended = 8, [], None, False
    while at < len(data) and not ended:
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + part):
            raise ValueError(f"PNG: checksum of {kind!r} fails")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        ended, at = kind == b"IEND", at + 12 + size
    if head is None or not ended:
        raise ValueError("PNG: header or end is missing")
    w, h, depth, colour, *_, interlaced = head
    if depth != 8 or colour not in CHANNELS or interlaced:
        raise ValueError("PNG: only 8-bit images that aren't interlaced")
    c = CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(raw) != h * (w * c + 1):
        raise ValueError("PNG: wrong number of samples")
    out = _unfilter(raw.reshape(h, w * c + 1), c)
    return out if c == 1 else out.reshape(h, w, c)


def _averaged(x: np.ndarray, side: int) -> np.ndarray:
    """Means of `side` equal stretches of lines: differences of the running sum, taken at the stretches' edges."""
    n = len(x)
    total = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
    edges = np.arange(side + 1) * n / side
    low = np.minimum(edges.astype(np.int64), n - 1)
    at = total[low] + (edges - low)[:, None] * x[low]
    return np.diff(at, axis=0) * (side / n)


@functools.lru_cache(4)
def _cosines(low: int, side: int) -> np.ndarray:
    return np.cos(np.pi * np.arange(low)[:, None] * (2 * np.arange(side) + 1) / (2 * side))


def cosine_hash(image: np.ndarray, low: int = 8, side: int = 32) -> bytes:
    """low * low bits as bytes."""
    grey = image if image.ndim == 2 else image[..., :3].mean(axis=2)
    small = _averaged(_averaged(grey.astype(np.float64), side).T, side).T
    freq = np.round(_cosines(low, side) @ small @ _cosines(low, side).T, 6).ravel()
    return np.packbits(freq > np.median(freq[1:])).tobytes()


def text_image(text: str, width: int = 576, pad: int = 255) -> np.ndarray:
    """The UTF-8 bytes of a text, padded to a positive multiple of the width, as a grey image."""
    b = utf8(text)
    n = max(1, -(-len(b) // width)) * width
    out = np.full(n, pad, np.uint8)
    out[: len(b)] = np.frombuffer(b, np.uint8)
    return out.reshape(-1, width)


def store_texts(docs: DataFrame, width: int = 576, level: int = 6) -> DataFrame:
    """doc_id, n_bytes, media: each text as a PNG in a binary column."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_slices(batches):
            media = [encode_png(text_image(t, width), level) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(utf8(t)) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return id_and_text(docs).mapInArrow(store, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads the column media back: its samples' length and digests, its own, and the hash as binary."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b["media"].to_pylist():
                image = decode_png(data)
                payload = image.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(image)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["n_bytes"], *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "hash"],
            )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary"
    )
