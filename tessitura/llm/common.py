"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pandas.util import hash_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the bytes 9 to 13. bytes.split() without an argument cuts at exactly these.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors share. Without that setting only a session in one
    process (tests, bench) gets a folder, its own; a cluster has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a written table in the shared folder: lost executors don't lose it, and its lineage ends here."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns that are read; further columns of the input, whatever their names, are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def numbered(docs: DataFrame, *more: str, equal_as_one: bool = False) -> DataFrame:
    """row, doc_id, text and the columns in `more`: row is a number that no other row has, in the order of doc_id (nulls first)
    and of a hash of the text. It is doc_id itself where that is unique and never null; else the rows are written with their
    numbers, so that these don't change. equal_as_one: rows of one doc_id and text share a number."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)
    if rows.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        return rows.withColumn("row", F.col("doc_id"))
    order = (F.col("doc_id"), F.xxhash64("text"))
    out = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()))
    if not equal_as_one:
        return out
    first = out.groupBy(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash")).agg(F.min("row").alias("_first"))
    same = out["doc_id"].eqNullSafe(first["_id"]) & (F.xxhash64(out["text"]) == first["_hash"])
    return out.join(first, same).select(*rows.columns, F.col("_first").alias("row"))


def remainder(doc_id, n: int):
    """crc32(doc_id as text) mod n, as a column; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def remainder_of(doc_id: int | None, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def words_of(text: str, lower: bool = False) -> list[bytes]:
    """The words of a text as UTF-8; lower: A-Z only, as bytes.lower() does."""
    b = utf8(text)
    return (b.lower() if lower else b).split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word, the same in every process."""
    return hash_array(np.array(words, dtype=object), categorize=False) if words else np.empty(0, np.uint64)


def mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """One 64-bit hash from two."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (np.asarray(b, dtype=np.uint64) ^ np.uint64(0xD6E8FEB86659FD93))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        return x * np.uint64(0xBF58476D1CE4E5B9)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` consecutive words."""
    if len(h) < size:
        return np.empty(0, np.uint64)
    out = h[: len(h) - size + 1]
    for k in range(1, size):
        out = mixed(out, h[k : len(h) - size + 1 + k])
    return out


def packed(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as one compressed value; unpacked() needs their types. The first bytes of all numbers stand together, then
    the second ones and so on: bytes that are alike compress well there."""
    parts = [x if isinstance(x, bytes) else np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in arrays]
    head = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def unpacked(value: bytes, *types) -> list:
    """The arrays of packed(); a type of None gives bytes."""
    raw = zstandard.ZstdDecompressor().decompress(value)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    at, out = 8 * (n + 1), []
    for kind, size in zip(types, sizes.tolist(), strict=True):
        if kind is None:
            out.append(raw[at : at + size])
        else:
            planes = np.frombuffer(raw, np.uint8, size, at).reshape(np.dtype(kind).itemsize, -1)
            out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size
    return out


def gaps(x: np.ndarray) -> np.ndarray:
    """Differences between sorted numbers, the first from 0: they compress better. np.cumsum() undoes it."""
    return np.diff(x, prepend=x.dtype.type(0))


def in_slices(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[tuple[list, list[str]]]:
    """(doc_ids, texts) of at most about `limit` characters, so that a task's memory doesn't follow Arrow's batches."""
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        at = 0
        while at < len(ids):
            end, size = at, 0
            while end < len(ids) and (size < limit or end == at):
                size += texts[end].as_buffer().size if texts[end].is_valid else 0
                end += 1
            yield ids[at:end], texts.slice(at, end - at).to_pylist()
            at = end
