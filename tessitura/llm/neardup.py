"""MinHash near-dedup with b-bit signatures.

A document's set holds the hashes of its distinct word shingles (with fewer words, of the whole sequence). Documents
with equal sets form a class, which goes on as one. Each class has `bands * rows` minima; each band of minima is a
bucket key, and the low `bits` bits of all minima are packed into longs. Links are found in two rounds:

1. In each bucket every class is compared with the one of smallest id, by the collision-corrected estimate of bit counts,
   and above a margin below the threshold on the full sets. Links give components.
2. Buckets whose classes still lie in different components are finished: each class outside the bucket's most
   frequent component is compared with every class of another component, first by sizes and bit counts alone; only classes
   with a near one among these get their full sets for the exact comparison. Such buckets are cut into blocks, so that a
   task's work and memory are bounded. A bucket is done when it lies in one component or all its pairs between components
   were compared.

A pair at the threshold shares no bucket with a probability of (1 - s^rows)^bands: under 1 in 100,000 at
0.85 with 16 bands and at 0.8 with 24. bits: 2, 4 or 8; bands * rows * bits is a multiple of 64.
Defined results: a null text counts as empty; documents without words have an empty set and link with nothing; doc_id
should be unique, repeated equal rows get equal results; rows with a null doc_id are sketched but never linked (their
component_id is null, kept true); an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gaps, hashes_of, id_and_text, in_slices, mixed, packed, unpacked, window_hashes, words_of, written

SKETCH = "doc_id long, n_shingles long, print binary, bands array<long>, sig array<long>"


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes for each text, lower-cased A-Z."""
    words = [words_of(t, lower=True) for t in texts]
    counts = [len(w) for w in words]
    h = hashes_of([w for ws in words for w in ws])
    del words
    runs = window_hashes(h, size)
    out, at = [], 0
    for n in counts:
        if n >= size:
            out.append(np.unique(runs[at : at + n - size + 1]))
        elif n:
            whole = h[at : at + 1]
            for k in range(1, n):
                whole = mixed(whole, h[at + k : at + k + 1])
            out.append(mixed(whole, n))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def minima(sets: list[np.ndarray], k: int) -> np.ndarray:
    """k minima for each set, none of which is empty."""
    rng = np.random.default_rng(20240607)
    xor = rng.integers(0, 1 << 63, k, dtype=np.uint64)
    mul = rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[:-1]])]).astype(np.int64)
    out = np.empty((len(sets), k), np.uint64)
    for j in range(k):
        v = (flat ^ xor[j]) * mul[j]
        v ^= v >> np.uint64(32)
        out[:, j] = np.minimum.reduceat(v, starts)
    return out


def band_keys(m: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(m), bands), np.uint64)
    for b in range(bands):
        x = mixed(m[:, b * rows], b)
        for j in range(1, rows):
            x = mixed(x, m[:, b * rows + j])
        out[:, b] = x
    return out


def signatures(m: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of the minima, 64 / bits of them in a long."""
    per = 64 // bits
    low = m & np.uint64((1 << bits) - 1)
    shifts = (np.arange(per) * bits).astype(np.uint64)
    return np.bitwise_or.reduce(low.reshape(len(m), -1, per) << shifts, axis=2)


def estimate(a: Column, b: Column, longs: int, bits: int) -> Column:
    """Similarity from two packed signatures: equal minima counted by bits, less those that are equal by chance."""
    ones = int("1".rjust(bits, "0") * (64 // bits), 2)
    unequal = F.lit(0)
    for k in range(longs):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        folded = x
        for s in range(1, bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, s))
        unequal = unequal + F.bit_count(folded.bitwiseAND(F.lit(ones)))
    share = 1.0 - unequal / F.lit(longs * (64 // bits))
    return (share - F.lit(2.0**-bits)) / F.lit(1 - 2.0**-bits)


def sketches(docs: DataFrame, shingle: int, bands: int, rows: int, bits: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_slices(batches):
            sets = shingle_sets(texts, shingle)
            full = [k for k, s in enumerate(sets) if len(s)]
            prints: list = [None] * len(ids)
            keys: list = [None] * len(ids)
            sigs: list = [None] * len(ids)
            if full:
                m = minima([sets[k] for k in full], bands * rows)
                for k, b, s in zip(full, band_keys(m, bands, rows).view(np.int64), signatures(m, bits).view(np.int64), strict=True):
                    prints[k], keys[k], sigs[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest(), b, s
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "print", "bands", "sig"],
            )

    return id_and_text(docs).mapInArrow(sketch, SKETCH)


def links_in_group(ids: np.ndarray, labels: np.ndarray, asks: np.ndarray, sets: list[np.ndarray], part: int, whole: int) -> list[tuple[int, int]]:
    """Links between those that ask and the others under another label: part * union <= whole * intersection. A link
    joins its labels, so that of the links between two components one is found at least."""
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    label = np.unique(labels, return_inverse=True)[1]
    out = []
    has = np.zeros(len(values), bool)
    for k in np.flatnonzero(asks).tolist():
        other = np.flatnonzero((label != label[k]) & (whole * np.minimum(sizes, sizes[k]) >= part * np.maximum(sizes, sizes[k])))
        if not len(other):
            continue
        own = flat[starts[k] : starts[k] + sizes[k]]
        has[own] = True
        common = np.add.reduceat(has[flat].astype(np.int32), starts)[other]
        has[own] = False
        for j in other[whole * common >= part * (sizes[other] + sizes[k] - common)].tolist():
            if label[j] != label[k]:
                out.append((int(ids[k]), int(ids[j])))
                label[label == label[j]] = label[k]
    return out


def estimated(own: np.ndarray, others: np.ndarray, bits: int) -> np.ndarray:
    """estimate() of one packed signature with many."""
    ones = np.uint64(int("1".rjust(bits, "0") * (64 // bits), 2))
    x = own ^ others
    folded = x
    for s in range(1, bits):
        folded = folded | (x >> np.uint64(s))
    share = 1 - np.bitwise_count(folded & ones).sum(axis=1, dtype=np.int64) / (others.shape[1] * (64 // bits))
    return (share - 2.0**-bits) / (1 - 2.0**-bits)


def _near(groups: DataFrame, part: int, whole: int, bits: int, margin: float) -> DataFrame:
    """groups: g, id, label, asks, n, sig. Of these the rows that have a near one under another label: near by size and bit
    counts. Rows that don't ask stay for those that do."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["asks", "id"], ascending=[False, True]).drop_duplicates("id", ignore_index=True)
        sig = np.stack(pdf["sig"].to_numpy()).astype(np.int64).view(np.uint64)
        n, label, keep = pdf["n"].to_numpy(), pdf["label"].to_numpy(), np.zeros(len(pdf), bool)
        for k in np.flatnonzero(pdf["asks"].to_numpy()).tolist():
            other = np.flatnonzero((label != label[k]) & (whole * np.minimum(n, n[k]) >= part * np.maximum(n, n[k])))
            other = other[estimated(sig[k], sig[other], bits) >= part / whole - margin] if len(other) else other
            if len(other):
                keep[k] = True
                keep[other] = True
        return pdf.loc[keep, ["g", "id", "label", "asks"]]

    return groups.groupBy("g").applyInPandas(find, "g long, id long, label long, asks boolean")


def _compared(groups: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """groups: g, id, label, asks. Links (a, b) found inside each g."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["asks", "id"], ascending=[False, True]).drop_duplicates("id")
        got = links_in_group(pdf["id"].to_numpy(), pdf["label"].to_numpy(), pdf["asks"].to_numpy(), [np.cumsum(unpacked(x, np.uint64)[0], dtype=np.uint64) for x in pdf["members"]], part, whole)
        return pd.DataFrame(got, columns=["a", "b"], dtype="int64")

    # By sort and merge at every size: what is small in one run is large in the next.
    return groups.join(sets.hint("merge"), "id").groupBy("g").applyInPandas(find, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id, label: the smallest id that each node of the edges (a, b) can reach. Each round takes the least label among the
    neighbours, then the label of that label; rounds grow as the logarithm of the longest path."""
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        least = labels.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("above"))
        nxt = written(least.join(up, "label").select("id", F.least("label", "above").alias("label"), "was"))
        if nxt.filter("label <> was").isEmpty():
            return nxt.select("id", "label")
        labels = nxt.select("id", "label")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, part: int = 80, whole: int = 100, bands: int = 24, rows: int = 4, bits: int = 4, margin: float = 0.25, block: int = 256
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept. Links: whole * intersection >= part * union, on full sets."""
    longs = bands * rows * bits // 64
    all_rows = written(sketches(docs, shingle, bands, rows, bits))
    classes = written(
        all_rows.filter(F.col("print").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("print")
        .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    )
    places = classes.select("id", F.explode("bands").alias("key"))
    # Written, so that the join has an exchange of its own on both sides, of which large keys can be split.
    shared = written(places.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("hub")).filter("size > 1"))
    members = written(places.join(shared, "key"))

    # The sets of all classes that share a bucket: the only ones whose texts are needed again.
    wanted = members.select(F.col("id").alias("doc_id")).distinct()

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([packed(gaps(s)) for s in shingle_sets(texts, shingle)], pa.binary())], ["id", "members"])

    sets = written(id_and_text(docs).join(wanted.hint("merge"), "doc_id").dropDuplicates(["doc_id"]).mapInArrow(to_sets, "id long, members binary"))

    # Round 1: against the smallest id of each bucket.
    sig = classes.select("id", "sig", "n")
    pairs = members.filter("id <> hub").select("hub", "id").distinct()
    close = (
        pairs.join(sig, "id")
        .join(sig.select(F.col("id").alias("hub"), F.col("sig").alias("hub_sig"), F.col("n").alias("hub_n")), "hub")
        .filter((F.least("n", "hub_n") * whole >= F.greatest("n", "hub_n") * part) & (estimate(F.col("sig"), F.col("hub_sig"), longs, bits) >= part / whole - margin))
        .select("hub", "id")
    )
    close = written(close)
    many = written(close.groupBy("hub").agg(F.count("*").alias("of_hub")))
    dealt = close.join(many, "hub").withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("of_hub") / F.lit(block // 2))))
    asked = dealt.select(F.xxhash64("hub", "salt").alias("g"), "id", F.col("id").alias("label"), F.lit(False).alias("asks"))
    asking = dealt.select(F.xxhash64("hub", "salt").alias("g"), F.col("hub").alias("id"), F.col("hub").alias("label"), F.lit(True).alias("asks")).distinct()
    links = written(_compared(asked.unionByName(asking), sets, part, whole))
    labels = components(links)

    # Round 2: what the buckets still hold of several components.
    own = written(members.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label")))
    counts = own.groupBy("key", "label").agg(F.count("*").alias("c"))
    open_keys = written(counts.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("size"), F.max("c").alias("most")).filter("size > most AND size > 2"))
    rest = own.join(open_keys, "key").join(sig, "id").withColumn("asks", F.col("label") != F.col("main"))
    ask_blocks, all_blocks = F.ceil((F.col("size") - F.col("most")) / F.lit(block)), F.ceil(F.col("size") / F.lit(block))
    rest = rest.withColumn("na", ask_blocks.cast("int")).withColumn("nm", all_blocks.cast("int"))
    at = F.xxhash64("id", F.lit(1))
    as_ask = rest.filter("asks").select("key", "id", "label", "asks", "n", "sig", F.pmod(at, "na").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("j"))
    as_member = rest.select("key", "id", "label", F.lit(False).alias("asks"), "n", "sig", F.pmod(at, "nm").alias("j"), F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("i"))
    groups = as_ask.unionByName(as_member).select(F.xxhash64("key", "i", "j").alias("g"), "id", "label", "asks", "n", "sig")
    more = written(_compared(written(_near(groups, part, whole, bits, margin)), sets, part, whole))
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    known = classes.select("print", "id").join(labels, "id", "left").select("print", F.coalesce("label", "id").alias("label"))
    got = all_rows.select("doc_id", "n_shingles", "print").join(known, "print", "left")
    got = got.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")))
    return got.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
