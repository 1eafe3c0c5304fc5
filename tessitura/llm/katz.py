"""Katz backoff over words: Good-Turing discounted bigram and unigram counts, exactly normalised backoff weights.

Tokens are the words of a text, lower-cased A-Z, then one end; a text's first history is a start. A seen bigram has
d(c) * c / c(history); an unseen one has alpha(history) * P(word); an unseen word has what the discounts of the unigrams
leave, as one event. alpha = (1 - mass of the seen) / (1 - P of the seen), so that each history's probabilities add up to 1.

blocks_of() turns documents into blocks: the distinct words of many texts and the texts as places in that list.
fit() counts the texts that aren't held out and stores a Model: two tables, a row for each bucket of hashes, and the
figures that all texts share. score() needs blocks and a stored model alone: it looks up each block's distinct words
(their id, count and backoff weight), then its distinct bigrams, and evaluates its texts token by token.

Everything moves as packed arrays between blocks and buckets, whatever the size of the vocabulary; nothing of it is
broadcast, and only sums over the tables (counts of counts) reach the driver. The number of buckets follows the input: about
`per_bucket` words or tokens each. A history that occurs more than `hot` times is spread over several buckets by its followers;
their sums for the backoff weight are added up. Words are told apart by 64-bit hashes, bigrams by two word ids.
Defined results: a null or empty text has one token, its end; without training texts every probability is 1 (score
0); a null doc_id counts as an empty id text; repeated rows give a row each; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gaps, hashes_of, id_and_text, in_slices, packed, shared_dir, unpacked, words_of, written

START, END = hashes_of([b"\n<s>", b"\n</s>"])  # no word holds a line feed
#: Counts up to this one are discounted.
K = 5
#: Id of a word that the model doesn't know.
NO_ID = (1 << 32) - 1
ODD = 0x9E3779B1
#: Buckets of a stored table: below the number that Spark allows, and enough for any cluster.
MOST_TASKS = 1 << 15
MESSAGE = "block long, bucket int, payload binary"


def discounts(n: list[int]) -> list[float]:
    """d(1) to d(K) from the counts of counts n(1) to n(K + 1): Good-Turing as Katz has it. Where the counts don't give values
    between 0 and 1: an absolute discount."""
    if all(n) and n[0] > (K + 1) * n[K]:
        common = (K + 1) * n[K] / n[0]
        d = [((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) for r in range(1, K + 1)]
        if all(0 < x < 1 for x in d):
            return d
    off = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return [(r - off) / r for r in range(1, K + 1)]


def discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    return c * np.array([1.0, *d, 1.0])[np.minimum(c, K + 1).astype(np.int64)]


def counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == r).sum()) for r in range(1, K + 2)]


@dataclass
class Scalars:
    """What all texts share: training tokens, distinct ones, training texts, discounts, the unseen words' probability; the
    numbers of buckets, and how often a history must occur to be spread."""

    tokens: int
    types: int
    texts: int
    d1: list[float]
    scale: float
    unseen: float
    word_buckets: int
    pair_buckets: int
    bits: int
    hot: int
    d2: list[float] | None = None

    def word(self, c: np.ndarray) -> np.ndarray:
        """P(word) from its training count."""
        c = np.asarray(c, np.float64)
        if not self.tokens:
            return np.ones(len(c))
        return np.where(c > 0, discounted(c, self.d1) * self.scale / self.tokens, self.unseen)

    def key(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """One number for a bigram of ids, different for different ones: the history's bits dealt anew, then the word's."""
        low = np.uint64((1 << self.bits) - 1)
        return (((h * np.uint64(ODD)) & low) << np.uint64(self.bits)) | w

    def parts_of(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The dealt history and the word of a key."""
        return key >> np.uint64(self.bits), key & np.uint64((1 << self.bits) - 1)

    def history(self, dealt: np.ndarray) -> np.ndarray:
        return (dealt * np.uint64(pow(ODD, -1, 1 << self.bits))) & np.uint64((1 << self.bits) - 1)

    def pair_bucket(self, key: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The bucket of bigrams whose history occurs `count` times."""
        dealt, w = self.parts_of(key)
        bucket = (dealt * np.uint64(self.pair_buckets)) >> np.uint64(self.bits)
        parts = (count // self.hot + 1).astype(np.uint64)
        many = parts > 1
        if many.any():
            salt = ((((w[many] * np.uint64(ODD)) & np.uint64(0xFFFFFFFF)) * np.minimum(parts[many], self.pair_buckets)) >> np.uint64(32)).astype(np.uint64)
            bucket[many] = (bucket[many] + salt) % np.uint64(self.pair_buckets)
        return bucket.astype(np.int64)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """By the upper bits: sorting by hash sorts by bucket too."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


class Block:
    """Some texts: their distinct words (start and end among them) in order, and for each token its place there."""

    KINDS = (np.int64, np.uint8, np.uint8, np.int64, np.uint64, np.uint32)

    def __init__(self, payload: bytes):
        self.ids, self.null, self.held, self.sizes, words, self.at = unpacked(payload, *self.KINDS)
        self.words = np.cumsum(words, dtype=np.uint64)
        self.before = np.roll(self.at, 1)
        self.before[np.cumsum(self.sizes) - self.sizes] = np.searchsorted(self.words, START)
        self.learnt = np.repeat(self.held == 0, self.sizes)

    @staticmethod
    def packed(ids: list, held: list, sizes: np.ndarray, token: np.ndarray) -> bytes:
        words = np.unique(np.append(token, [START, END]).astype(np.uint64))
        return packed(np.array([d or 0 for d in ids], np.int64), np.array([d is None for d in ids], np.uint8), np.array(held, np.uint8), sizes, gaps(words), np.searchsorted(words, token).astype(np.uint32))

    def cuts(self, buckets: int) -> np.ndarray:
        return np.searchsorted(bucket_of(self.words, buckets), np.arange(buckets + 1))

    def word_counts(self) -> np.ndarray:
        """In the texts to learn from; the start counts once a text."""
        c = np.bincount(self.at[self.learnt], minlength=len(self.words)).astype(np.int64)
        c[np.searchsorted(self.words, START)] = int((self.held == 0).sum())
        return c

    def doc_ids(self) -> pd.api.extensions.ExtensionArray:
        return pd.arrays.IntegerArray(self.ids.copy(), self.null > 0)


class Pairs:
    """The distinct bigrams of known words among some tokens, by bucket."""

    def __init__(self, x: Block, tokens: np.ndarray, ids: np.ndarray, c1: np.ndarray, s: Scalars):
        ids = ids.astype(np.uint64)
        h, w = ids[x.before[tokens]], ids[x.at[tokens]]
        known = (h != NO_ID) & (w != NO_ID)
        self.tokens = tokens[known]
        key = s.key(h[known], w[known])
        bucket = s.pair_bucket(key, c1[x.before[self.tokens]])
        order = np.argsort(key)
        if (np.diff(bucket[order]) < 0).any():  # some histories are spread
            order = order[np.argsort(bucket[order], kind="stable")]
        fresh = np.append(True, np.diff(key[order]) != 0)[: len(order)]
        self.order, self.place, self.starts = order, np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        self.first = self.tokens[order[self.starts]]
        self.key, bucket = key[order[self.starts]], bucket[order[self.starts]]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        self.slices = list(zip(bucket[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True)) if len(bucket) else []

    def to_tokens(self, value: np.ndarray, n: int) -> np.ndarray:
        """A value for each distinct bigram as one for each of n tokens, 0 where none was asked for."""
        out = np.zeros(n, value.dtype)
        out[self.tokens[self.order]] = value[self.place]
        return out


def _in_order(answers: pd.DataFrame, *types) -> list[np.ndarray]:
    """The answers of all buckets to one block, one array for each part."""
    parts = [unpacked(x, *types) for x in answers.sort_values("bucket")["payload"]]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, t) for t in types]


@contextmanager
def blocks_of(docs: DataFrame, held_out: Callable[[int | None], bool], limit: int = 8 << 20, per_task: int = 16 << 20):
    """block, types, tokens, texts (the last two to learn from), payload: a table bucketed by block, so that joins by block move
    answers only, never the texts. Gone from the catalog when the context ends. A block has about `limit` characters; a bucket
    is a task of about `per_task` bytes, or more where there would be over MOST_TASKS of them: its blocks are taken one by one."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = min(max(1, -(-total // per_task)), MOST_TASKS)
    name = f"llm_blocks_{uuid.uuid4().hex}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        ids, sizes, token = [], [], []

        def block() -> pa.RecordBatch:
            held, n = [held_out(d) for d in ids], np.concatenate(sizes)
            payload = Block.packed(ids, held, n, np.concatenate(token))
            learnt = np.array(held) == 0
            cols = [[number], [sum(map(len, token))], [int(n[learnt].sum())], [int(learnt.sum())]]
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([payload], pa.binary())], ["block", "all_tokens", "tokens", "texts", "payload"])

        for some, texts in in_slices(batches, min(limit, 2 << 20)):
            words = [words_of(t, lower=True) for t in texts]
            n = np.fromiter(map(len, words), np.int64, len(words)) + 1
            t = np.full(int(n.sum()), END)
            inner = np.ones(len(t), bool)
            inner[np.cumsum(n) - 1] = False
            t[inner] = hashes_of([w for ws in words for w in ws])
            ids += some
            sizes.append(n)
            token.append(t)
            size += sum(map(len, texts))
            if size >= limit:
                yield block()
                number, size = number + 1, 0
                ids, sizes, token = [], [], []
        if ids:
            yield block()

    made = id_and_text(docs).mapInArrow(cut, "block long, all_tokens long, tokens long, texts long, payload binary")
    try:
        made.write.format("parquet").option("path", shared_dir(spark)).option("compression", "uncompressed").bucketBy(partitions, "block").sortBy("block").saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _messages(to: list[int], block: int, payloads: list[bytes]) -> pd.DataFrame:
    return pd.DataFrame({"block": block, "bucket": to, "payload": payloads})


def _ask_words(blocks: DataFrame, buckets: int, what: Callable[[Block], np.ndarray]) -> DataFrame:
    """Each block's distinct words and a number for each, to the buckets of their hashes."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, payload in zip(b["block"].to_pylist(), b["payload"].to_pylist(), strict=True):
                x = Block(payload)
                c, cuts = what(x), x.cuts(buckets).tolist()
                some = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
                out = [packed(gaps(x.words[cuts[k] : cuts[k + 1]]), c[cuts[k] : cuts[k + 1]]) for k in some]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(out, pa.binary())], ["block", "bucket", "payload"])

    return blocks.select("block", "payload").mapInArrow(ask, MESSAGE)


COUNTED = "kind string, block long, bucket int, payload binary, tokens long, types long, " + ", ".join(f"n{r} long" for r in range(1, K + 2))


def _counted(kind: str, bucket: int, payload: bytes, counts: np.ndarray, types: int) -> pd.DataFrame:
    return pd.DataFrame({"kind": [kind], "bucket": [bucket], "payload": [payload], "tokens": [int(counts.sum())], "types": [types]} | {f"n{r}": [n] for r, n in enumerate(counts_of_counts(counts), 1)})


def _word_adder(buckets: int):
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        """One bucket: the words' totals and ids, and these as an answer to each block."""
        bucket = int(pdf["bucket"].iloc[0])
        asked = [unpacked(x, np.uint64, np.int64) for x in pdf["payload"]]
        words, at = np.unique(np.concatenate([np.cumsum(w, dtype=np.uint64) for w, _ in asked]), return_inverse=True)
        total = np.bincount(at, np.concatenate([c for _, c in asked]), minlength=len(words)).astype(np.int64)
        known = total > 0
        ids = np.where(known, (np.cumsum(known) - 1) * buckets + bucket, NO_ID).astype(np.uint32)
        ends = np.cumsum([len(w) for w, _ in asked])
        answers = [packed(ids[a], total[a]) for a in np.split(at, ends[:-1])]
        real = total[known & (words != START)]
        table = _counted("word", bucket, packed(gaps(words[known]), total[known]), real, len(real))
        return pd.concat([table, pd.DataFrame({"kind": "answer", "block": pdf["block"], "bucket": bucket, "payload": answers})])[[c.split()[0] for c in COUNTED.split(", ")]].astype(
            {c: "Int64" for c in ("block", "tokens", "types", *(f"n{r}" for r in range(1, K + 2)))}
        )

    return add


def _ask_pairs(blocks: DataFrame, answers: DataFrame, s: Scalars, fit: bool) -> DataFrame:
    """Each block's distinct bigrams to their buckets; fit: those to learn from, with their counts and the words' counts."""

    def ask(block: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return _messages([], 0, [])
        x = Block(block["payload"].iloc[0])
        ids, c1, *_ = _in_order(answer, *((np.uint32, np.int64) if fit else WORD_ANSWER))
        p = Pairs(x, np.flatnonzero(x.learnt) if fit else np.arange(len(x.at)), ids, c1, s)
        more = []
        if fit:
            n = np.diff(np.append(p.starts, len(p.order)))
            more = [n.astype(np.int64), c1[x.at[p.first]]]
        out = [packed(gaps(p.key[a:b]), *(m[a:b] for m in more)) for _, a, b in p.slices]
        return _messages([k for k, _, _ in p.slices], int(block["block"].iloc[0]), out)

    return blocks.select("block", "payload").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(ask, MESSAGE)


STATS = (np.uint32, np.float64, *[np.int32] * K)


def _pair_adder(s: Scalars):
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        """One bucket of bigrams: their totals; and for each history's word bucket the P of what it has seen, and how many of
        that it has seen once, twice and so on."""
        asked = [unpacked(x, np.uint64, np.int64, np.int64) for x in pdf["payload"]]
        key = np.concatenate([np.cumsum(a[0], dtype=np.uint64) for a in asked])
        c, c1 = (np.concatenate([a[k] for a in asked]) for k in (1, 2))
        del asked
        order = np.argsort(key)
        starts = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        total = np.add.reduceat(c[order], starts)
        p1 = s.word(c1[order[starts]])
        key = key[order[starts]]
        del order, c, c1
        dealt = s.parts_of(key)[0]
        new = np.flatnonzero(np.append(True, np.diff(dealt) != 0))
        h = s.history(dealt[new])
        mass = np.add.reduceat(p1, new)
        low = [np.add.reduceat(total == r, new, dtype=np.int32) for r in range(1, K + 1)]
        to = (h % np.uint64(s.word_buckets)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.diff(to[by], prepend=-1)).tolist()
        home, stats = [], []
        for a, b in zip(cuts, [*cuts[1:], len(by)], strict=True):
            mine = by[a:b]
            home.append(int(to[mine[0]]))
            stats.append(packed(h[mine].astype(np.uint32), mass[mine], *(x[mine] for x in low)))
        table = _counted("bigram", int(pdf["bucket"].iloc[0]), packed(gaps(key), total), total, len(total))
        return pd.concat([table, pd.DataFrame({"kind": "stats", "bucket": home, "payload": stats})]).assign(block=0)[[c.split()[0] for c in COUNTED.split(", ")]].astype(
            {c: "Int64" for c in ("tokens", "types", *(f"n{r}" for r in range(1, K + 2)))}
        )

    return add


#: A row of the stored words: hash, count, 1 where the history leaves one in count + 1, backoff weight.
WORDS = (np.uint64, np.int64, np.uint8, np.float64)


def _word_rows(s: Scalars):
    """The only place where backoff weights come from."""

    def rows(words: pd.DataFrame, stats: pd.DataFrame) -> pd.DataFrame:
        if not len(words):
            return pd.DataFrame({"bucket": [], "payload": []})
        hashes, c = unpacked(words["payload"].iloc[0], np.uint64, np.int64)
        mass, low, seen = np.zeros(len(c)), np.zeros(len(c)), np.zeros(len(c), bool)
        for x in stats["payload"]:
            h, m, *n = unpacked(x, *STATS)
            at = h.astype(np.int64) // s.word_buckets
            mass[at] += m  # a history is once in a message
            low[at] += sum((1 - s.d2[r]) * (r + 1) * n[r] for r in range(K))
            seen[at] = True
        none_low = seen & (low == 0)
        left = np.where(none_low, 1.0, low) / (c + none_low)
        alpha = np.where(seen, left / (1 - mass), 1.0)
        return pd.DataFrame({"bucket": words["bucket"].iloc[:1], "payload": [packed(hashes, c, none_low.astype(np.uint8), alpha)]})

    return rows


@dataclass
class Model:
    """A stored model: words (bucket, payload: WORDS) and bigrams (bucket, payload: gaps of keys, counts) below one folder."""

    spark: SparkSession
    path: str
    scalars: Scalars

    @property
    def words(self) -> DataFrame:
        return self.spark.read.schema("bucket int, payload binary").parquet(f"{self.path}/words")

    @property
    def bigrams(self) -> DataFrame:
        return self.spark.read.schema("bucket int, payload binary, kind string").parquet(f"{self.path}/counts").filter("kind = 'bigram'").select("bucket", "payload")

    def word_table(self) -> DataFrame:
        """hash, id, count, alpha as rows, the start among them."""
        buckets = self.scalars.word_buckets

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for bucket, x in zip(b["bucket"].to_pylist(), b["payload"].to_pylist(), strict=True):
                    h, c, _, alpha = unpacked(x, *WORDS)
                    h = np.cumsum(h, dtype=np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.arange(len(h)) * buckets + bucket), pa.array(c), pa.array(alpha)], ["hash", "id", "count", "alpha"])

        return self.words.mapInArrow(rows, "hash long, id long, count long, alpha double")

    def bigram_table(self) -> DataFrame:
        """history, word (ids), count as rows."""
        s = self.scalars

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for x in b["payload"].to_pylist():
                    key, c = unpacked(x, np.uint64, np.int64)
                    h, w = s.parts_of(np.cumsum(key, dtype=np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(s.history(h).view(np.int64)), pa.array(w.view(np.int64)), pa.array(c)], ["history", "word", "count"])

        return self.bigrams.mapInArrow(rows, "history long, word long, count long")


def load(spark: SparkSession, path: str) -> Model:
    return Model(spark, path, Scalars(**json.loads(spark.read.text(f"{path}/scalars").first()[0])))


def _sums(df: DataFrame, kind: str) -> dict[str, int]:
    names = ["tokens", "types", *(f"n{r}" for r in range(1, K + 2))]
    r = df.filter(F.col("kind") == kind).agg(*(F.sum(c).alias(c) for c in names), F.max("types").alias("most")).first()
    return {k: r[k] or 0 for k in (*names, "most")}


def _by_kind(df: DataFrame, path: str) -> DataFrame:
    df.write.partitionBy("kind").option("compression", "uncompressed").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fit(blocks: DataFrame, per_bucket: int = 1 << 20, hot: int = 1 << 20) -> Model:
    """Counts the texts to learn from and stores the model in the shared folder."""
    spark = blocks.sparkSession
    path = shared_dir(spark)
    r = blocks.agg(F.sum("all_tokens").alias("all"), F.sum("texts").alias("texts")).first()
    buckets = max(1, -(-(r["all"] or 0) // per_bucket))
    word_buckets = max(1, buckets // 4)
    asked = _ask_words(blocks, word_buckets, Block.word_counts)
    counted = _by_kind(asked.repartitionById(word_buckets, F.col("bucket")).groupBy("bucket").applyInPandas(_word_adder(word_buckets), COUNTED), shared_dir(spark))
    sums = _sums(counted, "word")
    tokens, d1 = sums["tokens"], discounts([sums[f"n{k}"] for k in range(1, K + 2)])
    left = sum((1 - d1[r - 1]) * r * sums[f"n{r}"] for r in range(1, K + 1)) / tokens if tokens else 1.0
    scale, unseen = (1.0, left) if left > 0 else (tokens / (tokens + 1), 1 / (tokens + 1))
    # Ids are rank * buckets + bucket; the start is one more word.
    bits = max(int((sums["most"] + 2) * word_buckets).bit_length(), 1)
    if bits > 32:
        raise ValueError("more than 2^32 word ids")
    s = Scalars(tokens, sums["types"], r["texts"] or 0, d1, scale, unseen, word_buckets, buckets, bits, hot)
    answers = counted.filter("kind = 'answer'").select("block", "bucket", "payload")
    pairs = _by_kind(_ask_pairs(blocks, answers, s, True).repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInPandas(_pair_adder(s), COUNTED), f"{path}/counts")
    sums = _sums(pairs, "bigram")
    s.d2 = discounts([sums[f"n{k}"] for k in range(1, K + 2)])
    words, stats = counted.filter("kind = 'word'").select("bucket", "payload"), pairs.filter("kind = 'stats'").select("bucket", "payload")
    _together(words, stats, word_buckets).applyInPandas(_word_rows(s), "bucket int, payload binary").write.option("compression", "uncompressed").parquet(f"{path}/words")
    spark.createDataFrame([(json.dumps(asdict(s)),)], "value string").coalesce(1).write.text(f"{path}/scalars")
    return load(spark, path)


#: id, count, leaves one in count + 1; then the backoff weights of those that were asked for.
WORD_ANSWER = (np.uint32, np.int64, np.uint8, np.float64)


def _needs_weight(x: Block) -> np.ndarray:
    """1 for histories in texts that the model hasn't learnt from: all bigrams of the others are seen."""
    out = np.zeros(len(x.words), np.uint8)
    out[x.before[~x.learnt]] = 1
    return out


def _together(a: DataFrame, b: DataFrame, buckets: int):
    """Both by bucket, in as many partitions as there are buckets."""
    return a.repartition(buckets, "bucket").groupBy("bucket").cogroup(b.repartition(buckets, "bucket").groupBy("bucket"))


def _find_words(asked: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    def find(ask: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        h, c, none_low, alpha = unpacked(table["payload"].iloc[0], *WORDS) if len(table) else [np.empty(0, t) for t in WORDS]
        h, out = np.cumsum(h, dtype=np.uint64), []
        for x in ask["payload"]:
            w, need = unpacked(x, np.uint64, np.uint8)
            at, known = _found(h, np.cumsum(w, dtype=np.uint64))
            bucket = int(ask["bucket"].iloc[0])
            got = lambda v: np.where(known, v[at], 0).astype(v.dtype) if len(v) else np.zeros(len(at), v.dtype)  # noqa: E731, B023
            out.append(packed(np.where(known, at * buckets + bucket, NO_ID).astype(np.uint32), got(c), got(none_low), got(alpha)[need > 0]))
        return ask[["block", "bucket"]].assign(payload=out)

    return _together(asked, words, buckets).applyInPandas(find, MESSAGE)


def _found(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted number in a sorted table, and whether it is there."""
    at = np.minimum(np.searchsorted(table, wanted), max(len(table) - 1, 0))
    return at, table[at] == wanted if len(table) else np.zeros(len(wanted), bool)


def _find_pairs(asked: DataFrame, bigrams: DataFrame, buckets: int) -> DataFrame:
    def find(ask: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        key, c = unpacked(table["payload"].iloc[0], np.uint64, np.int64) if len(table) else (np.empty(0, np.uint64), np.empty(0, np.int64))
        key, out = np.cumsum(key, dtype=np.uint64), []
        for x in ask["payload"]:
            at, known = _found(key, np.cumsum(unpacked(x, np.uint64)[0], dtype=np.uint64))
            out.append(packed(np.where(known, c[at], 0) if len(c) else np.zeros(len(at), np.int64)))
        return ask[["block", "bucket"]].assign(payload=out)

    return _together(asked, bigrams, buckets).applyInPandas(find, MESSAGE)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(blocks: DataFrame, model: Model) -> DataFrame:
    """A row for each document, from the stored tables alone: a bigram's discounted share, else its history's weight times the
    word's discounted share, else what is left for unseen words."""
    s = model.scalars
    words = written(_find_words(_ask_words(blocks, s.word_buckets, _needs_weight), model.words, s.word_buckets))
    pairs = _find_pairs(_ask_pairs(blocks, words, s, False), model.bigrams, s.pair_buckets)

    def evaluate(block: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        x = Block(block["payload"].iloc[0])
        ids, c1, none_low, weights = _in_order(answer[answer["level"] == 1], *WORD_ANSWER)
        (c2,) = _in_order(answer[answer["level"] == 2], np.int64)
        c2 = Pairs(x, np.arange(len(x.at)), ids, c1, s).to_tokens(c2, len(x.at)).astype(np.float64)
        alpha = np.ones(len(x.words))
        alpha[_needs_weight(x) > 0] = weights
        alpha[c1 == 0] = 1.0
        whole = (c1 + none_low)[x.before]
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(c2 > 0, discounted(c2, s.d2) / whole, alpha[x.before] * s.word(c1)[x.at])
        base = np.log10((c1 + 1) / (s.tokens + s.types + 1))
        doc = np.repeat(np.arange(len(x.ids)), x.sizes)
        add = lambda v: np.bincount(doc, v, minlength=len(x.ids))
        return pd.DataFrame(
            {
                "doc_id": x.doc_ids(), "held_out": x.held > 0, "n_tokens": x.sizes, "n_known": add((c1 > 0)[x.at]).astype(np.int64),
                "base_score": add(base[x.at]), "score": add(np.log10(p)),
            }
        )

    answers = words.withColumn("level", F.lit(1)).unionByName(pairs.withColumn("level", F.lit(2)))
    return blocks.select("block", "payload").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(evaluate, SCORES)


def fit_and_score(docs: DataFrame, held_out: Callable[[int | None], bool], limit: int = 8 << 20, per_bucket: int = 1 << 20, hot: int = 1 << 20) -> tuple[DataFrame, Model]:
    """A row for each document, and the stored model that the documents which aren't held out give."""
    with blocks_of(docs, held_out, limit) as blocks:
        model = fit(blocks, per_bucket, hot)
        return written(score(blocks, model)), model
