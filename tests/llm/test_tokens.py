from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessitura.llm import packing, queries, tokens

from .helpers import ODD, SF, documents, texts

MULTI = P.path("byte_bpe_multi_50k.tiktoken")
RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def test_encoding_equals_the_library_on_odd_texts_and_small_chunks(spark):
    enc = tokens.encoding(MULTI, P.PATTERN)
    for chunk, overlap in ((32768, 512), (700, 40), (37, 9)):
        rows = ODD if chunk > 100 else [x for x in ODD if len(x[1] or "") < 30_000]
        got = {r["doc_id"]: r for r in tokens.encode_documents(documents(spark, rows), MULTI, P.PATTERN, chunk, overlap).collect()}
        assert len(got) == len(rows)
        for d, t in rows:
            want = enc.encode_ordinary(t or "")
            assert np.frombuffer(got[d]["ids"], "<u4").tolist() == want, (d, chunk)
            assert enc.decode_bytes(want) == (t or "").encode()


def test_stitching_random_texts():
    rnd = random.Random(3)
    enc = tokens.encoding(MULTI, P.PATTERN)
    for _ in range(150):
        text = "".join(rnd.choice(["a", "b ", " ", "\n", "'s", "'r", "e", "1", "!", "é", "  ", "漢"]) for _ in range(rnd.randrange(1, 300)))
        for chunk, overlap in ((11, 3), (30, 10), (64, 1)):
            parts = [(s, t, tokens.boundaries(t, P.PATTERN)) for s, t in tokens.chunks(text, chunk, overlap)]
            pieces = tokens.stitch(parts, P.PATTERN)
            assert "".join(t for t, _ in pieces) == text
            known = tokens.known_ids(MULTI, P.PATTERN)
            assert b"".join(tokens.encode_piece(t, ends, known) for t, ends in pieces) == tokens.id_bytes(enc.encode_ordinary(text)), text


def test_caches_stay_bounded():
    made = []
    cache = tokens.Bounded(lambda p: made.append(p) or len(p), {"the": 3}, most=5)
    assert [cache[p] for p in ["the", "a", "bb", "a", "c", "d", "e", "f", "bb", "the"]] == [3, 1, 2, 1, 1, 1, 1, 1, 2, 3]
    assert len(cache) <= 6
    assert "the" not in made


def test_query_on_the_table(spark):
    enc = tokens.encoding(MULTI, P.PATTERN)
    got = {r["doc_id"]: r for r in queries.op3_byte_bpe(spark, SF).collect()}
    want = texts(spark)
    assert got.keys() == want.keys()
    for d, t in want.items():
        ids = enc.encode_ordinary(t or "")
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def _library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_counts_equal_the_library(spark):
    lib = _library()
    for got, want in (
        (tokens.count_tokens(documents(spark, ODD), RANKS, JSON, P.PATTERN, sample=4, size=5), dict(ODD)),
        (queries.op9_token_counts(spark, SF), texts(spark)),
    ):
        rows = got.collect()
        assert len(rows) == len(want)
        for r in rows:
            t = want[r["doc_id"]] or ""
            assert r["n_tokens"] == len(lib.encode(t, add_special_tokens=False).ids), r["doc_id"]
            assert (r["n_bytes"], r["over_limit"]) == (len(t.encode()), r["n_tokens"] > 1024)


def test_empty_table_and_clashing_columns(spark):
    empty = documents(spark, [])
    assert tokens.encode_documents(empty, MULTI, P.PATTERN).count() == 0
    assert tokens.count_tokens(empty, RANKS, JSON, P.PATTERN).count() == 0
    more = documents(spark, [(1, "a b"), (1, "a b"), (None, "c")]).withColumn("key", F.lit("x")).withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit(2))
    assert sorted(r["n_tokens"] for r in tokens.encode_documents(more, MULTI, P.PATTERN, chunk=2, overlap=1).collect()) == [1, 2, 2]


def _check_packing(rows, want: dict, size: int):
    lib = _library()
    by_doc: dict = {}
    places: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by_doc.keys() == want.keys()
    total = 0
    for d, t in want.items():
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by_doc[d], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["length"] == size or (k == 0 and r["length"] <= size)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= size
    return len(places), -(-total // size)


def test_packing(spark):
    used, least = _check_packing(queries.op4_best_fit_packing(spark, SF).collect(), texts(spark), 2048)
    assert used <= least + 1
    odd = packing.pack_documents(documents(spark, ODD), RANKS, JSON, P.PATTERN, size=64, group=5)
    _check_packing(odd.collect(), dict(ODD), 64)
    assert packing.pack_documents(documents(spark, []), RANKS, JSON, P.PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_local_search_keeps_pieces_and_fits(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([rnd.randint(1, 100), rnd.randint(30, 60), 50, 26]) for _ in range(400)]
    first = packing.best_fit(lengths, 100)
    done = packing.local_search([list(b) for b in first], lengths, 100)
    for bins in (first, done):
        assert sorted(i for b in bins for i in b) == list(range(400))
        assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
    assert len(done) <= len(first)
    # Only an exchange makes room for the last piece: 60+30 and 70+25 become 60+25 and 70+30; then 15 moves.
    assert len(packing.local_search([[0, 1], [2, 3], [4]], [60, 30, 70, 25, 15], 100)) == 2
    # Two for one: 50+30 go for 75, so that the other bin is full.
    assert len(packing.local_search([[0, 1], [2, 3], [4]], [75, 20, 50, 30, 25], 100)) == 2


def _fewest(lengths, size):
    """By trying all ways to put the pieces into bins, longest first."""
    best = [len(lengths)]

    def go(k, fills):
        if len(fills) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(fills)
            return
        for b in range(len(fills)):
            if fills[b] + lengths[k] <= size:
                go(k + 1, [*fills[:b], fills[b] + lengths[k], *fills[b + 1 :]])
        go(k + 1, [*fills, lengths[k]])

    go(0, [])
    return best[0]


def test_against_brute_force():
    rnd = random.Random(11)
    over = 0
    for _ in range(200):
        lengths = sorted((rnd.randint(1, 100) for _ in range(rnd.randrange(1, 9))), reverse=True)
        rnd.shuffle(lengths)
        got, want = len(packing.pack_lengths(lengths, 100)), _fewest(sorted(lengths, reverse=True), 100)
        assert want <= got <= want + 1
        over += got > want
    assert over <= 10


@pytest.mark.parametrize("lengths", [[], [100], [1] * 500, [50] * 40, [51] * 20, [*[99] * 30, *[1] * 30]])
def test_ties_and_extremes(lengths):
    done = packing.pack_lengths(lengths, 100)
    assert sorted(i for b in done for i in b) == list(range(len(lengths)))
    assert len(done) == (20 if lengths == [51] * 20 else -(-sum(lengths) // 100))


def test_the_search_empties_bins_that_the_first_deal_leaves():
    rnd = random.Random(5)
    lengths = [rnd.randint(20, 1500) for _ in range(3000)]
    first = packing.first_deal(lengths, 2048)
    assert len(packing.local_search(first, lengths, 2048)) < len(first)


def test_packing_reads_neither_clashing_columns_nor_nulls(spark):
    rows = [(None, "a b"), (None, "a b"), (1, None), (1, "x")]
    docs = documents(spark, rows)
    for c in ("piece", "length", "sequence_id", "_group", "offset"):
        docs = docs.withColumn(c, F.lit("x"))
    got = packing.pack_documents(docs, RANKS, JSON, P.PATTERN, size=64).collect()
    assert len(got) == 4
    assert {r["sequence_id"] for r in got} == {got[0]["sequence_id"]}
    assert sorted(r["offset"] for r in got)[0] == 0


def test_most_texts_are_stitched_from_chunks(spark):
    """The query's own chunks: what is encoded are stitched pieces, more of them than texts."""
    enc, joins, known = tokens.encoding(MULTI, P.PATTERN), 0, tokens.known_ids(MULTI, P.PATTERN)
    all_texts = [t or "" for t in texts(spark).values()]
    for text in all_texts:
        cut = tokens.chunks(text, 896, 128)
        assert all(len(t) <= 1024 for _, t in cut)
        pieces = tokens.stitch([(s, t, tokens.boundaries(t, P.PATTERN)) for s, t in cut], P.PATTERN)
        assert "".join(t for t, _ in pieces) == text and len(pieces) == max(len(cut), 1) if text else not pieces
        assert b"".join(tokens.encode_piece(t, ends, known) for t, ends in pieces) == tokens.id_bytes(enc.encode_ordinary(text))
        joins += max(len(pieces) - 1, 0)
    assert joins > len(all_texts)


def test_dealt_chunks_give_the_same_ids(spark):
    rows = [x for x in ODD if len(x[1] or "") < 30_000]
    got = [{(r["doc_id"], bytes(r["ids"])) for r in tokens.encode_documents(documents(spark, rows), MULTI, P.PATTERN, 50, 10, deal).collect()} for deal in (0, 100, 1 << 20)]
    assert got[0] == got[1] == got[2]


def test_not_above_longest_first_and_equal_rows_are_dealt(spark):
    rnd = random.Random(9)
    for _ in range(5):
        lengths = [min(int(rnd.paretovariate(0.9) * 60), 2047) for _ in range(3000)]
        assert len(packing.pack_lengths(lengths, 2048)) <= len(packing.longest_first(lengths, 2048))
    docs = documents(spark, [(1, "one two three")] * 400)
    got = packing.pack_documents(docs, RANKS, JSON, P.PATTERN, size=64, group=40).collect()
    assert len(got) == 400 and len({r["sequence_id"] >> 31 for r in got}) > 5


def test_the_sample_of_frequent_pre_tokens_is_bounded_for_equal_rows(spark):
    docs = documents(spark, [(1, "alpha beta")] * 3000)
    pieces, _ = tokens.frequent_lengths(docs, RANKS, P.PATTERN, sample=100)
    assert b"alpha" in pieces
    assert tokens.count_tokens(docs, RANKS, JSON, P.PATTERN, sample=100).agg(F.count_distinct("n_tokens")).first()[0] == 1
