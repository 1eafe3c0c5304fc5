from __future__ import annotations

import hashlib
import random
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.llm import chat, classifier, media, queries, rules, substrings

from .helpers import ODD, SF, documents, texts


def split(text):
    return (text or "").encode().split()


# media


def test_png_round_trip_and_generic_filters():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (3, 7), (5, 4, 3), (2, 6, 4), (4, 3, 2)):
        x = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode_png(media.encode_png(x)) == x).all()
    x = rng.integers(0, 256, (6, 5), dtype=np.int64)
    lines = []
    for y, kind in enumerate([0, 1, 2, 3, 4, 4]):  # every filter, written out
        row = [kind]
        for i in range(5):
            a, b, d = (x[y, i - 1] if i else 0), (x[y - 1, i] if y else 0), (x[y - 1, i - 1] if i and y else 0)
            p = a + b - d
            near = [0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]][kind]
            row.append(int(x[y, i] - near) & 255)
        lines.append(bytes(row))
    data = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(b"".join(lines))) + media._chunk(b"IEND", b"")
    assert (media.decode_png(data) == x).all()
    for k in (0, 20, 45, len(data) - 6):
        with pytest.raises((ValueError, zlib.error)):
            media.decode_png(data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :])
    with pytest.raises(ValueError, match="PNG"):
        media.decode_png(data[:-12])


def test_hash_is_stable_under_noise():
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(size=(96, 96)), axis=0)
    x = ((x - x.min()) / np.ptp(x) * 255).astype(np.uint8)
    other = rng.integers(0, 256, (96, 96), dtype=np.uint8)
    far = lambda a, b: sum((p ^ q).bit_count() for p, q in zip(media.cosine_hash(a), media.cosine_hash(b), strict=True))
    assert far(x, np.clip(x.astype(int) + rng.integers(-2, 3, x.shape), 0, 255).astype(np.uint8)) <= 6
    assert far(x, np.kron(x, np.ones((2, 2), np.uint8))) <= 2
    assert far(x, other) > 15


def test_media_query(spark):
    for rows, want in ((queries.op2_media_columns(spark, SF).collect(), texts(spark)),):
        assert len(rows) == len(want)
        for r in rows:
            b = (want[r["doc_id"]] or "").encode()
            full = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    odd = media.media_features(media.store_texts(documents(spark, ODD))).collect()
    assert {r["doc_id"]: r["n_bytes"] for r in odd} == {d: len((t or "").encode()) for d, t in ODD}
    assert len({(r["media_bytes"], r["hash"]) for r in odd if r["doc_id"] in (1, 2)}) == 1
    assert media.media_features(media.store_texts(documents(spark, []))).count() == 0


# classifier


def test_classifier_on_rows_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_quality_classifier(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert sum(r["predicted"] for r in good) >= 0.97 * len(good)
    assert sum(r["predicted"] for r in bad) <= 0.2 * len(bad)
    assert got.count() == len(texts(spark, sf))


def test_classifier_edges(spark):
    w = classifier.train_shard(["good words here and there"] * 20 + ["BAD!! BAD!!"] * 20, [1] * 20 + [0] * 20)
    got = {r["doc_id"]: r for r in classifier.classify(documents(spark, [*ODD, (50, "BAD!! BAD!!"), (51, "good words here")]), w).collect()}
    assert len(got) == len(ODD) + 2
    assert got[1]["score"] == got[2]["score"] == got[3]["score"]
    assert got[50]["score"] < 0.3 < 0.7 < got[51]["score"]
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert classifier.train(documents(spark, ODD), none, F.lit(True)) is None
    assert {r["score"] for r in classifier.classify(documents(spark, ODD), None).collect()} == {0.5}


# chat


def test_chat_round_trip(spark):
    rnd = random.Random(4)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "[NEXT]", "\\", "<", "[", "/s>", "INST]", "a", "é\n", " ", "<\\s>", "[\\\\/INST]"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "a[INST]b", None]), rnd.choice([None, "", "".join(rnd.choices(parts, k=rnd.randrange(9)))])) for c in range(60) for t in range(rnd.randrange(1, 8))]
    rows += [(99, 0, "user", "x"), (99, 0, "user", "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("blocks", F.lit(2))
    want: dict = {}
    for c, t, r, x in sorted(rows, key=lambda q: (q[0] is None, q[0] or 0, q[1] is not None, q[1] or 0, q[2] or "", q[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == turns
        assert got[c]["loss_text"] == "".join(x for r, x in turns if r == "assistant")
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:], strict=False))
        assert got[c]["formatted"].count("[/INST]") == blocks == got[c]["formatted"].count("</s>")
    assert chat.format_conversations(df.limit(0)).count() == 0


# rules


def test_rules_on_odd_texts(spark):
    more = [(40, "a b c a b c d"), (41, "x\ny\nx\n \n\nx"), (42, "the " * 30 + "# $ % " * 10), (43, " ".join(f"w{k}" for k in range(3000)) + " the" * 200), (44, "the of and to " + " ".join(f"word{k}" for k in range(60)))]
    got = {r["doc_id"]: r for r in rules.quality_rules(documents(spark, ODD + more)).collect()}
    for d, t in ODD + more:
        ws = split(t)
        seen: dict = {}
        for i in range(len(ws) - 2):
            seen.setdefault(tuple(ws[i : i + 3]), []).append(i)
        covered = {p + k for at in seen.values() if len(at) > 1 for p in at for k in range(3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = got[d]
        want = (len(ws), sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, d
        assert r["base_failed"] == (len(ws) < 50 or 100 * len(covered) > 50 * len(ws))
        assert not (r["base_failed"] and r["kept"])
    assert got[44]["kept"]
    assert rules.quality_rules(documents(spark, [])).count() == 0
    # A filter on the verdict, or a use of two columns, must not repeat the work for each element.
    assert rules.quality_rules(documents(spark, [(1, "word " * 20000)])).filter("kept or n_words > 1").count() == 1


# substrings


def brute_kept(rows, size):
    """Kept words by document, windows in order of (doc_id, start)."""
    seen: dict = {}
    out = {}
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0])):
        ws = split(t)
        gone = set()
        for i in range(len(ws) - size + 1):
            if seen.setdefault(tuple(ws[i : i + size]), (d, i)) != (d, i):
                gone.update(range(i, i + size))
        out[d] = [w for i, w in enumerate(ws) if i not in gone]
    return out


@pytest.mark.parametrize(("size", "mini"), [(20, 5), (6, 3), (4, 4)])
def test_substrings_equal_brute_force(spark, size, mini):
    rnd = random.Random(size)
    shared = [[rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 60))] for _ in range(6)]
    rows = [*ODD, (None, "q w e r t y " * 10), (90, "z " * 100), (91, "p q " * 60)]
    for d in range(100, 160):
        ws: list = []
        for _ in range(rnd.randrange(0, 6)):
            ws += rnd.choice(shared) if rnd.random() < 0.5 else [rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(40))]
        rows.append((d, rnd.choice([" ", "\n", "  "]).join(ws)))
    rnd.shuffle(rows)
    rows.append(rows[5])  # a repeated row
    docs = documents(spark, rows).withColumn("key", F.lit(1)).withColumn("ranges", F.lit(2)).repartition(5)
    want = brute_kept(dict(rows).items(), size)
    got = substrings.remove_repeats(docs, size, mini).collect()
    assert len(got) == len(rows)
    for r in got:
        kept, all_words = want[r["doc_id"]], split(dict(rows)[r["doc_id"]])
        assert (r["n_words"], r["n_removed"]) == (len(all_words), len(all_words) - len(kept)), r["doc_id"]
        assert r["kept_sha256"] == hashlib.sha256(b" ".join(kept)).hexdigest()
        assert split(r["kept_text"]) == kept


def test_substrings_small_slices_and_no_rows(spark):
    rows = [(d, " ".join(f"w{(d * 7 + k) % 90}" for k in range(70))) for d in range(30)]
    want = brute_kept(rows, 20)
    ranges = substrings.repeated_ranges(documents(spark, rows), limit=500).collect()
    gone: dict = {}
    for r in ranges:
        gone.setdefault(r["key"], set()).update(range(r["low"], r["high"]))
    assert {d: len(t.split()) - len(gone.get(d, ())) for d, t in rows} == {d: len(w) for d, w in want.items()}
    assert substrings.remove_repeats(documents(spark, [])).count() == 0


def test_rows_without_a_doc_id_or_with_a_repeated_one_keep_their_own_words(spark):
    """Nothing of a text goes because of what another row of the same or no id repeats."""
    own, other, new = (" ".join(f"{c}{k}" for k in range(60)) for c in "abc")
    rows = [(None, own), (None, other), (None, other + " " + other), (7, new), (7, other), (7, new)]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(documents(spark, rows)).collect())
    firsts = [x for x in got if x[0] == 0]
    assert (0, 60, 0) in firsts  # the text that nothing else holds
    assert sum(x[1] - x[2] for x in got if x[:2] != (7, 60)) + sum(x[1] - x[2] for x in got if x[:2] == (7, 60)) >= 60 + 60 + 2 * 60
    assert [x for x in got if x[0] == 7] == [(7, 60, 0), (7, 60, 0), (7, 60, 60)]


def test_an_empty_table_and_buckets_by_bytes(spark):
    assert substrings.remove_repeats(documents(spark, [])).count() == 0
    text = " ".join(f"w{k}" for k in range(400))
    ranges = substrings.repeated_ranges(documents(spark, [(1, text), (2, text)]), per_bucket=500).collect()
    gone = set()
    for r in ranges:
        assert r["key"] == 2
        gone |= set(range(r["low"], r["high"]))
    assert gone == set(range(400))


def test_windows_of_a_hot_minimiser_are_spread_and_still_meet(spark):
    """With every minimiser hot, results are the same, and one that many texts share gets many keys."""
    rnd = random.Random(2)
    five = "very common five word run".split()
    rows = [(d, " ".join([*(f"w{rnd.randrange(50)}" for _ in range(30)), *five, *(f"w{rnd.randrange(50)}" for _ in range(30))])) for d in range(60)]
    rows += [(d + 100, t) for d, t in rows[:20]]
    docs = documents(spark, rows)
    got = {}
    for least in (0, 10**9):
        gone = {(r["key"], k) for r in substrings.repeated_ranges(docs, size=10, mini=3, least=least).collect() for k in range(r["low"], r["high"])}
        got[least] = gone
    assert got[0] == got[10**9] and len(got[0]) == 20 * 65
    hot = substrings.hot_minimisers(docs, 10, 3, 1 << 20, least=10)
    assert 0 < len(hot) < 200
    h = substrings.hashes_of([w.encode() for d, t in rows for w in t.split()])
    last = np.repeat(np.arange(1, len(rows) + 1) * 65, 65)
    plain, spread = (substrings.super_kmers(h, last, 10, 3, x)[2] for x in (None, hot))
    assert len(set(spread.tolist())) > len(set(plain.tolist()))
    assert np.unique(spread, return_counts=True)[1].max() < np.unique(plain, return_counts=True)[1].max()


def test_a_passage_in_every_document_is_spread_over_the_buckets(spark):
    """Copies are decided where they are read: the passage's own bucket gets one text a slice."""
    passage = " ".join(f"line{k}" for k in range(80))
    rows = [(k, f"{passage} own{k} a{k} b{k}") for k in range(300)]
    docs = documents(spark, rows).repartition(3)
    dealt = substrings._dealt(docs.select("doc_id", "text"), 20, 5, 16, 2000, np.empty(0, np.uint64)).collect()
    got = [(r["bucket"], substrings.unpacked(r["payload"], *substrings.KINDS)) for r in dealt]
    with_ranges = [b for b, x in got if len(x[6])]
    assert len(set(with_ranges)) > 8
    texts_of = Counter(part for _, x in got for part in cut(x[5], x[4]) if part.startswith(b"line0 "))
    slices = len(with_ranges)
    assert max(texts_of.values()) <= 2 * slices < 300
    out = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(docs).collect()}
    assert out == {k: 80 if k else 0 for k in range(300)}


def cut(text, lengths):
    ends = np.cumsum(lengths)
    return [text[b - n : b] for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]


def test_many_turns_cost_in_proportion(spark):
    """A conversation of 10^5 turns; the fold that it once was took 22 s for 32,000."""
    rows = spark.range(100_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 3 = 0, 'user', 'assistant') AS role", "concat('t', id, ' </s>') AS text")
    began = time.time()
    r = chat.read_back(chat.format_conversations(rows)).select(F.size("turns").alias("n"), "loss_text").first()
    assert r["n"] == 100_000
    assert r["loss_text"] == "".join(f"t{k} </s>" for k in range(100_000) if k % 3)
    assert time.time() - began < 60
