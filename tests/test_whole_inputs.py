"""Queries that take every row and the whole text, where older ones of the same operator leave some out."""

from __future__ import annotations

import hashlib
import re
import unicodedata

from tessitura.plans import registry, registry_text, registry_updates  # noqa: F401  the others add their queries

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def kind(ch):
    return unicodedata.category(ch)[0]


def cleaned(text):
    """Character by character."""
    out = re.sub(r"\([^)]{1,30}\)", " ", re.sub(r"\[[^\]]*\]", " ", unicodedata.normalize("NFKC", text).lower()))
    runs = re.findall(r"[0-9]+|.", "".join("0" if kind(ch) == "N" else "a" if kind(ch) == "L" or ch == "_" else "." for ch in out))
    parts, at = [], 0
    for run in runs:
        end = at + len(run)
        joined = run[0] == "0" and any(kind(ch) in "LN" or ch == "_" for ch in out[max(0, at - 1) : at] + out[end : end + 1])
        parts.append(out[at:end] if run[0] != "0" or joined else " ")
        at = end
    kept = "".join(ch if kind(ch) in "LN" or ch in "_'" or ch in SPACE else " " for ch in "".join(parts))
    return re.sub(f"[{SPACE}]+", " ", kept).strip(" ")


def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_every_document_is_cleaned(spark):
    got = {r["doc_id"]: r["digest"] for r in registry.queries()["x06_clean_all"](spark, SF).collect()}
    assert got == {d: hashlib.md5(cleaned(t).encode()).hexdigest() for d, t in documents(spark).items()}
    assert len(got) == registry.queries()["x06_clean_for_match"](spark, SF).count()


def test_quotes_are_found_in_the_whole_text(spark, tmp_path):
    rows = [(1, "x" * 500 + ' "four words in quotes" end'), (2, 'a "short one" here'), (3, "none"), (4, '"a" b c d e "f"')]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["too_long"] for r in registry.queries()["x31_quoted_phrase_whole"](spark, str(tmp_path)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_every_tag_has_its_cluster(spark):
    got = {r["tag_id"] for r in registry.queries()["j10_tag_cluster_all"](spark, SF).collect()}
    assert {t % 2 for t in got} == {0, 1}


def test_lyric_words_say_whether_a_text_has_lines(spark, tmp_path):
    spark.createDataFrame([(1, "a b\nc"), (2, ""), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["x35_lyric_words"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["ok"] for r in got} == {1: True, 2: True, 3: False}
