"""Windows of very long texts, whose places need more than 21 bits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessitura.llm import rules


def test_repeats_beyond_two_million_words_are_counted(spark):
    head = 2_100_000
    # Distinct words, then a passage of 3,000 words twice.
    words = F.concat(F.transform(F.sequence(F.lit(0), F.lit(head - 1)), lambda i: F.hex(i)), *[F.transform(F.sequence(F.lit(0), F.lit(2999)), lambda i: F.concat(F.lit("z"), i.cast("string")))] * 2)
    docs = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.array_join(words, " ").alias("text"))
    got = rules.quality_rules(docs).select("n_words", "n_repeat_words", "base_failed").first()
    assert (got["n_words"], got["n_repeat_words"], got["base_failed"]) == (head + 6000, 6000, False)


def test_covered_words_are_not_counted_modulo_two_million(spark):
    # Two words in turn: all windows but none of the words are new; each word is covered once.
    n = 2_200_000
    docs = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.trim(F.repeat(F.lit("a b "), n // 2)).alias("text"))
    assert rules.measures(docs).first()["n_repeat_words"] == n
