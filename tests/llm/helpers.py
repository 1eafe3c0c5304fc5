from __future__ import annotations

from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
SF = "/root/testdata/sf0.001"


def documents(spark, rows):
    """rows: (doc_id, text)."""
    return spark.createDataFrame([(d, t, "en", "src0", None if t is None else len(t)) for d, t in rows], DOCS)


def texts(spark, sf=SF):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a"), (5, "a b"), (6, "word " * 5000), (7, "x" * 70_000), (8, "  lead\n\n\n  and   trail   "),
    (9, "<|endoftext|> 's 've don't<|endoftext|>"), (10, "é漢字\U0001f600   \u0085 mixed 123,456"), (11, "a" * 40_000 + " " * 40_000 + "b"), (12, "a\u0000b\x1c\x1d c"), (13, "a"),
]
