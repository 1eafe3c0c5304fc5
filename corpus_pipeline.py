"""A corpus pipeline of five stages, each calling one operator of tessitura.llm on all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents
(doc_id, text, lang, source, n_chars). Every row is a document of its own, also where doc_ids are null or repeated.
run() applies them to documents, writing and rereading between the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import classifier, neardup, packing, queries, rules, substrings
from tessitura.llm.common import numbered, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text keeps to the base rule and every threshold. A null or empty text goes; so do all rows of an empty table:
    there are none. Rows go through one by one: repeated and null ids change nothing."""
    return rules.quality_rules(docs, carry=COLUMNS[1:]).filter("kept").select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is 0.7 or more. Trained on labelled rows of the whole table: the stage before has taken out most bad
    examples. A null or empty text is scored by the bias alone; rows go through one by one."""
    return classifier.classify(docs, queries.quality_weights(spark, sf_dir), carry=COLUMNS[1:]).filter("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, of smallest doc_id (null first), also where rows share a doc_id or have none. Rows
    without words stay."""
    rows = numbered(docs, *COLUMNS[2:])
    kept = neardup.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text")).filter("kept")
    return rows.join(kept.select(F.col("doc_id").alias("row")), "row", "left_semi").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that lose words are their kept words joined by one space; others stay as they are, a null one as an empty one. A
    text of which nothing is left stays as an empty one. Every row is a document of its own."""
    out = substrings.remove_repeats(docs, carry=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places in sequences; a null or empty text is one end token, repeated rows are pieces
    of their own."""
    return packing.pack_documents(docs, queries._path("byte_bpe_50k.tiktoken"), queries._path("byte_bpe_50k.json"), queries._pattern())


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier and the tokenizer have no SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
