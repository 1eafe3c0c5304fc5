"""The registered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classifier, katz, licences, media, neardup, negatives, packing, rules, spellings, substrings, tokens
from .common import remainder, remainder_of, table


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _op1_held_out(doc_id: int | None) -> bool:
    return remainder_of(doc_id, 7) == 2


def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, model = katz.fit_and_score(table(spark, sf_dir, "documents"), _op1_held_out)
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.scalars.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media_features(media.store_texts(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("hash")).alias("feature"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path("byte_bpe_multi_50k.tiktoken")
    return tokens.with_digests(tokens.encode_documents(table(spark, sf_dir, "documents"), path, _pattern()), path, _pattern())


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The ranks are the json file's vocabulary; tests compare the ids with those of its own library.
    return packing.pack_documents(table(spark, sf_dir, "documents"), _path("byte_bpe_50k.tiktoken"), _path("byte_bpe_50k.json"), _pattern())


def quality_weights(spark: SparkSession, sf_dir: str):
    return classifier.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 4) != 2)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classifier.classify(table(spark, sf_dir, "documents"), quality_weights(spark, sf_dir))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, part=85, whole=100, bands=16)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    got = chat.read_back(chat.format_conversations(rows.unionByName(own)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), _path("byte_bpe_50k.tiktoken"), _path("byte_bpe_50k.json"), _pattern())


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, label = table(spark, sf_dir, "embeddings"), F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.hard_negatives(negatives.usable(vectors, F.col("vec_id"), moved, F.col("embedding")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
