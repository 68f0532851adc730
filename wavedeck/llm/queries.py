"""The registered queries of this subpackage: thin digests of the operators' outputs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, katz, lattice_dedup, license_scan, packing, quality_rank, simhash_trie, suffix_dedup, syncmers

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("hits", lambda h: h["base"])
    labels = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    starts = F.transform("b", lambda h: h["first_word"])
    likeness = F.transform("hits", lambda h: 1 - h["edits"] / F.length(h["phrase"]))
    return found.withColumn("b", base).select(
        "doc_id", "n_words", F.size("b").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("b").alias("base_labels"), labels("hits").alias("labels"), F.coalesce(F.array_max(likeness), F.lit(0.0)).alias("score"),
    )


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0
    found, model = katz.score_documents(table(spark, sf_dir, "documents"), ~held)
    return found.select("doc_id", F.coalesce(held, F.lit(True)).alias("held_out"), "n_tokens", "n_known", F.lit(model.size).cast("long").alias("train_tokens"), "base_score", "score")


def op3_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema))
    return chat_format.read_back(chat_format.format_conversations(rows, public_tokenizers.path("byte_bpe_50k.json")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_bpe.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, packed=True)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup_passages(table(spark, sf_dir, "documents"))
    cut = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", cut.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = syncmers.edited_likeness(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), syncmers.as_text(F.col("fp")).alias("fingerprint"),
        syncmers.as_text(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op7_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))
    docs = table(spark, sf_dir, "documents")
    model = quality_rank.learn(docs, table(spark, sf_dir, "labels"), ~held)
    found = quality_rank.score(docs, model)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.linked(table(spark, sf_dir, "embeddings"))


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_trie.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_license_scan, op2_katz_backoff, op3_chat_masks, op4_byte_bpe, op5_suffix_dedup, op6_closed_syncmers, op7_bradley_terry, op8_lattice_dedup, op9_best_two_fit, op10_simhash_trie)}
#: SQL can't express these operators' methods; tests/llm holds them against brute force instead.
ORACLES: dict[str, str] = {}
