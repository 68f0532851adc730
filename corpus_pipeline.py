"""Documents to packed training sequences: quality, near copies, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavedeck.llm import packing, quality_rank, simhash_trie, suffix_dedup
from wavedeck.llm.scratch import stored


def _aside(docs: DataFrame, *own: str) -> tuple[DataFrame, list[str], list[str]]:
    """docs with all columns but `own` under names that clash with nothing, those names, and the names they had."""
    others = [c for c in docs.columns if c not in own]
    names = [f"_column_{i}" for i in range(len(others))]
    return docs.select(*own, *(F.col(f"`{c}`").alias(n) for c, n in zip(others, names))), names, others


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking learned from labels.quality doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_rank.learn(docs, labels, F.lit(True))
    renamed, names, others = _aside(docs, "doc_id", "text")
    kept = quality_rank.score(renamed, model, keep=("text", *names)).where(F.col("score") >= model.cut)
    return kept.select("doc_id", "text", *(F.col(n).alias(c) for n, c in zip(names, others))).select(*(f"`{c}`" for c in docs.columns))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return simhash_trie.without_near_duplicates(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 bytes or more that a document with a smaller id has."""
    renamed, names, others = _aside(docs, "doc_id", "text")
    found = suffix_dedup.dedup_passages(renamed, keep=tuple(names), as_text=True)
    kept = found.select("doc_id", F.col("kept").alias("text"), *((F.length("kept").cast("long") if c == "n_chars" else F.col(n)).alias(c) for n, c in zip(names, others)))
    return kept.select(*(f"`{c}`" for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in packed sequences."""
    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_classifier), ("simhash near-dedup", simhash_dedup), ("suffix-array dedup", passage_dedup), ("best-fit packing", best_fit_packing)]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
