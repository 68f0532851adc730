import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, fp string, bucket int"


@pytest.fixture(scope="session")
def odd_docs():
    """Rows with nulls, empty, repeated and long texts, ties, odd characters and columns whose names clash."""
    rng = random.Random(4)
    words = ["the", "MIT", "License", "naïve", "日本語", "a", "b.", "über", "x" * 30, "ok", "é", "🙂"]
    long = " ".join(rng.choice(words) for _ in range(4000))
    base = " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(300))
    texts = [None, "", " \n\t ", "the", "the", base, base, base.replace("ok", "oh", 1), base[:900] + " end", "pre " + base[300:], long, long + " more", "\x1c\x85  a", "﻿Z", "é" * 60, "é" * 61, "word " * 500]
    rows = [(i * 7 % 50, t, "en" if i % 3 else None, f"s{i}", None, i, "x", 1) for i, t in enumerate(texts)]
    rows += [rows[5], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (90, base, "en", "s", 1, 1, "y", 2)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_docs):
    return spark.createDataFrame(odd_docs, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
