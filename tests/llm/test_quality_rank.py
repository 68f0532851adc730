import zlib

import numpy as np
from pyspark.sql import functions as F

from wavedeck.llm.queries import op7_bradley_terry
from wavedeck.llm.quality_rank import MAX_LABELLED, Ranking, features, fit, learn, score


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op7_bradley_terry(spark, sf).collect()
    assert len(got) == 1000 and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    unseen = [(r.score, r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, bad = (np.array([s for s, _, y in unseen if y == want]) for want in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert np.mean([p == y for _, p, y in unseen]) > 0.9 and np.mean([p for _, p, y in unseen if y == 1]) > 0.95


def test_fit_orders_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] - 2 * x[:, 3] + 0.3 * rng.normal(size=400) > -1).astype(int)
    model = fit(x, y)
    s = model.scores(x)
    assert (s[y == 1][:, None] > s[y == 0][None]).mean() > 0.97
    # the threshold is the quantile of the share of label 0
    assert abs((s < 0.7).mean() - (y == 0).mean()) < 0.01
    assert (fit(x, np.ones(400, int)).scores(x) == 0.7).all() and (Ranking(0.7).scores(x) == 0.7).all()


def test_only_the_text_counts(spark, odd, odd_docs, empty):
    labels = spark.createDataFrame([(i * 7 % 50, int(i > 4), 0) for i in range(10)] + [(None, 1, 0), (3, None, 1), (90, 7, 0)], "doc_id long, quality int, toxic int")
    model = learn(odd, labels, F.lit(True))
    got = score(odd, model, keep=("fp", "text")).collect()
    assert len(got) == len(odd_docs) and all(r.fp in (None, "x", "y") for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(r.text or "", set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert score(empty, model).count() == 0
    assert learn(empty, labels, F.lit(True)).scores(np.zeros((1, 3))) == [0.7]
    assert learn(odd, labels.limit(0), F.lit(True)).scores(np.zeros((1, 3))) == [0.7]


def test_the_sample_is_bounded(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = learn(docs, labels, F.lit(True), most=300)
    assert len(model.weights) and MAX_LABELLED == 20_000


def test_features_are_finite():
    for t in ("", " ", "\n\n", "a", "é" * 1000, "!" * 50, "x " * 5000, "\x00\x01", "日本語"):
        assert np.isfinite(features(t)).all()


def test_repeated_ids_stay_within_the_bound(spark):
    from pyspark.sql import functions as F

    from wavedeck.llm import quality_rank

    docs = spark.range(4000).select((F.col("id") % 20).alias("doc_id"), F.concat(F.lit("some words here "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(20).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    seen = []
    fit = quality_rank.fit
    quality_rank.fit = lambda x, y, cut: seen.append(len(y)) or fit(x, y, cut)
    try:
        quality_rank.learn(docs, labels.unionAll(labels), F.lit(True), most=100)
    finally:
        quality_rank.fit = fit
    assert 40 <= seen[0] <= 220
