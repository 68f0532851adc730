import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from wavedeck.llm import blocks, exchange, katz
from wavedeck.llm.exchange import ordered
from wavedeck.llm.katz import BEGIN, K, discounts, gram_keys, ngram_tables, score_documents, token_hash
from wavedeck.llm.queries import op2_katz_backoff


def brute(rows, order=3):
    """rows: (text, learned) -> n_tokens, n_known, base, score per row; the model: N, counts, P(history, word)."""
    texts = [[*(t or "").encode().lower().split(), b""] for t, _ in rows]
    counts = [Counter() for _ in range(order + 1)]
    for words, (_, learned) in zip(texts, rows):
        if learned:
            padded = [None] * (order - 1) + words
            for i in range(order - 1, len(padded)):
                for k in range(1, order + 1):
                    counts[k][tuple(padded[i - k + 1 : i + 1])] += 1
    size, kinds = sum(counts[1].values()), len(counts[1])
    d = [None, None, *(discounts([sum(n == r for n in counts[k].values()) for r in range(1, K + 2)]) for k in range(2, order + 1))]
    times = [None, None, *({} for _ in range(order - 1))]
    after = [None, None, *({} for _ in range(order - 1))]
    for k in range(2, order + 1):
        for gram, c in list(counts[k].items()):
            times[k][gram[:-1]] = times[k].get(gram[:-1], 0) + c
            if c >= (1 if k < 3 else 2):
                after[k].setdefault(gram[:-1], []).append(gram[-1])
            else:
                del counts[k][gram]
    held = {}

    def raw(k, gram, n):
        c = counts[k][gram]
        return (d[k][c - 1] if c <= len(d[k]) else 1) * c / n

    def mass(h):
        """of a history: its count, the share kept, the backoff weight"""
        if h not in held:
            k = len(h) + 1
            seen = after[k][h]
            n = times[k][h]
            left, share = 1 - sum(raw(k, (*h, w), n) for w in seen), 1.0
            if left <= 1e-12:
                left, share = 1 / (n + 1), n / (n + 1)
            held[h] = n, share, left / (1 - sum(p(h[1:], w) for w in seen))
        return held[h]

    def p(h, w):
        if not h:
            return (counts[1][w,] + 0.1) / (size + 0.1 * (kinds + 1))
        if h not in after[len(h) + 1]:
            return p(h[1:], w)
        n, share, weight = mass(h)
        return raw(len(h) + 1, (*h, w), n) * share if counts[len(h) + 1][*h, w] else weight * p(h[1:], w)

    out = []
    for words in texts:
        padded = [None] * (order - 1) + words
        score = sum(math.log10(p(tuple(padded[i - order + 1 : i]), padded[i])) for i in range(order - 1, len(padded)))
        out.append((len(words), sum(counts[1][w,] > 0 for w in words), sum(math.log10(p((), w)) for w in words), score))
    return out, size, counts, p, after


def held(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


@pytest.mark.parametrize("block,bucket,fan", [(16 << 20, 4 << 20, 256), (20_000, 5_000, 256), (20_000, 5_000, 4)])
def test_scores_are_brute_force(spark, sf_dir, documents, monkeypatch, block, bucket, fan):
    monkeypatch.setattr(katz, "TEXT_BYTES", block)
    monkeypatch.setattr(blocks.bucket_count, "__defaults__", (bucket,))
    monkeypatch.setattr(exchange, "FAN", fan)
    rows = documents.collect()
    expected, size, *_ = brute([(r.text, not held(r.doc_id)) for r in rows])
    got = {r.doc_id: r for r in op2_katz_backoff(spark, sf_dir).collect()}
    for r, (n, known, base, score) in zip(rows, expected):
        g = got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(r.doc_id), n, known, size)
        assert g.base_score == pytest.approx(base, rel=1e-9) and g.score == pytest.approx(score, rel=1e-9)
    # it knows more of unseen texts than their words alone
    unseen = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in unseen) > sum(g.base_score for g in unseen)


@pytest.mark.parametrize("order", [2, 4])
def test_other_orders(documents, order):
    rows = [(r.doc_id, r.text) for r in documents.limit(60).collect()]
    expected = brute([(t, not held(i)) for i, t in rows], order)[0]
    part = documents.where(F.col("doc_id").isin([i for i, _ in rows]))
    got = {r.doc_id: r.score for r in score_documents(part, ~F.col("doc_id").isin([i for i, _ in rows if held(i)]), order=order)[0].collect()}
    assert got == pytest.approx({i: e[3] for (i, _), e in zip(rows, expected)}, rel=1e-9)


def test_conditionals_sum_to_one_at_every_order(documents):
    rows = [(r.text, True) for r in documents.limit(20).collect()]
    _, _, counts, p, after = brute(rows)
    words = [w for (w,) in counts[1]] + [b"unseen kind"]
    for h in [(), *list(after[2])[:12], *list(after[3])[:12], (b"never seen",), (None, b"never seen"), (b"never seen", words[0])]:
        assert sum(p(h, w) for w in words) == pytest.approx(1, abs=1e-9)


def test_discounts():
    assert len(discounts([100, 40, 20, 12, 8, 5])) == 5
    assert len(discounts([0, 0, 0, 0, 0, 0])) == 0
    assert (discounts([100, 40, 20, 0, 8, 5]) <= 1).all()


def key(gram):
    tokens = np.array([BEGIN if w is None else token_hash(w) for w in gram], dtype=np.uint64)
    return int(gram_keys(tokens, len(gram))[-1][-1].view(np.int64))


def test_tables(documents):
    rows = documents.collect()
    _, model = score_documents(documents, F.lit(True))
    _, size, counts, _, after = brute([(r.text, True) for r in rows])
    grams, histories = ngram_tables(model)
    assert model.size == size and model.kinds == len(counts[1])
    got = grams.collect()
    assert {(r.tokens, r.key): r["count"] for r in got} == {(k, key(g)): n for k in (1, 2, 3) for g, n in counts[k].items()}
    assert len(got) == sum(map(len, counts))
    assert {(r.tokens, r.key) for r in histories.collect()} <= {(len(h), key(h)) for k in (2, 3) for h in after[k]}


def test_rows(odd, empty, odd_docs):
    teaches = F.col("doc_id") > 0
    got = score_documents(odd, teaches)[0].collect()
    expected = brute([(d[1], (d[0] or 0) > 0) for d in odd_docs])[0]
    key = lambda x: (*x[:3], round(x[3], 4), round(x[4], 4))
    found = sorted(key((r.doc_id or -1, r.n_tokens, r.n_known, r.base_score, r.score)) for r in got)
    assert np.allclose(found, sorted(key((d[0] or -1, *e)) for d, e in zip(odd_docs, expected)), atol=1e-3)
    assert score_documents(empty, teaches)[0].count() == 0
    nothing = score_documents(odd, F.lit(False))[0].collect()
    assert all(r.score == 0 and r.n_known == 0 for r in nothing)


def test_text_ids(spark):
    df = spark.createDataFrame([("x", "a b"), ("y", "a b c")], "doc_id string, text string")
    got = {r.doc_id: r.n_tokens for r in score_documents(df, F.lit(True))[0].collect()}
    assert got == {"x": 3, "y": 4}


def test_histories_that_a_block_sums_itself(spark, monkeypatch):
    """A history that two blocks have once each isn't asked for, nor stored; one that a third has in a text that doesn't teach is."""
    monkeypatch.setattr(katz, "TEXT_BYTES", 1)  # a block a row
    texts = ["a b c", "x a b d", "e f g", "h e f g", "e f", "k l", "k l m", "n k l m"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    taught = [i != 4 for i in range(len(texts))]
    scored, model = score_documents(df, F.col("doc_id") != 4)
    expected = brute([(t, on) for t, on in zip(texts, taught)])[0]
    assert {r.doc_id: r.score for r in scored.collect()} == pytest.approx({i: e[3] for i, e in enumerate(expected)}, rel=1e-9)

    def key(*words):
        return int(gram_keys(np.array([token_hash(w.encode()) for w in words], np.uint64), len(words))[-1][-1].view(np.int64))

    stored = {r.key for r in ngram_tables(model)[1].collect()}
    assert key("a", "b") not in stored and {key("e", "f"), key("k", "l"), key("a")} <= stored


@pytest.mark.parametrize("high", [1 << 8, 1 << 40, (1 << 64) - 1])
def test_ordered_is_stable(high):
    keys = np.random.default_rng(1).integers(0, high, 20_000, dtype=np.uint64, endpoint=True)
    # of two hashes that differ in their last bit alone the greater stands first
    for x in (keys, np.repeat(keys, 3), np.concatenate([keys | np.uint64(1), keys & ~np.uint64(1)]), keys[:1], keys[:0]):
        order, inside = ordered(x)
        assert (order == np.argsort(x, kind="stable")).all() and (inside == np.sort(x)).all()


def test_blocks_keep_every_token_in_little_room():
    """Frequent words, words seen once, empty texts and nulls: the tokens come back; rare words cost less than whole hashes and numbers."""
    rng = np.random.default_rng(3)
    texts = [None, "", " \t ", "a  B\na", *(" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 300) % 50_000) for _ in range(400))]
    rows = pa.table({"id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string()), "learned": pa.array([True] * len(texts))})
    made = katz._tokenised(rows)
    offsets, tokens = katz._tokens(made)
    split = [[*(t or "").lower().split(), ""] for t in texts]
    assert np.diff(offsets).tolist() == [len(s) for s in split]
    assert tokens.tolist() == [katz.token_hash(w.encode()) for s in split for w in s]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, made.schema) as out:
        out.write_table(made)
    kinds = len(set(tokens.tolist()))
    assert len(zstandard.compress(sink.getvalue().to_pybytes(), 3)) < 1.2 * len(tokens) + 7 * kinds


@pytest.mark.parametrize("fan", [256, 3])
def test_sums_that_many_blocks_ask_for_are_stored_once(spark, monkeypatch, fan):
    """Blocks that share their histories get an answer each; what is kept on disk of them doesn't grow with the blocks' answers."""
    monkeypatch.setattr(katz, "TEXT_BYTES", 1)  # a block a row
    monkeypatch.setattr(blocks.bucket_count, "__defaults__", (20_000,))
    monkeypatch.setattr(exchange, "FAN", fan)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.2, 2000) % 300) for _ in range(24)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    got, kept = [], []

    def exchanged(*args, **named):
        got.append(exchange.exchange(*args, **named)[0])
        return got[-1], kept[-1].where("part <> 'answer'").select("bucket", "data", "figures")

    def stored(*args, **named):
        kept.append(store(*args, **named))
        return kept[-1]

    store = exchange.stored
    monkeypatch.setattr(exchange, "stored", stored)
    monkeypatch.setattr(katz, "exchange", exchanged)
    scored, _ = score_documents(df, F.lit(True))
    expected = brute([(t, True) for t in texts])[0]
    assert {r.doc_id: r.score for r in scored.collect()} == pytest.approx({i: e[3] for i, e in enumerate(expected)}, rel=1e-9)
    size = F.coalesce(F.sum(F.length("data")), F.lit(0))
    answers, on_disk = got[-1].agg(size).head()[0], kept[-1].where("part = 'answer' and (bucket >= 0 or bucket is null)").agg(size).head()[0]
    assert got[-1].select("block").distinct().count() == len(texts) and 0 < on_disk < 0.6 * answers


def test_questions_go_through_a_tree_in_turns(spark, documents, monkeypatch):
    """With several levels a turn has its own part of the ranges, and no question is left out."""
    monkeypatch.setattr(katz, "TEXT_BYTES", 20_000)
    monkeypatch.setattr(blocks.bucket_count, "__defaults__", (5_000,))
    monkeypatch.setattr(exchange, "FAN", 8)
    seen, in_turns = [], exchange.in_turns

    def turns(df, name, *args):
        asked = {r.bucket for r in df.select("bucket").collect()}
        for part in in_turns(df, name, *args):
            seen.append((name, {r.bucket for r in part.select("bucket").collect()}))
            yield part
        found = [buckets for n, buckets in seen if n == name]
        assert len(found) == katz.TURNS and set().union(*found) == asked and sum(map(len, found)) == len(asked) > 3

    monkeypatch.setattr(exchange, "in_turns", turns)
    scored, _ = score_documents(documents, F.lit(True))
    assert {n for n, _ in seen} == {"ngrams-asked", "histories-asked"}
    rows = documents.collect()
    expected = brute([(r.text, True) for r in rows])[0]
    assert {r.doc_id: r.score for r in scored.collect()} == pytest.approx({r.doc_id: e[3] for r, e in zip(rows, expected)}, rel=1e-9)
