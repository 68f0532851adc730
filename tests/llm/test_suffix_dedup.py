import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from wavedeck.llm import blocks, exchange, scratch, suffix_dedup
from wavedeck.llm.queries import op5_suffix_dedup
from wavedeck.llm.suffix_dedup import ColumnIndex, dedup_passages, passage_lows


def brute(rows, least=50):
    """rows: (id, text) -> removed spans and kept bytes per row."""
    texts = [(t or "").encode() for _, t in rows]
    low = {}
    for (i, _), t in zip(rows, texts):
        if i is not None:
            for a in range(len(t) - least + 1):
                w = t[a : a + least]
                low[w] = min(low.get(w, i), i)
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, dtype=np.int8)
        if i is not None:
            for a in range(len(t) - least + 1):
                if low[t[a : a + least]] < i:
                    gone[a : a + least] = 1
        edges = np.flatnonzero(np.diff(gone, prepend=0)).reshape(-1, 2).tolist()
        out.append((edges, bytes(b for b, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("block,bucket,hot,fan", [(8 << 20, 4 << 20, 1000, 256), (30_000, 7_000, 1000, 256), (30_000, 7_000, 2, 256), (30_000, 7_000, 1000, 4)])
def test_rows_are_brute_force(spark, sf_dir, documents, monkeypatch, block, bucket, hot, fan):
    monkeypatch.setattr(exchange, "FAN", fan)
    monkeypatch.setattr(blocks.make_blocks, "__defaults__", (block, blocks.make_blocks.__defaults__[1]))
    monkeypatch.setattr(blocks.bucket_count, "__defaults__", (bucket,))
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: r for r in op5_suffix_dedup(spark, sf_dir).collect()}
    assert sum(r.n_removed for r in got.values()) > 0
    for (i, t), (spans, kept) in zip(rows, brute(rows)):
        assert (got[i].n_bytes, got[i].n_spans, got[i].n_removed) == (len(t.encode()), len(spans), sum(b - a for a, b in spans))
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("piece", [1 << 16, 7])
def test_index_is_the_sorted_suffixes(tmp_path, monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rng = random.Random(1)
    for _ in range(100):
        strings = sorted({bytes(rng.choice(b"abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(6, 20))) for _ in range(rng.randint(1, 30))})
        rng.shuffle(strings)
        sizes = np.array([len(s) for s in strings])
        rows = np.zeros((len(strings), sizes.max()), np.uint8)
        for k, s in enumerate(strings):
            rows[k, len(rows[k]) - len(s) :] = np.frombuffer(s, np.uint8)
        index = ColumnIndex(rows, sizes, str(tmp_path / "index"))
        assert len(list((tmp_path / "index").iterdir())) == 1
        bwt, lcp, own = (np.concatenate(x) for x in zip(*index.chunks()))
        suffixes = [strings[o][a:] for o, a in zip(own >> 8, own & 255)]
        assert suffixes == sorted(suffixes)
        assert [int(x) for x in bwt] == [strings[o][a - 1] + 1 if a else 0 for o, a in zip(own >> 8, own & 255)]
        for a, b, n in zip(suffixes, suffixes[1:], lcp[1:]):
            assert a[:n] == b[:n] and a[n : n + 1] != b[n : n + 1] or n == len(a) == len(b)
        low = np.array([rng.randint(0, 50) for _ in strings])
        lows = {}
        for s, x in zip(strings, low.tolist()):
            for i in range(len(s) - 5):
                lows[s[i : i + 6]] = min(lows.get(s[i : i + 6], 99), x)
        index.streams.drop()
        assert passage_lows(strings, low, 6, None, str(tmp_path / "lows")).tolist() == [lows[s[i : i + 6]] for s in strings for i in range(len(s) - 5)]


def test_rows(spark, odd, empty, odd_docs):
    got = dedup_passages(odd, keep=("source", "bucket")).collect()
    expected = brute([(d[0], d[1]) for d in odd_docs])
    key = lambda i, source, spans, kept: (-1 if i is None else i, source or "", spans, kept)
    assert sorted(key(r.doc_id, r.source, [[s.start, s.stop] for s in r.spans], bytes(r.kept)) for r in got) == sorted(key(d[0], d[3], *e) for d, e in zip(odd_docs, expected))
    text = dedup_passages(odd, as_text=True).collect()
    assert sorted(r.kept for r in text) == sorted(k.decode(errors="ignore") for _, k in expected)
    assert dedup_passages(empty).count() == 0


def test_many_copies(spark, monkeypatch):
    monkeypatch.setattr(blocks.make_blocks, "__defaults__", (3_000, blocks.make_blocks.__defaults__[1]))
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(120))
    rows = [(i, shared if i % 3 else "".join(rng.choice("xyz ") for _ in range(60)) + shared[: 40 + i % 60]) for i in range(150)]
    got = {r.doc_id: [[s.start, s.stop] for s in r.spans] for r in dedup_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: spans for (i, _), (spans, _) in zip(rows, brute(rows))}


def test_characters_that_a_cut_splits(spark):
    shared = "nothing but ordinary words that two documents have alike"
    rows = [(1, "\u00e9" + shared + "\u00e9!"), (2, "\u0169" + shared + "\u0169?")]  # equal second bytes, unlike first ones
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {i: kept for (i, _), (_, kept) in zip(rows, brute(rows))}
    assert expected[2].decode(errors="replace") != expected[2].decode(errors="ignore")
    assert {r.doc_id: bytes(r.kept) for r in dedup_passages(df).collect()} == expected
    assert {r.doc_id: r.kept for r in dedup_passages(df, as_text=True).collect()} == {i: k.decode(errors="ignore") for i, k in expected.items()}


@pytest.mark.parametrize("fan", [256, 4])
def test_questions_are_not_kept_on_disk(spark, documents, monkeypatch, fan):
    monkeypatch.setattr(exchange, "FAN", fan)
    monkeypatch.setattr(blocks.make_blocks, "__defaults__", (30_000, blocks.make_blocks.__defaults__[1]))
    monkeypatch.setattr(blocks.bucket_count, "__defaults__", (7_000,))
    before = len(scratch._PATHS)
    assert dedup_passages(documents).count() == documents.count()
    written = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in scratch._PATHS[before:]]
    assert [w for w in written if not w.startswith("wavedeck_texts")] == ["anchors", "passages"]


def test_memory_of_a_block():
    rng = random.Random(3)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=blocks.BLOCK_BYTES // 8))
    table = pa.table({"id": pa.array(range(8)), "text": pa.array([text[::-1], *[text] * 7])})
    tracemalloc.start()
    try:
        block = suffix_dedup.Block(table, 0, 1, 50, 20)
        assert tracemalloc.get_traced_memory()[0] < 5 * blocks.BLOCK_BYTES
        assert sum(len(q) for _, q in suffix_dedup._questions(block, 204)) > 0
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
    finally:
        tracemalloc.stop()
