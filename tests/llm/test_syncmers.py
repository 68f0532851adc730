import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from wavedeck.llm import syncmers
from wavedeck.llm.queries import op6_closed_syncmers
from wavedeck.llm.syncmers import K, S, edited_likeness


def signed(x, bits):
    return x - (1 << bits) if x >> (bits - 1) else x


def xx(data, seed):
    return xxhash.xxh64_intdigest(data, seed)


def murmur(values, seed=42):
    def mix(k):
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        return ((k << 15 | k >> 17) & 0xFFFFFFFF) * 0x1B873593 & 0xFFFFFFFF

    for v in values:
        h = seed
        for part in (v & 0xFFFFFFFF, v >> 32 & 0xFFFFFFFF):
            h ^= mix(part)
            h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
        h ^= 8
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        seed = h ^ h >> 16
    return seed


def brute(text):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]
    h = [xx(w.encode(), 42) for w in words]
    if not h:
        return []
    if len(h) < K:
        return [murmur(h)]
    inner = [signed(xx(struct.pack("<Q", h[i + 1]), xx(struct.pack("<Q", h[i]), 42)), 64) for i in range(len(h) - S + 1)]
    out = []
    for i in range(len(h) - K + 1):
        window = inner[i : i + K - S + 1]
        if min(window) in (window[0], window[-1]):
            out.append(murmur(h[i : i + K]))
    return out


def alike(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    rows = sorted(rows, key=lambda r: (-r[0], -signed(xx((r[1] or "").encode(), 42), 64)))
    out = []
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        f, e, n = brute(t), brute(edited), brute(following)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:08x}" for x in f), "".join(f"{x:08x}" for x in e), round(alike(f, e), 9), round(alike(f, n), 9)))
    return sorted(out)


@pytest.mark.parametrize("rows,most", [(1000, 16_384), (7, 16_384), (7, 5)])
def test_query_is_brute_force(spark, sf_dir, documents, monkeypatch, rows, most):
    monkeypatch.setattr(syncmers, "BUCKET_ROWS", rows)
    monkeypatch.setattr(syncmers, "MAX_BUCKETS", most)
    got = op6_closed_syncmers(spark, sf_dir)
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
    made = sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got.collect())
    assert made == expected([(r.doc_id, r.text) for r in documents.collect()])


def test_rows(spark, odd, empty, odd_docs, monkeypatch):
    monkeypatch.setattr(syncmers, "BUCKET_ROWS", 3)
    got = edited_likeness(odd).collect()
    known = expected([(d[0], d[1]) for d in odd_docs if d[0] is not None])
    assert sorted((r.doc_id, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest(), round(r.near_edited, 9)) for r in got if r.doc_id is not None) == sorted((i, n, sha, e) for i, n, sha, _, _, e, _ in known)
    alone = [r for r in got if r.doc_id is None]
    assert len(alone) == 2 and all(r.near_next == 1.0 for r in alone)
    assert edited_likeness(empty).count() == 0


def test_anchors_don_t_depend_on_what_surrounds_them(spark):
    words = [f"w{i * i % 97}" for i in range(300)]
    texts = [" ".join(words[50:200]), " ".join(["other"] * 20 + words[50:200] + ["words"] * 9)]
    a, b = (r.a for r in spark.createDataFrame([(t,) for t in texts], "text string").select(syncmers.anchors(F.col("text")).alias("a")).collect())
    assert {(x.pos + 20, x.anchor) for x in a} <= {(x.pos, x.anchor) for x in b} and a


def test_texts_with_words_have_anchors(spark):
    """7 to 10 words need not have a closed syncmer: then the whole sequence is the anchor."""
    texts = [" ".join(f"w{n}x{k}x{i}" for i in range(n)) for n in range(1, 13) for k in range(20)]
    bare = [t for t in texts if not brute(t)]
    assert {len(t.split()) for t in bare} == {7, 8, 9, 10}
    df = spark.createDataFrame([(t,) for t in [*texts, "", " ", None]], "text string")
    got = {r.text: ([x.pos for x in r.a], r.fp) for r in df.select("text", syncmers.anchors(F.col("text")).alias("a"), syncmers.fingerprint(F.col("text")).alias("fp")).collect()}
    assert all(got[t] == ([], []) for t in ("", " ", None))
    for t in texts:
        whole = murmur([xx(w.encode(), 42) for w in t.split()])
        assert [x & 0xFFFFFFFF for x in got[t][1]] == (brute(t) or [whole])
        assert got[t][0] == [0] if t in bare else got[t][0]
    a, b = (syncmers.fingerprint(F.lit(t)) for t in bare[:2])
    assert spark.range(1).select(syncmers.likeness(a, b).alias("x"), syncmers.likeness(a, a).alias("y")).head() == (0.0, 1.0)
