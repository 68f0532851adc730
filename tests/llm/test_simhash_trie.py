import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wavedeck.llm import scratch, simhash_trie
from wavedeck.llm.components import connected_components
from wavedeck.llm.queries import op10_simhash_trie
from wavedeck.llm.simhash_trie import near_duplicates, trie_join, without_near_duplicates


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def brute_fp(text, n=4):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, edges):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def brute(rows, n=4, budget=4):
    fps = {i: brute_fp(t, n) for i, t in rows}
    ids = sorted(fps)
    return fps, groups(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if bin(fps[a] ^ fps[b]).count("1") <= budget])


def clustered(rng, centres, each, flips):
    return np.unique(np.array([int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, flips), replace=False)) for c in rng.integers(0, 2**63, centres) for _ in range(each)], dtype=np.uint64))


@pytest.mark.parametrize("leaf,most", [(1, 50), (4, 1 << 16), (64, 1 << 16)])
def test_trie_join_connects_what_brute_force_does(leaf, most):
    rng = np.random.default_rng(3)
    for budget in (0, 3, 4, 6):
        v = clustered(rng, 30, 12, 9)
        every = [int(x) for x in v]
        expected = groups(every, [(a, b) for k, a in enumerate(every) for b in every[k + 1 :] if bin(a ^ b).count("1") <= budget])
        a, b = trie_join(v, None, budget, leaf, most)
        assert (np.bitwise_count(a ^ b) <= budget).all()
        assert groups(every, zip(a.tolist(), b.tolist())) == expected
        side = rng.random(len(v)) < 0.4
        parts = [trie_join(v[side], None, budget, leaf, most), trie_join(v[~side], None, budget, leaf, most), trie_join(v[side], v[~side], budget, leaf, most)]
        assert groups(every, [p for x, y in parts for p in zip(x.tolist(), y.tolist())]) == expected


def test_query_is_brute_force(spark, sf_dir, documents):
    fps, components = brute([(r.doc_id, r.text) for r in documents.collect()])
    got = op10_simhash_trie(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", components[i]) for i in fps}
    assert len(set(components.values())) < len(components)


def test_tiles_of_a_hot_key(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = clustered(rng, 3, 150, 8)
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    edges = simhash_trie.linked_fingerprints(df, 4, tile=16).collect()
    every = [int(x) for x in v.view(np.int64)]
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 4
    assert all(near(e.a, e.b) for e in edges)
    assert groups(every, [(e.a, e.b) for e in edges]) == groups(every, [(a, b) for k, a in enumerate(every) for b in every[k + 1 :] if near(a, b)])


@pytest.mark.parametrize("together", [2, 3])
def test_keys_of_several_blocks(spark, together):
    rng = np.random.default_rng(6)
    v = clustered(rng, 12, 12, 9)
    every = [int(x) for x in v.view(np.int64)]
    edges = simhash_trie.linked_fingerprints(spark.createDataFrame([(x,) for x in every], "fp long"), 4, together=together).collect()
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 4
    assert all(near(e.a, e.b) for e in edges)
    assert groups(every, [(e.a, e.b) for e in edges]) == groups(every, [(a, b) for k, a in enumerate(every) for b in every[k + 1 :] if near(a, b)])
    assert [simhash_trie.agreeing(n, 4) for n in (0, 10**6, 10**8, 10**10)] == [1, 1, 2, 3]


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, int(x)) for x in range(101, 160)] + [(int(a), int(b)) for a, b in rng.integers(200, 400, (120, 2))] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert {r.node: r.component for r in connected_components(df).collect()} == groups(nodes, [e for e in edges if e[0] != e[1]])
    assert connected_components(df.limit(0)).count() == 0


def test_rows(odd, empty, odd_docs):
    got = near_duplicates(odd).collect()
    known = [(d[0], d[1]) for d in odd_docs if d[0] is not None]
    _, components = brute(known)
    as_int = lambda fp: fp & (2**64 - 1)
    expected = sorted((-1 if d[0] is None else d[0], brute_fp(d[1]), -1 if d[0] is None else components[d[0]]) for d in odd_docs)
    assert sorted((-1 if r.doc_id is None else r.doc_id, as_int(r.fp), -1 if r.component_id is None else r.component_id) for r in got) == expected
    assert near_duplicates(empty).count() == 0


def greedy(rows, n=5):
    """By ascending id a document stays unless it is like one that stays; no fingerprints, no groups."""
    sets = {i: set(shingles(t, n)) for i, t in rows}
    kept = []
    for i in sorted(sets):
        if not any(len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k]) for k in kept):
            kept.append(i)
    return set(kept)


def expected_without(rows, n=5, budget=6):
    """Of copies of a text the first; of each group of fingerprints what greedy() keeps; of all these what it keeps."""
    firsts = {}
    for i, t in sorted(rows):
        firsts.setdefault(t or "", i)
    texts = {i: t for t, i in firsts.items()}
    _, components = brute(list(texts.items()), n, budget)
    members = {}
    for i, c in components.items():
        members.setdefault(c, []).append((i, texts[i]))
    left = set().union(*(greedy(m, n) for m in members.values())) if members else set()
    return greedy([(i, texts[i]) for i in left], n)


def test_near_copies_go(documents, odd, empty, odd_docs):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = without_near_duplicates(documents)
    assert got.columns == documents.columns
    kept = expected_without(rows)
    assert {r.doc_id for r in got.collect()} == kept and len(kept) < len(rows)
    known = [(d[0], d[1]) for d in odd_docs if d[0] is not None]
    left = without_near_duplicates(odd.select("doc_id", "text", "component_id")).collect()
    keep = expected_without(known)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in left) == sorted(-1 if d[0] is None else d[0] for d in odd_docs if d[0] is None or d[0] in keep)
    assert without_near_duplicates(empty).count() == 0
    assert near_duplicates(documents.withColumn("fp", F.lit(1))).columns == ["doc_id", "fp", "component_id"]


def test_every_cluster_of_a_group_is_thinned(spark, monkeypatch):
    """Two clusters and lone documents that the fingerprints put into one group."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(400)]
    make = lambda: [words[i] for i in rng.integers(0, 400, 120)]
    rows, n = [], 0
    for size in (4, 3, 2, 1, 1):
        base = make()
        for k in range(size):
            text = list(base)
            text[k * 7] = "changed"
            rows.append((n, " ".join(text)))
            n += 1
    rows += [(n, rows[-1][1]), (n + 1, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    as_one = df.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("component_id"))
    monkeypatch.setattr(simhash_trie, "grouped", lambda *a: as_one)
    assert {r.doc_id for r in without_near_duplicates(df).collect()} == {0, 4, 7, 9, 10}


def test_groups_of_any_number_of_clusters_are_thinned(spark, monkeypatch):
    """Seven clusters in one group of fingerprints: each keeps its first document."""
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(7):
        base = [f"w{i}" for i in rng.integers(0, 400, 120)]
        rows += [(len(rows) + k, " ".join([*base[: k * 7], "changed", *base[k * 7 + 1 :]])) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    as_one = df.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("component_id"))
    monkeypatch.setattr(simhash_trie, "grouped", lambda *a: as_one)
    assert sorted(r.doc_id for r in without_near_duplicates(df).collect()) == list(range(0, 21, 3))


def test_near_copies_go_whatever_their_fingerprints(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    kept = greedy(rows)
    fps = {i: brute_fp(t, 5) for i, t in rows}
    lost = [i for i, _ in rows if i not in kept]
    assert any(min(bin(fps[i] ^ fps[k]).count("1") for k in kept) > 6 for i in lost)
    assert {r.doc_id for r in without_near_duplicates(documents).collect()} == kept


def test_rounds_decide_documents_of_common_shingles(spark, monkeypatch):
    """Copies with edits of their own, often below 0.8 with each other, and others that share a passage with them."""
    monkeypatch.setattr(simhash_trie, "FEW", 2)
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in rng.integers(0, 900, 120)]
    rows = []
    for k in range(40):
        text = list(base)
        for at in rng.integers(0, 120, 1 + k % 2):
            text[at] = f"own{k}"
        rows.append((k * 3, " ".join(text)))
    rows += [(k * 3 + 1, " ".join(base[:30] + [f"w{i}" for i in rng.integers(0, 900, 20)])) for k in range(30)]
    kept = expected_without(rows)
    assert 33 < len(kept) < 68 and len([i for i in kept if i % 3 == 0]) > 3
    assert greedy([r for r in rows if r[0] in kept]) == kept  # no two that stay are alike
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in without_near_duplicates(df).collect()} == kept
    monkeypatch.setattr(simhash_trie, "TILE", 8)
    monkeypatch.setattr(simhash_trie, "MOST_IDS", 3)
    assert {r.doc_id for r in without_near_duplicates(df).collect()} == kept
    # by shingles alone it is the plain rule
    texts = df.select(F.col("doc_id").alias("id"), "text")
    gone = simhash_trie._thinned(*simhash_trie._postings(texts, 5, 0.8), texts, 5, 0.8)
    assert {i for i, _ in rows} - {r.id for r in gone.collect()} == greedy(rows)


def test_shingles_that_meet_nothing_are_no_rows(spark):
    """Documents of words of their own and one passage that all have: most of their shingles are theirs alone."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(k, " ".join(f"own{k}-{i}" for i in range(100)) + " " + passage) for k in range(60)]
    before = len(scratch._PATHS)
    texts = spark.createDataFrame(rows, "id long, text string")
    pairs, tokens = simhash_trie._postings(texts, 5, 0.8)
    assert pairs.count() == tokens.count() == 0
    near = spark.createDataFrame([*rows, (100, rows[7][1] + " more"), (101, ""), (102, " ")], "id long, text string")
    pairs, tokens = simhash_trie._postings(near, 5, 0.8)
    assert {(r.a, r.b) for r in pairs.collect()} == {(7, 100), (101, 102)} and tokens.count() == 0
    assert len(scratch._PATHS) == before + 2  # the postings alone
    assert {r.doc_id for r in without_near_duplicates(near.withColumnRenamed("id", "doc_id")).collect()} == {r[0] for r in rows} | {101}
    assert len(scratch._PATHS) == before + 3


def test_a_group_of_which_few_are_alike_makes_few_rows(spark, monkeypatch):
    """Documents that are edits of one text, nearly all below 0.8 with each other: those that can't be alike meet as no rows."""
    monkeypatch.setattr(simhash_trie, "FEW", 4)
    rng = np.random.default_rng(14)
    base = [f"w{i}" for i in rng.integers(0, 900, 90)]
    rows = []
    for k in range(120):
        text = list(base)
        for at in rng.choice(90, 1 if k % 40 == 0 else 3, replace=False):
            text[at] = f"own{k}"
        rows.append((k, " ".join(text)))
    kept = expected_without(rows)
    assert len(kept) > 100
    made, met = [], simhash_trie._met

    def counted(tokens, first, similarity):
        pairs = met(tokens, first, similarity)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(simhash_trie, "_met", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in without_near_duplicates(df).collect()} == kept
    assert sum(made) < 2 * len(rows), made


def test_sketches_differ_in_no_more_than_the_sets(spark):
    rng = np.random.default_rng(15)
    for size in (0, 1, 30, 400, 5000):
        every = rng.integers(-(2**63), 2**63 - 1, size + 200)
        a, b = np.unique(every[:size]), np.unique(every[rng.integers(0, 200) :])
        apart = np.bitwise_count((simhash_trie._sketch(a) ^ simhash_trie._sketch(b)).view(np.uint64)).sum()
        assert apart <= len(np.setxor1d(a, b)) and (simhash_trie._sketch(a) == simhash_trie._sketch(a[::-1])).all()
