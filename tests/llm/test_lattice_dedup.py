import numpy as np
import pytest

from wavedeck.llm.lattice_dedup import ROOTS, cells, decode, linked
from wavedeck.llm.queries import op8_lattice_dedup

SCHEMA = "vec_id long, embedding array<double>, label int, rep long, n long"


def brute(rows, threshold=0.9):
    """rows: (id, vector) -> links and components."""
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    links, up = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    pairs = set()
    for k, (i, a) in enumerate(ok):
        for j, b in ok[k + 1 :]:
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                pairs.add((i, j))
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return links, {i: root(i) for i in up}, pairs


def test_decode_is_the_nearest_point():
    rng = np.random.default_rng(0)
    y = rng.normal(size=(2000, 8)) * 2
    p = decode(y)
    assert (np.abs(2 * p - np.rint(2 * p)) < 1e-12).all() and (p.sum(axis=1) % 2 == 0).all()
    d = ((y - p) ** 2).sum(axis=1)
    for v in ROOTS:  # no neighbour is nearer
        assert (((y - p - v) ** 2).sum(axis=1) >= d - 1e-9).all()
    assert len(ROOTS) == 240 and (decode(ROOTS + 0.01) == ROOTS).all()


def test_vectors_meet_as_often_as_said():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for c, least in ((0.9, 0.92), (0.95, 0.99)):
        a, b = cells(x), cells(c * x + np.sqrt(1 - c * c) * z)
        met = (a[0] == b[0]) | (a[1] == b[0][..., None]).any(axis=2) | (b[1] == a[0][..., None]).any(axis=2)
        assert met.any(axis=1).mean() > least


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    links, components, _ = brute(rows)
    got = op8_lattice_dedup(spark, sf).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (links[i], components[i], components[i] == i) for i in links}


@pytest.mark.parametrize("tile", [1024, 8])
def test_recall_and_precision(spark, tile):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for size in (120, 30, *[3] * 40, *[1] * 100):
        centre = rng.normal(size=64)
        for _ in range(size):
            rows.append((n, (centre + rng.normal(size=64) * rng.uniform(0, 0.36)).tolist(), 0, None, None))
            n += 1
    rows += [(n + k, rows[k][1], 1, None, None) for k in range(20)]
    links, components, pairs = brute([(r[0], r[1]) for r in rows])
    got = {r.vec_id: r for r in linked(spark.createDataFrame(rows, SCHEMA).repartition(3), tile=tile).collect()}
    assert len(pairs) > 5000
    assert sum(r.n_links for r in got.values()) >= 0.9 * 2 * len(pairs)
    assert all(got[i].n_links <= links[i] and got[i].kept == (got[i].component_id == i) for i in links)
    assert np.mean([got[i].component_id == components[i] for i in links]) > 0.97


def test_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0], 1, 1, 1), (3, [2.0, 0.0], 1, 1, 1), (9, [1.0, 0.0, 0.0], 1, 1, 1), (1, None, 1, 1, 1), (2, [], 1, 1, 1), (4, [0.0, 0.0], 1, 1, 1), (6, [1.0, None], 1, 1, 1), (7, [nan, 1.0], 1, 1, 1), (8, [inf, 1.0], 1, 1, 1), (10, [1.0, 0.0], 1, 1, 1), (10, [1.0, 0.0], 1, 1, 1), (11, [-1.0, -0.0], 1, 1, 1), (None, [1.0, 0.0], 1, 1, 1), (12, [1e300, 1e298], 1, 1, 1)]
    got = sorted(((r.vec_id or -1), r.n_links, r.component_id, r.kept) for r in linked(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, 0, None, None), (1, 0, 1, True), (2, 0, 2, True), (3, 4, 3, True), (4, 0, 4, True), (5, 4, 3, False), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 4, 3, False), (10, 4, 3, False), (11, 0, 11, True), (12, 4, 3, False)]
    assert linked(spark.createDataFrame([], SCHEMA)).count() == 0
