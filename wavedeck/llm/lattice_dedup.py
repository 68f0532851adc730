"""Near-duplicate vectors by E8 lattice hashing.

Each of TABLES tables projects a unit vector by its own random orthonormal rows to BLOCKS times eight
coordinates, scales them and decodes each eight to the nearest point of the E8 lattice; the points are the
vector's cell. A vector also probes the PROBES neighbouring cells that lie nearest. Vectors that meet in a
cell, at home or by a probe, are verified by cosine in double precision. Vectors at cosine 0.90 meet in some
table with probability 0.94 or more, at 0.95 with 0.997 (simulated; see README).

Equal vectors are one class before anything else and count as links by their number. A cell with many
vectors is cut into tiles by a hash; every two tiles meet in a task of their own, so nothing is capped. A pair is
counted where it meets first, in the order of tables, so that counts add up without emitting the pairs; links
leave a task as sums and as edges that connect the same vectors.

Vectors that are null, zero, or hold null or non-finite components link with nothing: they have no links and are
their own component. Vectors of different lengths link with nothing of the other length. Rows may repeat: each is a
vector of its own. Rows with a null id link with nothing and have null component and kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import stored
from .simhash_trie import _Groups

TABLES, BLOCKS, PROBES = 5, 2, 4
#: Side of a unit cell for vectors of 64 components.
SCALE = 0.3
#: Classes of one cell that meet in one task.
TILE = 1024


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = _roots()


def _even(y: np.ndarray) -> np.ndarray:
    """The nearest points with integer coordinates of even sum."""
    near = np.rint(y)
    off = y - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest E8 points of rows of eight coordinates."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    nearer = ((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


@lru_cache(maxsize=16)
def _tables(dim: int, tables: int, blocks: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out, wide = [], max(dim, 8 * blocks)
    for t in range(tables):
        rng = np.random.default_rng([seed, dim, t])
        rows = np.linalg.qr(rng.standard_normal((wide, 8 * blocks)))[0][:dim]
        odd = rng.integers(1, 1 << 63, size=8 * blocks, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        out.append((rows / (SCALE * (64 / wide) ** 0.5), odd))
    return out


def cells(unit: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, seed: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Home cells (n, tables) and probed cells (n, tables, probes) of unit vectors, as 64-bit hashes."""
    n = len(unit)
    homes, probed = np.zeros((n, tables), dtype=np.int64), np.zeros((n, tables, probes), dtype=np.int64)
    for t, (rows, odd) in enumerate(_tables(unit.shape[1], tables, blocks, seed)):
        y = unit @ rows
        home, near, delta = np.zeros(n, dtype=np.uint64), [], []
        for b in range(blocks):
            part, odds = y[:, 8 * b : 8 * b + 8], odd[8 * b : 8 * b + 8]
            point = decode(part)
            home += ((2 * point).astype(np.int64).view(np.uint64) * odds).sum(axis=1, dtype=np.uint64)
            near.append((part - point) @ ROOTS.T)
            delta.append(((2 * ROOTS).astype(np.int64).view(np.uint64) * odds).sum(axis=1, dtype=np.uint64))
        near, delta = np.concatenate(near, axis=1), np.concatenate(delta)
        best = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        homes[:, t] = home.view(np.int64)
        probed[:, t] = (home[:, None] + delta[best]).view(np.int64)
    return homes, probed


def _classes(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec binary (doubles; null where the vector links with nothing)."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1):
                x = v.values
                if x is None or not len(x) or x.null_count:
                    out.append(None)
                    continue
                x = x.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "vec"])

    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, f"id {kind}, vec binary")


def _unit(vecs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), dtype="<f8").reshape(len(vecs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(classes: DataFrame, tables: int, blocks: int, probes: int) -> DataFrame:
    """rep, n, vec, homes array<long>, probed array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(2).to_pylist()
            homes, probed = np.zeros((len(vecs), tables), np.int64), np.zeros((len(vecs), tables, probes), np.int64)
            sizes = np.array([len(v) for v in vecs])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                homes[at], probed[at] = cells(_unit([vecs[i] for i in at]), tables, blocks, probes)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a[0].size if len(a) else 1, dtype=np.int32)[: len(a) + 1]), pa.array(a.ravel())) for a in (homes, probed)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *lists], ["rep", "n", "vec", "homes", "probed"])

    return classes.select("rep", "n", "vec").mapInArrow(run, "rep long, n long, vec binary, homes array<long>, probed array<long>")


def _meet(rows: dict[str, np.ndarray], table: int, threshold: float, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one task: (rep, links) sums and (a, b) edges. rows: own, role, rep, n, unit, homes, probed."""
    own, role, rep, unit, homes = rows["own"], rows["role"], rows["rep"], rows["unit"], rows["homes"]
    probed = rows["probed"].reshape(len(rep), tables, -1)
    tiles = np.unique(own)
    sides = [(own == tiles[0], own == tiles[0])] if rows["x"] == rows["y"] else [(own == a, own == b) for a, b in ((rows["x"], rows["y"]), (rows["y"], rows["x"]))]
    pairs = []
    for left, right in sides:
        q, h = np.flatnonzero(left), np.flatnonzero(right & (role == 0))
        for at in range(0, len(q), 1024):
            part = q[at : at + 1024]
            i, j = np.nonzero(unit[part] @ unit[h].T >= threshold)
            i, j = part[i], h[j]
            keep = (rep[i] < rep[j]) | ((role[i] == 1) & (rep[i] != rep[j]))
            pairs.append((i[keep], j[keep]))
    i, j = (np.concatenate(x) for x in zip(*pairs))
    kept_i, kept_j = [], []
    for at in range(0, len(i), 200_000):
        a, b = i[at : at + 200_000], j[at : at + 200_000]
        low, high = np.where(rep[a] < rep[b], a, b), np.where(rep[a] < rep[b], b, a)
        met = np.zeros(len(a), dtype=bool)
        for t in range(table):
            met |= homes[low, t] == homes[high, t]
            met |= (probed[low, t] == homes[high, t][:, None]).any(axis=1) | (probed[high, t] == homes[low, t][:, None]).any(axis=1)
        # the larger one's probe comes last in a table
        met |= (role[a] == 1) & (a == high) & (probed[low, table] == homes[high, table][:, None]).any(axis=1)
        kept_i.append(low[~met])
        kept_j.append(high[~met])
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (kept_i, kept_j))
    # a vector may have several rows here: count and connect by its first
    ids, of = np.unique(rep, return_inverse=True)
    i, j = of[i], of[j]
    n = np.zeros(len(ids), dtype=np.int64)
    n[of] = rows["n"]
    links = np.zeros(len(ids), dtype=np.int64)
    np.add.at(links, i, n[j])
    np.add.at(links, j, n[i])
    groups, edges = _Groups(len(ids)), np.zeros((0, 2), dtype=np.int64)
    a, b = i, j
    while len(a):  # a spanning forest: each round links one edge between any two groups
        x, y = groups.roots(a), groups.roots(b)
        fresh = x != y
        a, b, x, y = a[fresh], b[fresh], x[fresh], y[fresh]
        if not len(a):
            break
        first = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1, return_index=True)[1]
        edges = np.concatenate([edges, np.stack([ids[a[first]], ids[b[first]]], axis=1)])
        groups.link(a[first], b[first])
    on = links > 0
    return ids[on], links[on], edges[:, 0], edges[:, 1]


def linked(vectors: DataFrame, threshold: float = 0.9, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, tile: int = TILE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: id_col, n_links (other vectors at `threshold` or above that were found),
    component_id (smallest id reachable by links, its own included), kept (whether that is its own id)."""
    rows = stored(_classes(vectors, id_col, vec_col), "vectors")
    usable = rows.where("id is not null and vec is not null")
    classes = stored(usable.groupBy("vec").agg(F.min("id").cast("long").alias("rep"), F.count("*").alias("n")), "vector-classes")
    hashed = stored(_hashed(classes, tables, blocks, probes), "vector-cells")
    home = F.transform("homes", lambda c, t: F.struct(t.cast("int").alias("t"), c.alias("cell"), F.lit(0).alias("role")))
    probe = F.transform("probed", lambda c, k: F.struct((k / probes).cast("int").alias("t"), c.alias("cell"), F.lit(1).alias("role")))
    size = F.octet_length("vec").alias("dim")
    keyed = hashed.select("rep", size, F.explode(F.concat(home, probe)).alias("k")).select("rep", "dim", "k.t", "k.cell", "k.role")
    sizes = keyed.groupBy("dim", "t", "cell").agg(F.count("*").alias("m"), F.min("role").alias("role")).where("m > 1 and role = 0").select("dim", "t", "cell", F.ceil(F.col("m") / tile).cast("int").alias("tiles"))
    tiled = keyed.join(sizes, ["dim", "t", "cell"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y")))
    tasks = tiled.select("rep", "t", "cell", "role", "own", F.explode(meets).alias("m")).select("rep", "t", "cell", "role", "own", "m.x", "m.y")
    keys = ["t", "dim", "cell", "x", "y"]
    full = tasks.join(hashed, "rep").withColumn("dim", size)
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = full.repartition(parts, *keys).sortWithinPartitions(*keys).select(*keys, "own", "role", "rep", "n", "vec", "homes", "probed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: pa.Table) -> pa.RecordBatch | None:
            if table.num_rows < 2:
                return None
            col = lambda c: table.column(c).combine_chunks()
            got = {c: col(c).to_numpy() for c in ("own", "role", "rep", "n")} | {"unit": _unit(col("vec").to_pylist()), "x": col("x")[0].as_py(), "y": col("y")[0].as_py()}
            got |= {c: np.array(col(c).flatten()).reshape(table.num_rows, -1) for c in ("homes", "probed")}
            if not (got["role"] == 0).any():
                return None
            ids, links, a, b = _meet(got, col("t")[0].as_py(), threshold, tables)
            none = pa.nulls(len(ids), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids, a])), pa.concat_arrays([none, pa.array(b, pa.int64())]), pa.concat_arrays([pa.array(links, pa.int64()), pa.nulls(len(a), pa.int64())])], ["a", "b", "links"])

        waiting: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in keys])
            ends = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(ends, ends[1:]):
                if a == b:
                    continue
                this = tuple(key[:, a].tolist())
                if this != last and waiting:
                    if (made := out(pa.Table.from_batches(waiting))) is not None:
                        yield made
                    waiting = []
                waiting.append(batch.slice(a, b - a))
                last = this
        if waiting and (made := out(pa.Table.from_batches(waiting))) is not None:
            yield made

    found = stored(dealt.mapInArrow(run, "a long, b long, links long"), "vector-links")
    links = found.where("links is not null").groupBy("a").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("b is not null").select("a", "b"))
    named = classes.join(links, classes["rep"] == links["a"], "left").join(groups, classes["rep"] == groups["node"], "left")
    named = named.select("vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    usable = usable.join(named, "vec", "left").select("id", "links", "component")
    rest = rows.where("id is null or vec is null").select("id", F.lit(0).cast("long").alias("links"), F.col("id").cast("long").alias("component"))
    return usable.unionByName(rest).select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
