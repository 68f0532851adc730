"""SimHash fingerprints and their near-duplicate groups by a binary trie self-join.

Fingerprint: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, shingles of n words joined by blanks, repeats
included (fewer words: all of them; none: fingerprint zero). A bit is 1 if over half of the shingles' XXH64
(UTF-8, seed 42) have it.

Self-join: fingerprints within `budget` bits agree on at least g of budget + g blocks of bits, so each
distinct fingerprint goes to tables keyed by g blocks' values; g grows with the number of fingerprints. A key's fingerprints form a binary
trie; pairs of its nodes are traversed together from (root, root), their differing bits accumulate, and a
pair is pruned once they exceed the budget or both sides are known to be one group already. Keys with very
many fingerprints are cut into tiles by a hash and every two tiles meet in a task of their own, so a hot key
is neither one task nor dropped. Copies of one fingerprint are joined by their fingerprint, not as pairs.

Null and empty texts have fingerprint zero and are linked like any other. Rows with a null id have a
fingerprint, don't link and get a null component. Rows may repeat. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import ask, bucket_count, delta, make_blocks, pack, release, undelta, unpack, with_answers
from .components import connected_components
from .exchange import Keyed, exchange, keyed, levels
from .scratch import passing, release_shuffles, stored

#: Fingerprints of one key that meet in one task.
TILE = 2048
#: Bytes of text whose shingles are counted at once.
SHINGLE_BYTES = 8 << 20
#: Texts whose shingles are held at once.
TEXTS = 512
#: Documents of a shingle that all meet at once.
FEW = 32
#: Bits of a sketch of a set of shingles.
SKETCH = 512
_BITS = [f"bits_{k}" for k in range(SKETCH // 64)]
#: Ids up to which a set of them is sent to where the texts lie; beyond, texts and ids meet by a shuffle.
MOST_IDS = 4_000_000


def _hashes(text: str, n: int) -> list[int]:
    words = text.encode().lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return [digest(joined, 42)]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    stops = np.cumsum(sizes)
    starts = (stops - sizes)[: len(words) - n + 1].tolist()
    return [digest(joined[a:b], 42) for a, b in zip(starts, (stops[n - 1 :] - 1).tolist())]


def fingerprint(text: str | None, n: int = 4) -> int:
    return _fingerprint(np.array(_hashes(text or "", n), dtype="<u8"))


def _fingerprint(hashes: np.ndarray) -> int:
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # very long texts in bounded memory
        total += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, fp long (the 64 bits)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), n) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class _Groups:
    """Union-find over the fingerprints of a task."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.up[i]
        while True:
            s = self.up[r]
            if (s == r).all():
                return r
            r = s

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            keep = a != b
            a, b = a[keep], b[keep]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.up, high, low)


def trie_join(left: np.ndarray, right: np.ndarray | None, budget: int, leaf: int = 64, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (value, value) that connect whatever fingerprints within budget bits connect: left with itself,
    or left with right. Arrays of distinct unsigned 64-bit values.

    A node is a range of the sorted values with a common prefix: no other form of the trie is stored. Frontiers
    of node pairs are bounded: above `most` pairs they are worked off in parts, depth first."""
    own = right is None
    left = np.sort(left)
    right = left if own else np.sort(right)
    values = left if own else np.concatenate([left, right])
    shift = 0 if own else len(left)
    groups = _Groups(len(values))
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def cut(v: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """The first place of each range whose bit is set."""
        prefix = v[low] & ~((np.uint64(2) << bit) - np.uint64(1)) | (np.uint64(1) << bit)
        return np.clip(np.searchsorted(v, prefix), low, high)

    stack = [tuple(np.array([x]) for x in (0, len(left), 0, len(right), 63, 0))]
    if not len(left) or not len(right):
        stack = []
    while stack:
        la, lb, ra, rb, bit, spent = stack.pop()
        if len(la) > most:
            for k in range(0, len(la), most):
                stack.append(tuple(x[k : k + most] for x in (la, lb, ra, rb, bit, spent)))
            continue
        sizes = (lb - la) * (rb - ra)
        done = (sizes <= leaf * leaf) | (bit < 0)
        if done.any():
            a, b, c, n = la[done], lb[done] - la[done], ra[done], sizes[done]
            width = (rb - ra)[done]
            for k in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // (1 << 20))) + 1):
                total = int(n[k].sum())
                at = np.arange(total) - np.repeat(np.cumsum(n[k]) - n[k], n[k])
                wide = np.repeat(width[k], n[k])
                i, j = np.repeat(a[k], n[k]) + at // wide, np.repeat(c[k], n[k]) + at % wide
                near = _popcount(left[i] ^ right[j]) <= budget
                i, j = i[near], j[near]
                if own:
                    i, j = i[i < j], j[i < j]
                fresh = groups.roots(i) != groups.roots(j + shift)
                i, j = i[fresh], j[fresh]
                if len(i):
                    pairs = np.unique(np.stack([groups.roots(i), groups.roots(j + shift)]), axis=1, return_index=True)[1]
                    found.append((left[i[pairs]], right[j[pairs]]))
                    groups.link(i, j + shift)
        la, lb, ra, rb, bit, spent = (x[~done] for x in (la, lb, ra, rb, bit, spent))
        if not len(la):
            continue
        ub = bit.astype(np.uint64)
        lm, rm = cut(left, la, lb, ub), cut(right, ra, rb, ub)
        parts = []
        for x, y, extra in ((0, 0, 0), (1, 1, 0), (0, 1, 1), (1, 0, 1)):
            a, b = (la, lm) if not x else (lm, lb)
            c, d = (ra, rm) if not y else (rm, rb)
            keep = (a < b) & (c < d) & (spent + extra <= budget)
            if own:
                keep &= (a <= c)  # the mirrored pair of nodes is the same pair
            parts.append((a[keep], b[keep], c[keep], d[keep], bit[keep] - 1, spent[keep] + extra))
        merged = [np.concatenate(x) for x in zip(*parts)]
        # both nodes one group already: nothing more to learn
        one = groups.roots(merged[0]) == groups.roots(merged[2] + shift)
        if one.any():
            ends = one & (groups.roots(merged[1] - 1) == groups.roots(merged[3] - 1 + shift))
            same = _spans_one(groups, merged[0], merged[1], ends) & _spans_one(groups, merged[2] + shift, merged[3] + shift, ends)
            merged = [x[~same] for x in merged]
        if len(merged[0]):
            stack.append(tuple(merged))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _spans_one(groups: _Groups, low: np.ndarray, high: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """Whether all of [low, high) is one group, where asked."""
    root = groups.roots(np.arange(len(groups.up)))
    changes = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
    return ask & (changes[np.minimum(high, len(root)) - 1] == changes[np.minimum(low, len(root) - 1)])


def agreeing(n: int, budget: int, tile: int = TILE) -> int:
    """How many blocks of bits a key takes for n fingerprints: so many that a key of evenly spread ones has a tile of them."""
    g = 1
    while g < 8 and n >> (64 * g // (budget + g)) > tile:
        g += 1
    return g


def linked_fingerprints(fps: DataFrame, budget: int = 4, tile: int = TILE, together: int | None = None) -> DataFrame:
    """fps(fp long, distinct, not null) -> edges (a, b) that connect all fingerprints within budget bits.

    With budget + g blocks of bits, two such fingerprints agree on g blocks at least: each goes to a table for every g of them,
    keyed by their bits. g (together) follows the number of fingerprints, so keys don't fill up as that grows: five tables up to
    about 16 million, 15 to four billion, 35 beyond, for a budget of four."""
    g = together or agreeing(fps.count(), budget, tile)
    cuts = [64 * i // (budget + g) for i in range(budget + g + 1)]
    bits = [(F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)), b - a) for a, b in zip(cuts, cuts[1:])]
    blocks = []
    for some in combinations(bits, g):
        key = F.lit(0).cast("long")
        for x, wide in some:
            key = F.shiftleft(key, wide).bitwiseOR(x)
        blocks.append(key)
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), x.alias("block")) for t, x in enumerate(blocks)))).alias("k")).select("fp", "k.t", "k.block")
    sizes = keyed.groupBy("t", "block").agg(F.count("*").alias("n")).where("n > 1").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    tiled = keyed.join(sizes, ["t", "block"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    # task (x, y), x <= y: tile x with tile y
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y")))
    tasks = tiled.select("fp", "t", "block", "own", F.explode(meets).alias("m")).select("fp", "t", "block", "own", "m.x", "m.y")
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = tasks.repartition(parts, "t", "block", "x", "y").sortWithinPartitions("t", "block", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def join(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            x, y, own, fp = rows[2][0], rows[3][0], rows[4], rows[5].view(np.uint64)
            return trie_join(fp, None, budget) if x == y else trie_join(fp[own == x], fp[own == y], budget)

        rest = np.zeros((6, 0), dtype=np.int64)
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("t", "block", "x", "y", "own", "fp")])
            rows = np.concatenate([rest, rows], axis=1)
            ends = np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0)) + 1
            last = ends[-1] if len(ends) else 0
            rest = rows[:, last:]
            out = [join(rows[:, a:b]) for a, b in zip([0, *ends[:-1]], ends) if b - a > 1]
            if out:
                yield _edges(out)
        if rest.shape[1] > 1:
            yield _edges([join(rest)])

    return dealt.select("t", "block", "x", "y", "own", "fp").mapInArrow(run, "a long, b long")


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def near_duplicates(docs: DataFrame, n: int = 4, budget: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, fp long, component_id (smallest id reachable by links, its own included)."""
    return grouped(stored(fingerprints(docs, n, id_col, text_col), "fingerprints"), budget, id_col)


def grouped(marked: DataFrame, budget: int, id_col: str = "id") -> DataFrame:
    """marked(id_col, fp) with component_id, by links of fingerprints within budget bits."""
    classes = stored(marked.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("first")), "classes")
    groups = connected_components(linked_fingerprints(classes.select("fp"), budget))
    named = classes.join(groups, classes["fp"] == groups["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    table = named.join(firsts, "component").select("fp", "component_id")
    out = marked.join(table, "fp", "left")
    return out.select(id_col, "fp", F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))


def _shingles(text: str | None, n: int) -> np.ndarray:
    return np.unique(np.array(_hashes(text or "", n), dtype=np.uint64).view(np.int64))


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """Which of SKETCH bits an odd number of distinct hashes fall on, 64 to a number. Two sets' sketches differ in as many bits as the
    sets in hashes, or in fewer."""
    odd = np.bincount(shingles & (SKETCH - 1), minlength=SKETCH).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def _apart(similarity: float) -> float:
    """Two sets at `similarity` differ in no more than this share of the sum of their sizes."""
    return (1 - similarity) / (1 + similarity)


def _keys(shingles: np.ndarray, buckets: int) -> np.ndarray:
    """As many of the hashes' high bits as tell a bucket's shingles apart. Shingles of one key count as one; what they are
    compared by are the whole hashes."""
    bits = np.uint64(64 - min(64, 34 + buckets.bit_length()))
    return shingles.view(np.uint64) >> bits << bits


def _weights(question: Keyed) -> tuple[bytes, None, list[int]]:
    """How many texts have each shingle: itself up to 128, beyond that its logarithm."""
    (n,) = question.numbers
    return pack(np.where(n <= 128, n, np.minimum(128 + 4 * np.log2(np.maximum(n, 128) / 128), 255)).astype(np.uint8)), None, []


def _postings(texts: DataFrame, n: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """texts(id, text) -> by prefix shingles: pairs (a, b), a < b, of the documents of a shingle that FEW or fewer have, and the
    rows (token, id, size, pos and the sketch) of the others.

    A prefix are the first of a document's distinct shingles in one order for all documents, so many that two sets at
    `similarity` share one of them: by the number of texts that have them, then by hash. All shingles of all texts are counted,
    through the exchange; those that one text alone has meet nothing and aren't rows. Rows meet by shingle, except that those of a
    shingle that more than FEW texts have aren't paired there at all, so that one of very many documents isn't one task."""
    spark = texts.sparkSession
    with passing(spark):
        blocks = make_blocks(texts.select("id", "text"), 1, "shingles", SHINGLE_BYTES)
        buckets, m = bucket_count(blocks), blocks.count()
        ranges, few = levels(buckets)[0], FEW

        def sets(table: pa.Table) -> list[np.ndarray]:
            return [_shingles(t.as_py(), n) for t in table.column(1)]

        def counts(_: int, table: pa.Table) -> Iterator[tuple[int, bytes]]:
            keys, number = np.unique(_keys(np.concatenate([np.zeros(0, np.int64), *sets(table)]), buckets), return_counts=True)
            return keyed(keys, [number], ranges)

        weights, _ = exchange(ask(blocks, counts), m, buckets, Keyed, _weights, "shingle-counts")

        def prefixes(_: int, table: pa.Table, answers: pa.Table) -> pa.Table:
            every = sets(table)
            keys = _keys(np.concatenate([np.zeros(0, np.int64), *every]), buckets)
            told = np.concatenate([np.zeros(0, np.uint8), *(unpack(d)[0] for d in answers.sort_by("bucket").column("data").to_pylist())])
            weight = told[np.unique(keys, return_inverse=True)[1]]
            none = np.zeros(0, np.int64)
            rows, at = [(none, none, none.astype(np.int32), none.astype(np.int32), none.astype(bool), *[none] * len(_BITS))], 0
            for i, own in zip(table.column(0).to_pylist(), every):
                w, at = weight[at : at + len(own)], at + len(own)
                first = np.lexsort((own, w))[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1]
                pos = np.flatnonzero(w[first] > 1).astype(np.int32)
                token, sure = own[first[pos]], w[first[pos]] > few
                if not len(own):  # texts without words are alike
                    token, pos, sure = np.zeros(1, np.int64), np.zeros(1, np.int32), np.zeros(1, bool)
                rows.append((token, np.full(len(token), i), np.full(len(token), len(own), np.int32), pos, sure, *(np.full(len(token), x) for x in _sketch(own))))
            return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows)], ["token", "id", "size", "pos", "sure", *_BITS])

        bits = "".join(f", {x} long" for x in _BITS)
        every = with_answers(blocks, weights, prefixes, f"token long, id long, size int, pos int, sure boolean{bits}")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        dealt = every.repartition(parts, F.when(F.col("sure"), F.xxhash64("token", "id")).otherwise(F.col("token"))).sortWithinPartitions("token")
        found = stored(dealt.mapInArrow(_paired(similarity), f"a long, b long, token long, size int, pos int{bits}"), "postings", lasting=True)
    return found.where("token is null").select("a", "b").distinct(), found.where("token is not null").select("token", F.col("a").alias("id"), "size", "pos", *_BITS)


def _paired(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by token -> (a, b) of the pairs of tokens with two to FEW rows; of tokens with more, and of those that are
    sure, the rows, as a, token, size, pos and the sketch. At most FEW rows wait for the next batch."""

    def pairs(rows: list[np.ndarray], start: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        """Of groups of rows: all pairs that can be at `similarity`, by sizes, places and sketches."""
        _, ids, size, pos, _, *bits = rows
        earlier = _steps(count)  # a row meets those before it in its group
        j = np.repeat(np.repeat(start, count) + earlier, earlier)
        i = np.repeat(np.repeat(start, count), earlier) + _steps(earlier)
        bound = np.minimum(pos[i], pos[j]) + np.minimum(size[i] - pos[i], size[j] - pos[j])
        near = (ids[i] != ids[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-6) & ((1 + similarity) * bound >= similarity * (size[i].astype(np.int64) + size[j]) - 1e-6)
        i, j = i[near], j[near]
        differ = sum((_popcount((x[i] ^ x[j]).view(np.uint64)) for x in bits), np.zeros(len(i), np.int64))
        near = differ <= _apart(similarity) * (size[i].astype(np.int64) + size[j]) + 1e-6
        made = np.unique(np.sort(np.stack([ids[i[near]], ids[j[near]]]), axis=0), axis=1)
        none, wide = pa.nulls(made.shape[1], pa.int32()), pa.nulls(made.shape[1], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), wide, none, none, *[wide] * len(bits)], names)

    def whole(rows: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[1]), pa.nulls(len(rows[0]), pa.int64()), *(pa.array(rows[k]) for k in (0, 2, 3)), *map(pa.array, rows[5:])], names)

    names = ["a", "b", "token", "size", "pos", *_BITS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        many = None  # a token that has had more than FEW rows
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            yield whole([x[rows[4]] for x in rows])
            rows = [np.concatenate([a, b[~rows[4]]]) for a, b in zip(held, rows)] if held else [x[~rows[4]] for x in rows]
            token = rows[0]
            if not len(token):
                held = rows
                continue
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            count = np.diff(np.append(start, len(token)))
            over = count > FEW
            if many is not None:
                over[0] |= token[0] == many
            last = len(count) - 1  # may go on in the next batch
            goes = np.repeat(over, count)
            yield whole([x[goes] for x in rows])
            some = ~over
            some[last] = False
            for part in np.split(np.flatnonzero(some), np.flatnonzero(np.diff(np.cumsum(count[some] ** 2) >> 20)) + 1):
                yield pairs(rows, start[part], count[part])
            many = token[-1] if over[last] else None
            held = [x[len(token) - count[last] :] if not over[last] else x[:0] for x in rows]
        if held and len(held[0]):
            yield pairs(held, np.zeros(1, np.int64), np.array([len(held[0])]))
        release()

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def _steps(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, 0 .. n[1] - 1, ..."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _first_of(tokens: DataFrame, heads: int) -> DataFrame:
    """token, id, size, pos, the sketch, m: of each token the `heads` rows with the smallest ids, all of one with FEW rows or less.
    The rows of a token with very many are first ranked in parts."""
    many = tokens.groupBy("token").agg(F.count("*").alias("m"))
    counted = tokens.join(many, "token").withColumn("most", F.when(F.col("m") <= FEW, F.col("m")).otherwise(heads)).withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / TILE)))
    for w in (W.partitionBy("token", "part").orderBy("id"), W.partitionBy("token").orderBy("id")):
        counted = counted.withColumn("rank", F.row_number().over(w)).where("rank <= most")
    return counted.select("token", "id", "size", "pos", *_BITS, "m")


def _met(tokens: DataFrame, first: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of a token's first documents with its others, without those that can't be at
    `similarity` by their sizes, the token's places and their sketches. A join, so that a token of very many documents is split. The
    sketches leave about as many rows as there are near copies: documents that share a passage or are edited more differ in them."""
    x, y = first.alias("x"), tokens.alias("y")
    sizes, places = ("x.size", "y.size"), ("x.pos", "y.pos")
    bound = F.least(*places) + F.least(F.col("x.size") - F.col("x.pos"), F.col("y.size") - F.col("y.pos"))
    near = (F.least(*sizes) >= similarity * F.greatest(*sizes) - 1e-6) & ((1 + similarity) * bound >= similarity * (F.col("x.size") + F.col("y.size")) - 1e-6)
    differ = reduce(add, (F.bit_count(F.col(f"x.{k}").bitwiseXOR(F.col(f"y.{k}"))) for k in _BITS))
    near &= differ <= _apart(similarity) * (F.col("x.size") + F.col("y.size")) + 1e-6
    return x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id")) & near).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _packed(shingles: np.ndarray) -> bytes:
    """Of a set of 64-bit hashes 40 bits each, sorted: two of one text's have them alike with probability 1e-8 or so."""
    return pack(delta(np.unique(shingles.view(np.uint64) >> np.uint64(24))))


def _alike(pairs: DataFrame, texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts' shingles are at `similarity`; texts: (id, text), of which an id's rows together are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_packed(_shingles(t.as_py(), n)) for t in batch.column(1)], pa.binary())], ["id", "shingles"])
        release()

    ids = stored(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct(), "asked")
    sets = stored(_with_ids(texts, ids, "left_semi").select("id", "text").mapInArrow(run, "id long, shingles binary").distinct(), "shingles")
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b").select("a", "b", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                (x,), (y,) = unpack(x.as_py()), unpack(y.as_py())
                both = len(np.intersect1d(undelta(x), undelta(y), assume_unique=True))
                either = len(x) + len(y) - both
                keep.append(either == 0 or both / either >= similarity)
            keep = np.array(keep, dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])
        release()

    return met.mapInArrow(compare, "a long, b long").distinct()


def without_near_duplicates(docs: DataFrame, n: int = 5, similarity: float = 0.8, budget: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the near copies; ids are whole numbers. Two passes, each by ascending id: a document stays unless its
    n-word shingles are at `similarity` (Jaccard) or above to those of a smaller one that stays.

    First within the groups that the trie self-join makes of n-word fingerprints within `budget` bits. Near copies at
    0.8 differ by ten of 64 bits on average, more than any trie prunes by, so the documents that the first pass keeps
    then meet by shingles: two sets at `similarity` share one of their first shingles in any order that is the same for
    all documents. No two documents that stay are at `similarity`. Of copies of one text the smallest id is asked. Rows
    without an id stay; rows that share an id stay or go together, and go if one of them does. Texts without words are alike. An empty table gives
    no rows.
    """
    with passing(docs.sparkSession):
        ids = stored(_near_copies(docs, n, similarity, budget, id_col, text_col), "gone", lasting=True)
    return _with_ids(docs, ids.withColumnRenamed("id", "_gone"), "left_anti", docs[id_col] == F.col("_gone"))


def _near_copies(docs: DataFrame, n: int, similarity: float, budget: int, id_col: str, text_col: str) -> DataFrame:
    """The ids that go."""
    every = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    marked = stored(_marked(every, n), "marked")
    named = marked.select("id", "sha").distinct()
    copies = named.groupBy("sha").agg(F.min("id").alias("first"))
    again = stored(named.join(copies.hint("merge"), "sha").where("id <> first").select("id").distinct(), "again")
    asked = marked.select("id", "fp").distinct().join(again.hint("merge"), "id", "left_anti")
    groups = stored(grouped(asked, budget).select("component_id", "id").distinct(), "groups")
    several = groups.groupBy("component_id").agg(F.count("*").alias("m")).where("m > 1").select("component_id")
    sizes = marked.select("id", "size", *_BITS).distinct()
    of_groups = groups.join(several.hint("merge"), "component_id").join(sizes.hint("merge"), "id").select(F.col("component_id").alias("token"), "id", "size", F.lit(0).alias("pos"), *_BITS)
    near = stored(_thinned(None, of_groups, every, n, similarity), "gone")
    out = stored(again.unionByName(near).distinct(), "gone")
    release_shuffles(docs.sparkSession)
    left = _with_ids(every, out, "left_anti")
    later = _thinned(*_postings(left, n, similarity), left, n, similarity)
    return out.unionByName(later).distinct()


def _marked(texts: DataFrame, n: int) -> DataFrame:
    """texts(id, text) -> id, sha (of the text), fp, size (distinct shingles) and their sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            fps, sizes, sketches = [], [], []
            for t in batch.column(1):
                hashes = np.array(_hashes(t.as_py(), n), dtype="<u8")
                own = np.unique(hashes.view(np.int64))
                fps.append(_fingerprint(hashes))
                sizes.append(len(own))
                sketches.append(_sketch(own))
            bits = np.array(sketches).reshape(-1, len(_BITS)).T
            columns = [batch.column(0), batch.column(2), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), *(pa.array(np.ascontiguousarray(x)) for x in bits)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "sha", "fp", "size", *_BITS])
        release()

    schema = "id long, sha binary, fp long, size int" + "".join(f", {x} long" for x in _BITS)
    return texts.select("id", "text", F.unhex(F.sha2("text", 256)).alias("sha")).mapInArrow(run, schema)


def _with_ids(rows: DataFrame, ids: DataFrame, how: str, on: Column | str = "id") -> DataFrame:
    """rows joined to distinct ids, left_semi or left_anti."""
    return rows.join(F.broadcast(ids) if ids.limit(MOST_IDS + 1).count() <= MOST_IDS else ids.hint("merge"), on, how)


def _thinned(pairs: DataFrame | None, tokens: DataFrame, texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """The ids that go, of documents that are pairs (a, b) or share tokens(token, id, size, pos and the sketch).

    A round decides documents by their pairs; of a token of very many documents those with the smallest ids
    meet the others, 16 times as many in each round, and rounds go on until all are decided. A document goes only
    for one that stays and that it was compared with.
    """
    tokens = stored(tokens, "postings")
    edges = stored(_alike(stored(pairs, "pairs"), texts, n, similarity), "alike") if pairs is not None else None
    gone, heads = texts.select("id").limit(0), 1
    while tokens.limit(1).count():
        first = stored(_first_of(tokens, heads), "first")
        more = _alike(stored(_met(tokens, first, similarity), "pairs"), texts, n, similarity)
        edges = stored(more if edges is None else edges.unionByName(more).distinct(), "alike")
        # a document beyond the heads of one of its tokens hasn't met all smaller ones
        ends = first.where(F.col("m") > FEW).groupBy("token").agg(F.max("id").alias("end"))
        waits = stored(tokens.join(ends, "token").where("id > end").select("id").distinct(), "waits")
        lost, edges = _decided(edges, waits)
        gone = gone.unionByName(lost)
        undecided = waits.join(lost, "id", "left_anti").unionByName(edges.select(F.col("b").alias("id")))
        tokens = stored(tokens.join(undecided.distinct(), "id", "left_semi"), "postings")
        heads *= 16
    return gone.unionByName(_decided(edges, gone.limit(0))[0]) if edges is not None else gone


def _decided(edges: DataFrame, waits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What goes (id), by edges (a, b), a < b, of alike documents, and the edges of those that are left undecided, as they
    wait or depend on one that does."""
    lost = waits.select("id").limit(0)
    while True:
        free = edges.select(F.col("a").alias("id")).distinct().join(waits, "id", "left_anti").join(edges.select(F.col("b").alias("id")), "id", "left_anti")
        fresh = stored(edges.join(free.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct(), "lost")
        if not fresh.limit(1).count():
            return lost, edges
        lost = lost.unionByName(fresh)
        edges = stored(edges.join(fresh.withColumnRenamed("id", "a"), "a", "left_anti").join(fresh.withColumnRenamed("id", "b"), "b", "left_anti"), "alike")
