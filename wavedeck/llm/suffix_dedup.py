"""Removal of passages that an earlier document has, by a collection suffix index built column-wise.

A passage is any string of `least` bytes. To bring equal passages together without sorting all suffixes in one
place, every passage is assigned to its anchor: of its K-byte substrings the one with the smallest hash. Equal
passages have equal anchors. First, buckets of anchors tell blocks which of their anchors occur in more than
one document. Then the maximal stretches whose passages share such an anchor go, distinct within their block and with
their smallest document id, to the anchor's bucket. An anchor with very many occurrences isn't kept in one
bucket: its passages go one by one to the bucket of their own hash.

In a bucket the stretches are a collection of short documents. Its Burrows-Wheeler transform and common
prefixes are built column-wise (Bauer, Cox, Rosone, 2013; Cox and others, 2016): every round inserts one
symbol (five bytes, on a grid that the anchor lays, where five divides `least`) of each document, from the right, at the place that the symbols before it give, by
sequential passes that read the old streams and write the new ones, in files of the shared folder. Where the common prefix
is `least` or more, passages are equal, and the smallest id of each run of equal ones goes back to the blocks.

Null texts are empty. Rows with a null id lose nothing and take nothing away. Of repeated rows with one id none takes
from another. An empty table gives no rows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ASKS, ask, batch_of, bucket_count, delta, make_blocks, pack, undelta, unpack, with_answers
from .exchange import Keyed, exchange, keyed, levels, parts_of, slim
from .scratch import shared_dir

#: Bytes of a passage that is removed, and of its anchor.
LEAST, ANCHOR = 50, 20
#: From so many occurrences of a context on, its passages go to buckets of their own hash.
HOT = 1000
#: Suffixes of a chunk of an index's streams, and bytes of a symbol at most.
PIECE, WIDEST = 1 << 16, 5
#: Places that are hashed at once.
CHUNK = 1 << 17

_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_hashes(data: np.ndarray, *widths: int) -> list[np.ndarray]:
    """Of each width a 64-bit hash of each so many bytes, all by the same doublings."""
    with np.errstate(over="ignore"):
        part, n, power = data.astype(np.uint64) + np.uint64(1), 1, np.array([_MUL])
        out: list[np.ndarray | None] = [None] * len(widths)
        have = [0] * len(widths)
        while n <= max(widths):
            for i, k in enumerate(widths):
                if k & n:
                    if out[i] is None:
                        out[i] = part
                    else:
                        m = max(len(part) - have[i], 0)
                        out[i] = out[i][:m] * power[0] + part[have[i] : have[i] + m]
                    have[i] += n
            if 2 * n <= max(widths):
                m = max(len(part) - n, 0)
                part = part[:m] * power[0] + part[n : n + m]
                power = power * power
            n *= 2
        return [_mix(x) for x in out]


def _lowest(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest of each `width` hashes, the first of equal ones."""
    part, n = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * n <= width:
        m = max(len(part) - n, 0)
        part, n = np.minimum(part[:m], part[n : n + m]), 2 * n
    m = max(len(h) - width + 1, 0)  # two windows of n cover one of width
    return (np.minimum(part[:m], part[width - n : width - n + m]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Block:
    """The texts of a block on end, and the runs of passages that share an anchor's place."""

    def __init__(self, rows: pa.Table, id_at: int, text_at: int, least: int, k: int):
        ids = rows.column(id_at).combine_chunks()
        known = ~np.array(ids.is_null())
        self.ids = np.array(ids.fill_null(0)).astype(np.int64)
        texts = [(t.as_py() or "").encode() for t in rows.column(text_at)]
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = b"".join(texts)
        del texts
        self.data = np.frombuffer(self.raw, dtype=np.uint8)
        self.least, self.wide = least, (least - k) // 2
        none = np.zeros(0, np.int64), np.zeros(0, np.int16), np.zeros(0, np.uint64)
        found: list[tuple[np.ndarray, ...]] = [(*none[:1], *none[1:2] * 3, *none[2:] * 3)]
        # chunk by chunk, so that the arrays stay in the cache; a run that a chunk's end cuts is two runs
        for at in range(0, len(self.data) - least + 1, CHUNK):
            part = self.data[at : at + CHUNK + least - 1]
            h, context = window_hashes(part, k, k + self.wide)
            low = _lowest(h, least - k + 1)  # of the passage that starts at each place
            first, last = np.searchsorted(self.starts, [at, at + len(low) - 1], side="right") - 1
            ends = (self.starts + self.sizes)[first : last + 1] - at
            begins = np.maximum(self.starts[first : last + 1] - at, 0)
            inside = np.zeros(len(low), dtype=bool)
            new = np.ones(len(low) + 1, dtype=bool)
            new[1:-1] = low[1:] != low[:-1]
            for x, y, on in zip(begins.tolist(), ends.tolist(), known[first : last + 1].tolist()):
                if on and y - least >= x:
                    inside[x : y - least + 1] = True
                    new[x] = True
                    new[min(y - least + 1, len(low))] = True
            edges = np.flatnonzero(new)
            start = edges[:-1]
            size = np.diff(edges)
            on = inside[start]
            start, size = start[on], size[on]
            anchor = low[start]
            # passages up to `before` have the context to the anchor's left, the others that to its right
            border = anchor - self.wide - start + 1
            before = np.clip(border, 0, size)
            top = len(context) - 1
            left, right = context[np.clip(anchor - self.wide, 0, top)], ~context[np.minimum(anchor, top)]
            small = (x.astype(np.int16) for x in (size, before, border % symbol_width(least)))  # a run is shorter than a stretch
            found.append((start + at, *small, h[anchor], left, right))
        columns = [list(x) for x in zip(*found)]
        del found
        for name, i in zip(("run_start", "run_len", "run_before", "grid", "run_hash", "left", "right"), range(len(columns))):
            setattr(self, name, np.concatenate(columns[i]))
            columns[i] = []  # a column's parts go once it is whole
        # grid: how many bytes behind a symbol's beginning the run begins, where its anchor lays the symbols
        self.has_left, self.has_right = self.run_before > 0, self.run_before < self.run_len

    def docs(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1


def _place(h: np.ndarray, buckets: int) -> np.ndarray:
    """Keys of contexts: as many of a hash's high bits as tell a bucket's contexts apart. Hashes are mixed anew as anchors
    have low ones. Two contexts of one key are taken for one here: their passages are compared in full later."""
    bits = min(64, 34 + buckets.bit_length())
    return _mix(h * _MUL) >> np.uint64(64 - bits) << np.uint64(64 - bits)


def _parts(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, its slice) of sorted bucket numbers."""
    ends = (np.flatnonzero(np.diff(bucket)) + 1).tolist()
    if len(bucket):
        for a, b in zip([0, *ends], [*ends, len(bucket)]):
            yield int(bucket[a]), slice(a, b)


def _questions(block: Block, buckets: int) -> Iterator[tuple[int, bytes]]:
    """The distinct contexts, with their occurrences, whether two documents here have them, and one as the block that asks."""
    places = _place(np.concatenate([block.left[block.has_left], block.right[block.has_right]]), buckets)
    doc = block.ids[block.docs(block.run_start)]
    ids = np.concatenate([doc[block.has_left], doc[block.has_right]])
    del doc
    order = np.argsort(places, kind="stable")
    places, ids = places[order], ids[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]])[: len(places)])
    n = np.diff(np.append(first, len(places)))
    several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if len(first) else np.zeros(0, bool)
    yield from keyed(places[first], [n, several.astype(np.uint8), np.ones(len(first), np.uint8)], levels(buckets)[0])


def _shared(question: Keyed) -> tuple[bytes, None, list[int]]:
    """Per context: 0 where one block's one document alone has it, 1 where more have it, 2 where it is hot as well."""
    n, several, asks = question.numbers
    return pack(np.where((several > 0) | (asks > 1), np.where(n >= HOT, 2, 1), 0).astype(np.uint8)), None, []


def _at(data: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """window_hashes at some places only."""
    out = np.zeros(len(start), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * _MUL + data[start + j] + np.uint64(1)
        return _mix(out)


def _steps(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, 0 .. n[1] - 1, ..."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


class Stretches:
    """What a block sends in its second question."""

    def __init__(self, block: Block, answers: pa.Table, buckets: int):
        said = [unpack(d)[0] for d in answers.sort_by("bucket").column("data").to_pylist()]  # in order: as the sorted places
        on = block.has_left, block.has_right
        places = [_place(h[o], buckets) for h, o in zip((block.left, block.right), on)]
        known = np.unique(np.concatenate(places))
        kinds = []
        for p, o in zip(places, on):
            kind = np.zeros(len(o), dtype=np.uint8)
            if len(p):
                kind[o] = np.concatenate(said)[np.searchsorted(known, p)]
            kinds.append(kind)
        left, right = kinds
        # warm: from the left passages' start, or where the right ones begin, to where the warm ones end
        begin = np.where(left == 1, 0, block.run_before)
        end = np.where(right == 1, block.run_len, block.run_before)
        warm = np.flatnonzero(end > begin)
        start, size, key = (block.run_start + begin)[warm], (end - begin)[warm] + block.least - 1, block.run_hash[warm]
        phase = (block.grid - begin)[warm] % symbol_width(block.least)
        first = np.concatenate([block.run_start[left == 2], (block.run_start + block.run_before)[right == 2]])
        n = np.concatenate([block.run_before[left == 2], (block.run_len - block.run_before)[right == 2]])
        if len(first):  # hot ones, one by one, by their own hash
            one = np.repeat(first, n) + _steps(n)
            start, size, key = np.concatenate([start, one]), np.concatenate([size, np.full(len(one), block.least)]), np.concatenate([key, _at(block.data, one, block.least)])
            phase = np.concatenate([phase, np.zeros(len(one), phase.dtype)])
        texts: dict[bytes, int] = {}
        raw = block.raw
        of = [texts.setdefault(raw[a : a + n], len(texts)) for a, n in zip(start.tolist(), size.tolist())]
        self.start, self.of, self.texts = start, np.array(of, dtype=np.int64), list(texts)
        m = len(self.texts)
        self.low = np.full(m, np.iinfo(np.int64).max)
        np.minimum.at(self.low, self.of, block.ids[block.docs(start)])
        self.key = np.zeros(m, dtype=np.uint64)
        self.key[self.of] = key
        self.phase = np.zeros(m, dtype=np.uint8)
        self.phase[self.of] = phase
        self.size = np.array([len(t) for t in self.texts], dtype=np.uint8)
        # as the answers come: by key
        order = np.argsort(_mix(self.key * _MUL), kind="stable")
        self.key, self.low, self.phase, self.size, self.texts = _mix(self.key * _MUL)[order], self.low[order], self.phase[order], self.size[order], [self.texts[i] for i in order.tolist()]
        rank = np.empty(m, dtype=np.int64)
        rank[order] = np.arange(m)
        self.of = rank[self.of]

    def questions(self, ranges: int) -> Iterator[tuple[int, bytes]]:
        return _asked(self.key, self.size, self.phase, self.low, self.texts, ranges)

    def note(self) -> bytes:
        """What the block needs itself to understand the answers."""
        return pack(self.start, slim(self.of), self.size)


def _asked(key: np.ndarray, size: np.ndarray, phase: np.ndarray, low: np.ndarray, texts: list[bytes], ranges: int) -> Iterator[tuple[int, bytes]]:
    for r, at in parts_of(key, ranges):
        yield r, pack(delta(key[at]), size[at], phase[at], low[at], b"".join(texts[at]))


class Passages:
    """Stretches that several ask about, distinct, by key, with their smallest document; equal ones have equal keys. An
    answer has the smallest document of each passage of `least` bytes of each stretch, on end."""

    def __init__(self, asked: list[bytes], least: int):
        self.least = least
        place: dict[bytes, int] = {}
        keys, sizes, phases, lows, sent = [], [], [], [], []
        for data in asked:
            key, size, phase, low, flat = unpack(data)
            flat, ends = flat.tobytes(), np.cumsum(size, dtype=np.int64).tolist()
            known = len(place)
            of = np.array([place.setdefault(flat[a:b], len(place)) for a, b in zip([0, *ends[:-1]], ends)], dtype=np.int64)
            new = np.flatnonzero(of >= known)  # in order, as a message's stretches are distinct
            for column, x in zip((keys, sizes, phases, lows), (undelta(key), size, phase, np.full(len(size), np.iinfo(np.int64).max))):
                column.append(x[new])
            sent.append((of, low))
        keys, sizes, phases, lows = (np.concatenate(x) for x in (keys, sizes, phases, lows))
        for of, low in sent:
            np.minimum.at(lows, of, low)
        order = np.argsort(keys, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        texts = list(place)
        self.key, self.size, self.phase, self.low, self.texts = keys[order], sizes[order], phases[order], lows[order], [texts[i] for i in order.tolist()]
        self.of = [rank[of] for of, _ in sent]

    def parts(self, ranges: int) -> Iterator[tuple[int, bytes]]:
        return _asked(self.key, self.size, self.phase, self.low, self.texts, ranges)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each stretch how many passages it has, and where they begin."""
        n = self.size.astype(np.int64) - self.least + 1
        return n, np.cumsum(n) - n

    def notes(self) -> list[list[np.ndarray]]:
        n, offset = self.places()
        return [[slim(offset[of]), slim(n[of])] for of in self.of]

    @staticmethod
    def answered(note: list[np.ndarray], told: list[np.ndarray]) -> bytes:
        offset, n = (x.astype(np.int64) for x in note)
        return pack(told[0][np.repeat(offset, n) + _steps(n)])


class Streams:
    """Chunks of a bwt, its common prefixes and owners in one file, written and read from beginning to end. The file of the round
    before goes once the next one is written."""

    def __init__(self, folder: str):
        self.store, self.folder = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        self.store.create_dir(self.folder)
        self.number = 0

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number}"

    def write(self, chunks: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """chunks may come from the file that there is."""
        with self.store.open_output_stream(self._path(self.number + 1), buffer_size=0) as f:
            for chunk in chunks:
                f.write(struct.pack("<q", len(chunk[0])) + b"".join([x.tobytes() for x in chunk]))
        if self.number:
            self.store.delete_file(self._path(self.number))
        self.number += 1

    def read(self, kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        with self.store.open_input_stream(self._path(self.number), buffer_size=0) as f:
            while head := f.read(8):
                (n,) = struct.unpack("<q", head)
                data = f.read(n * (kind.itemsize + 5))
                yield np.frombuffer(data, kind, n), np.frombuffer(data, np.uint8, n, n * kind.itemsize), np.frombuffer(data[n * (kind.itemsize + 1) :], np.int32, n)

    def drop(self) -> None:
        self.store.delete_dir(self.folder)


class ColumnIndex:
    """Burrows-Wheeler transform and common prefixes of a collection of byte strings, one column a round.

    Streams, in the order of the suffixes so far: bwt (the symbol before the suffix, plus one; 0 at a string's
    start), lcp (common prefix with the suffix before it), own (its string, and in the low byte its place). Ends come
    first and differ. A round passes over the streams' file once to find where the strings' next suffixes go, by the number of
    each symbol that came before and the smallest common prefix since its last place, and once more to write them there. What
    it keeps in memory is a chunk, some numbers a symbol, and some numbers a string."""

    def __init__(self, strings: np.ndarray, sizes: np.ndarray, folder: str):
        """strings: one padded row of symbols each, aligned to the right; whole numbers from zero on."""
        m, wide = strings.shape
        symbols = strings.astype(np.uint32) + np.uint32(1)
        self.kind, self.streams, self.m = symbols.dtype, Streams(folder), m
        before = np.where(sizes > 0, symbols[:, -1], 0).astype(self.kind)
        own = (np.arange(m) << 8 | sizes).astype(np.int32)
        self.have = np.bincount(before, minlength=int(symbols.max(initial=0)) + 1)  # of each symbol in the bwt
        self.streams.write((before[a : a + PIECE], np.zeros(len(before[a : a + PIECE]), np.uint8), own[a : a + PIECE]) for a in range(0, m, PIECE))
        here, place = np.arange(m), np.arange(m)  # unfinished strings by the place of their longest suffix so far
        for column in range(1, wide + 1):
            on = sizes[here] >= column
            here, place = here[on], place[on]
            if not len(here):
                break
            symbol = symbols[here, wide - column]
            before = np.where(sizes[here] > column, symbols[here, wide - column - 1], 0).astype(self.kind) if column < wide else np.zeros(len(here), self.kind)
            here, place = self._insert(here, place, symbol, before, (here << 8 | sizes[here] - column).astype(np.int32))

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return self.streams.read(self.kind)

    def _places(self, place: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of strings by place: how often their symbol stands before, and the common prefix of the suffixes that begin with it
        there and at its place before, and at its place behind; 0 where there is none."""
        rank, low, high = np.zeros(len(place), np.int64), np.zeros(len(place), np.uint8), np.zeros(len(place), np.uint8)
        seen = np.zeros(len(self.have), dtype=np.int64)
        least = np.full(len(self.have), 255, dtype=np.uint8)  # since each symbol's last place
        waits = np.full(len(self.have), -1, dtype=np.int32)  # the string whose new suffix stood there, if one did
        start = 0
        for bwt, lcp, _ in self.chunks():
            n = len(bwt)
            mine = np.arange(*np.searchsorted(place, [start, start + n]))
            both = bwt.astype(np.uint64) << np.uint64(32) | np.arange(n, dtype=np.uint64)
            both.sort()  # by symbol, then place; sorts faster than an order
            order, inside = (both & np.uint64(0xFFFFFFFF)).astype(np.int32), (both >> np.uint64(32)).astype(np.int32)
            first = np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1]]))
            kinds, ends = inside[first], np.append(first[1:], n)
            upto = np.minimum.accumulate(lcp)
            # symbols' first places here end what waited for them
            told = waits[kinds] >= 0
            high[waits[kinds[told]]] = np.minimum(least[kinds[told]], upto[order[first[told]]]) + 1
            now, mark = place[mine] - start, symbol[mine]
            own = np.searchsorted(both, mark.astype(np.uint64) << np.uint64(32) | now.astype(np.uint64))
            group = np.searchsorted(kinds, mark)
            rank[mine] = seen[mark] + own - first[group]
            early = own > first[group]
            late = own < ends[group] - 1
            ranges = _range_least(lcp, np.concatenate([order[own[early] - 1], now[late]]) + 1, np.concatenate([now[early], order[own[late] + 1]]) + 1)
            cut = int(early.sum())
            low[mine[early]], high[mine[late]] = ranges[:cut] + 1, ranges[cut:] + 1
            late = ~early & (seen[mark] > 0)  # the place before lies in an earlier chunk
            low[mine[late]] = np.minimum(least[mark[late]], upto[now[late]]) + 1
            # what the next chunk needs
            last = order[ends - 1]
            rest = np.append(np.minimum.accumulate(lcp[::-1])[::-1][1:], 255).astype(np.uint8)
            np.minimum(least, upto[-1], out=least)
            least[kinds] = rest[last]
            newest = np.full(n, -1, dtype=np.int32)
            newest[now] = mine
            waits[kinds] = newest[last]
            seen[kinds] += ends - first
            start += n
        return rank, low, high

    def _insert(self, here: np.ndarray, place: np.ndarray, symbol: np.ndarray, before: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, low, high = self._places(place, symbol)
        smaller = np.cumsum(self.have) - self.have - self.have[0]  # symbols below each, without the strings' starts
        to = self.m + smaller[symbol] + rank
        order = np.argsort(to)
        here, to, before, low, high, own = here[order], to[order], before[order], low[order], high[order], own[order]
        old = to - np.arange(len(to))  # the old suffix that each goes before
        self.streams.write(self._merged(old, before, low, high, own))
        self.have += np.bincount(before, minlength=len(self.have))
        return here, to

    def _merged(self, old: np.ndarray, before: np.ndarray, low: np.ndarray, high: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The streams with the new suffixes; an old one behind a new one has its common prefix with that one now."""
        start, held = 0, []
        for bwt, lcp, owns in self.chunks():
            n = len(bwt)
            a, b = np.searchsorted(old, [start, start + n])
            at = old[a:b] - start
            lcp = lcp.copy()
            lcp[at] = high[a:b]  # of several before one old suffix the last counts
            to = at + np.arange(b - a)
            kept = np.ones(n + b - a, dtype=bool)
            kept[to] = False
            made = []
            for x, y in zip((bwt, lcp, owns), (before[a:b], low[a:b], own[a:b])):
                out = np.empty(n + b - a, dtype=x.dtype)
                out[kept], out[to] = x, y
                made.append(out)
            start += n
            for c in range(0, len(made[0]), PIECE) if len(made[0]) > 2 * PIECE else (None,):
                yield tuple(x[c : c + PIECE] if c is not None else x for x in made)
        rest = np.searchsorted(old, start)
        if rest < len(old):
            yield before[rest:], low[rest:], own[rest:]


def _range_least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The smallest of values[low:high] of each range; none is empty."""
    if not len(low):
        return np.zeros(0, values.dtype)
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    out, table = np.empty(len(low), values.dtype), values
    for k in range(int(level.max()) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[: len(table) - half], table[half:])
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
    return out


def symbol_width(least: int) -> int:
    """Bytes of a symbol: the largest number up to WIDEST that divides a passage's."""
    return max(w for w in range(1, WIDEST + 1) if least % w == 0)


def passage_lows(strings: list[bytes], low: np.ndarray, least: int, phase: np.ndarray | None, folder: str) -> np.ndarray:
    """For every passage of distinct strings, on end: the smallest `low` of the strings that have it.

    Given phases, symbols are symbol_width(least) bytes, numbered in their order: passages are indexed by the grid that they start on,
    one grid after the other. Equal passages must lie alike on the grids. Without phases a symbol is a byte.
    """
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    flat = np.frombuffer(b"".join(strings), dtype=np.uint8)
    begin = np.cumsum(sizes) - sizes
    passages = sizes - least + 1
    offset = np.cumsum(passages) - passages
    out = np.empty(int(passages.sum()), dtype=np.int64)
    width = 1 if phase is None else symbol_width(least)
    for grid in range(width):
        skip = (phase - grid) % width if width > 1 else np.zeros(len(sizes), np.int64)
        n = np.maximum(passages - skip + width - 1, 0) // width  # passages on this grid
        at = np.flatnonzero(n)
        if not len(at):
            continue
        symbols = n[at] + least // width - 1
        wide = int(symbols.max())
        first = np.repeat((begin + skip)[at], symbols) + _steps(symbols) * width
        value = flat[first].astype(np.uint64)
        for i in range(1, width):
            value = value << np.uint64(8) | flat[first + i]
        rows = np.zeros((len(at), wide), dtype=np.uint32)
        rows[np.arange(wide)[None, :] >= (wide - symbols)[:, None]] = np.unique(value, return_inverse=True)[1]
        index = ColumnIndex(rows, symbols, f"{folder}/{grid}")
        runs: list[np.ndarray] = [np.zeros(0, np.int64)]  # the smallest of each run of equal passages, in order
        for _, lcp, own in index.chunks():
            lows = low[at][own >> 8]
            first = np.flatnonzero(lcp < least // width)
            if len(runs) > 1 and (not len(first) or first[0]):  # the last run goes on
                runs[-1][-1] = min(int(runs[-1][-1]), int(lows[: first[0] if len(first) else len(lows)].min()))
            if len(first):
                runs.append(np.minimum.reduceat(lows, first))
        lowest, run = np.concatenate(runs), -1
        for _, lcp, own in index.chunks():
            of, place = own >> 8, own & 255
            number = run + np.cumsum(lcp < least // width)
            run = int(number[-1])
            mine = symbols[of] - place >= least // width
            out[(offset + skip)[at][of[mine]] + place[mine] * width] = lowest[number[mine]]
        index.streams.drop()
    return out


def _lows(folder: str):
    def run(question: Passages) -> tuple[bytes, None, list[int]]:
        task = TaskContext.get()
        own = f"{folder}/{task.partitionId() if task else 0}-{uuid.uuid4().hex}"  # another attempt has files of its own
        passages, offset = question.places()
        found = np.repeat(question.low, passages)
        # equal passages have equal keys: a stretch that is alone with its key shares none, but with its own copies
        key = question.key
        same = np.concatenate([[False], key[1:] == key[:-1], [False]])
        at = np.flatnonzero(same[1:] | same[:-1])
        if len(at):
            to = np.repeat(offset[at], passages[at]) + _steps(passages[at])
            found[to] = passage_lows([question.texts[i] for i in at.tolist()], question.low[at], question.least, question.phase[at].astype(np.int64), own)
        return pack(found), None, []

    return run


def removed(sizes: np.ndarray, ids: np.ndarray, answers: pa.Table, least: int) -> np.ndarray:
    """Which bytes of a block's texts, on end, go: sizes and ids of its texts, and the answers with its note."""
    answers = answers.sort_by("bucket")  # the note stands first, under a negative number
    note, *told = answers.column("data").to_pylist()
    start, of, size = unpack(note)
    passages = size.astype(np.int64) - least + 1
    offset = np.cumsum(passages) - passages
    lows = np.concatenate([np.zeros(0, np.int64), *(unpack(d)[0] for d in told)])
    doc = np.searchsorted(np.cumsum(sizes) - sizes, start, side="right") - 1
    begins = np.zeros(int(sizes.sum()) + 1, dtype=bool)  # where a passage that goes begins
    for a in range(0, len(start), 50_000):
        part = slice(a, a + 50_000)
        n = passages[of[part]]
        step = _steps(n)
        earlier = lows[np.repeat(offset[of[part]], n) + step] < np.repeat(ids[doc[part]], n)
        begins[(np.repeat(start[part], n) + step)[earlier]] = True
    upto = np.cumsum(begins, dtype=np.int32)[:-1]
    upto[least:] -= upto[:-least].copy()
    return upto > 0


def dedup_passages(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """One row per row of docs: id_col, the columns in keep, n_bytes, spans (the maximal removed runs, in bytes), kept
    (binary: the remaining bytes, on end; as_text: their characters, without what is left of characters cut in two)."""
    if not anchor <= least or 2 * least - anchor > 255:
        raise ValueError("an anchor is at most as long as a passage, and stretches are at most 255 bytes long")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    names = [id_col, *keep]
    rows = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate([id_col, text_col, *keep])))
    blocks = make_blocks(rows, 1, "texts")
    buckets, n = bucket_count(blocks), blocks.count()

    def made(table: pa.Table) -> Block:
        return Block(table, 0, 1, least, anchor)

    shared, _ = exchange(ask(blocks, lambda _, table: _questions(made(table), buckets)), n, buckets, Keyed, _shared, "anchors")

    def second(block: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        stretches = Stretches(made(table), answers, buckets)
        return pa.Table.from_batches([batch_of([*((block, b, q) for b, q in stretches.questions(levels(buckets)[0])), (block, -1, stretches.note())])])

    asked = with_answers(blocks, shared, second, ASKS)
    lows, _ = exchange(asked, n, buckets, lambda d: Passages(d, least), _lows(f"{shared_dir(docs.sparkSession)}/wavedeck/streams-{uuid.uuid4().hex}"), "passages", Passages.answered)

    def last(block: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        ids = table.column(0).combine_chunks()
        texts = [(t.as_py() or "").encode() for t in table.column(1)]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        gone = removed(sizes, np.array(ids.fill_null(0)).astype(np.int64), answers, least)
        spans, kept = [], []
        for end, text in zip(np.cumsum(sizes).tolist(), texts):
            cut = gone[end - len(text) : end]
            if not cut.any():
                spans.append([])
                kept.append(text)
                continue
            edges = np.flatnonzero(np.diff(cut.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            spans.append([{"start": x, "stop": y} for x, y in edges.tolist()])
            kept.append(np.frombuffer(text, dtype=np.uint8)[~cut].tobytes())
        if as_text:
            kept = [k.decode(errors="ignore") for k in kept]
        columns = [table.column(0), *(table.column(2 + i) for i in range(len(keep)))]
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.Table.from_arrays([*columns, pa.array(sizes), pa.array(spans, span), pa.array(kept, pa.string() if as_text else pa.binary())], [*names, "n_bytes", "spans", "kept"])

    return with_answers(blocks, lows, last, ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", n_bytes long, spans array<struct<start: long, stop: long>>, kept {'string' if as_text else 'binary'}")
