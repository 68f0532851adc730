"""Questions of blocks, merged on their way to the buckets that answer them, through a tree.

A block has one packed question about its distinct keys. If it sent each bucket its own part, the messages would be
blocks times buckets. Here it sends at most FAN messages, by the top ranges of the keys' hash. A node takes the same
range from about FAN blocks, merges what they ask (a key that many of them have goes on once, with its numbers
summed) and again sends at most FAN messages, by finer ranges, and so on until a range is one bucket's. Answers go back
along the same nodes, whose notes say who asked what: the notes travel with the messages to where the answers are stored, so
that no question is kept on disk for its way back. Where answers are long and many blocks ask the same, a bucket's answer is
stored once with the notes, and the blocks' answers are made as they are read. So messages and bytes are in proportion to the input, with one
more level each time it grows by FAN; a bucket hears of a key at most FAN times however many blocks have it.
With FAN buckets or fewer there is one level: blocks and buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ASKS, batch_of, delta, pack, release, undelta, unpack
from .scratch import in_turns, release_shuffles, stored

#: Messages that a block or node sends, and about the number of blocks or nodes whose messages meet in a node.
FAN = 256


class Question(Protocol):
    """What several children ask, merged."""

    def parts(self, ranges: int) -> Iterator[tuple[int, bytes]]:
        """Itself as messages, by the range of the keys, in order."""

    def notes(self) -> list[list[np.ndarray]]:
        """Per child what its answer takes, as many arrays of each."""

    @staticmethod
    def answered(note: list[np.ndarray], told: list[np.ndarray]) -> bytes:
        """A child's answer, from its note and what the answers to those messages say, on end."""


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Of 64-bit hashes: the place among so many equal ranges; those of a multiple nest in them."""
    return (keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)


def ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of 64-bit hashes, and they in that order. Their high bits with their places below sort faster than an
    order is found; where other hashes than equal ones share the bits that fit, and stand wrong, the order is found in full."""
    if not len(keys):
        return np.zeros(0, np.int64), keys
    low, bits = keys.min(), len(keys).bit_length()
    drop = max(0, int(keys.max() - low).bit_length() + bits - 64)
    both = (keys - low) >> np.uint64(drop) << np.uint64(bits) | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    order = (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    inside = keys[order]
    if drop and (inside[1:] < inside[:-1]).any():
        order = np.argsort(keys, kind="stable")
        inside = keys[order]
    return order, inside


def parts_of(sorted_keys: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    """(range, its slice) of sorted keys."""
    if len(sorted_keys):
        ends = (np.flatnonzero(np.diff(place := range_of(sorted_keys, ranges))) + 1).tolist()
        for a, b in zip([0, *ends], [*ends, len(sorted_keys)]):
            yield int(place[a]), slice(a, b)


def slim(x: np.ndarray) -> np.ndarray:
    """Whole numbers from zero on in the narrowest type."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))) if x.dtype.kind in "iu" else x


def keyed(sorted_keys: np.ndarray, numbers: Sequence[np.ndarray], ranges: int) -> Iterator[tuple[int, bytes]]:
    """A question about sorted distinct keys, each with numbers, as messages."""
    for r, part in parts_of(sorted_keys, ranges):
        yield r, pack(delta(sorted_keys[part]), *(slim(x[part]) for x in numbers))


class Keyed:
    """Merged questions about keys: keys, sorted and distinct, and the sums of their numbers.

    owned: the last array of an answer says whether a key is the asker's own; of all that ask about a key one, with a
    first number above zero, is told so. Then what is to be counted once a key is counted by its owner."""

    def __init__(self, asked: list[bytes], owned: bool = False):
        parts = [unpack(d) for d in asked]
        keys = [undelta(p[0]) for p in parts]
        every = np.concatenate(keys)
        order, inside = ordered(every)
        new = np.concatenate([[True], inside[1:] != inside[:-1]])
        first = np.flatnonzero(new)
        self.keys, self.owned = inside[first], owned
        wide = lambda x: x.astype(np.int64) if x.dtype.kind in "iu" else x
        columns = [np.concatenate([wide(p[i]) for p in parts])[order] for i in range(1, len(parts[0]))]
        self.numbers = [np.add.reduceat(c, first) for c in columns]
        of = np.empty(len(every), dtype=np.int64)
        of[order] = np.cumsum(new) - 1
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        self.of = np.split(of, cuts)
        if owned:
            at = np.minimum.reduceat(np.where(columns[0] > 0, np.arange(len(order)), len(order)), first)
            mine = np.zeros(len(order), dtype=bool)
            mine[order[at[at < len(order)]]] = True
            self.mine = np.split(mine, cuts)

    def parts(self, ranges: int) -> Iterator[tuple[int, bytes]]:
        return keyed(self.keys, self.numbers, ranges)

    def notes(self) -> list[list[np.ndarray]]:
        steps = [slim(delta(of)) for of in self.of]  # a child's keys are sorted
        return [[s, m] for s, m in zip(steps, self.mine)] if self.owned else [[s] for s in steps]

    @staticmethod
    def answered(note: list[np.ndarray], told: list[np.ndarray]) -> bytes:
        of = undelta(note[0].astype(np.int64))
        mine = [x[of] for x in told]
        if len(note) > 1:
            mine[-1] = mine[-1] & note[1]
        return pack(*map(slim, mine))


def levels(buckets: int) -> list[int]:
    """The number of ranges at each level; the last is the number of buckets, `buckets` or somewhat more."""
    n = 1
    while FAN**n < buckets:
        n += 1
    fan = 1
    while fan**n < buckets:
        fan += 1
    return [fan ** (k + 1) for k in range(n)]


def _joined(answers: list[bytes]) -> list[np.ndarray]:
    """What several answers say, on end."""
    return [np.concatenate(x) for x in zip(*map(unpack, answers))]


def exchange(asks: DataFrame, blocks: int, buckets: int, merge: Callable[[list[bytes]], Question], answer: Callable[[Question], tuple[bytes, bytes | None, list[int]]], name: str, answered: Callable[[list[np.ndarray], list[np.ndarray]], bytes] = Keyed.answered, once: bool = False, turns: int = 1) -> tuple[DataFrame, DataFrame]:
    """asks(block, bucket, data): each block's messages by levels(buckets)[0] ranges. answer(all questions to a bucket)
    gives the packed answer to the merged question, the bucket's table (or None) and figures that add up. A message to
    bucket -1 is the block's note to itself. answered: that of the questions' class. once: a bucket's answer is stored
    once, with its askers' notes, and not by asker. turns: where there are several levels the questions are written, and go
    through the tree in so many parts of the hash range, one after the other: each level shuffles one part at a time.

    Returns the answers, (block, bucket, data) as asked, with the blocks' notes, and the tables, (bucket, data, figures), which
    are stored by part of the hash range."""
    sizes = levels(buckets)
    # notes are passed on by whose they are: -1 the blocks' own, from -2 on those of the nodes of each level
    key = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(-1 - F.col("block"))

    def of(table: pa.Table) -> Question:
        return merge(table.column("data").to_pylist())

    def up(level: int, ranges: int):
        def run(table: pa.Table) -> pa.Table:
            if table.column("key")[0].as_py() < 0:
                return table.select(["block", "bucket", "data"])
            table = table.sort_by("block")
            me = table.column("node")[0].as_py() << 32 | table.column("bucket")[0].as_py()
            question = of(table)
            out = [(me, r, d) for r, d in question.parts(ranges)]
            out.append((me, -2 - level, pack(table.column("block").to_numpy(), *(x for note in question.notes() for x in note))))
            release()
            return pa.Table.from_batches([batch_of(out)])

        return run

    def last(table: pa.Table) -> pa.Table:
        if table.column("key")[0].as_py() < 0:
            rows = [(*x, "answer", None) for x in zip(*(table.column(c).to_pylist() for c in ("block", "bucket", "data")))]
        else:
            table = table.sort_by("block")
            bucket = table.column("bucket")[0].as_py()
            question = of(table)
            told, data, figures = answer(question)
            said = unpack(told)
            askers, notes = table.column("block"), question.notes()
            if once:
                rows = [(None, bucket, pack(askers.to_numpy(), np.array([len(said)]), *said, *(x for note in notes for x in note)), "answer", None)]
            else:
                rows = [(b, bucket, answered(note, said), "answer", None) for b, note in zip(askers.to_pylist(), notes)]
            if data is not None or figures:
                rows.append((None, bucket, data, f"table-{bucket * 64 // sizes[-1]:02d}", figures))
            release()
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], ["block", "bucket", "data", "part", "figures"])

    def through(asks: DataFrame) -> DataFrame:
        nodes = blocks
        for level, (ranges, finer) in enumerate(zip(sizes, sizes[1:])):
            nodes = -(-nodes // (finer // ranges))
            dealt = asks.withColumn("node", F.pmod(F.xxhash64("block"), F.lit(nodes))).withColumn("key", key)
            asks = dealt.groupBy("node", "key").applyInArrow(up(level, finer), ASKS)
        return asks.withColumn("key", key).groupBy("key").applyInArrow(last, "block long, bucket long, data binary, part string, figures array<long>")

    if turns > 1 and len(sizes) > 1:
        turn = F.when(F.col("bucket") >= 0, F.floor(F.col("bucket") * turns / sizes[0])).otherwise(0)
        found = stored((through(part) for part in in_turns(asks, f"{name}-asked", turn, turns)), name, "part")
    else:
        found = stored(through(asks), name, "part")
    release_shuffles(asks.sparkSession)
    every = found.where("part = 'answer'").select("block", "bucket", "data")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, bucket, data in zip(*(batch.column(c) for c in ("block", "bucket", "data"))):
                block, bucket, data = block.as_py(), bucket.as_py(), data.as_py()
                if block is not None:
                    yield batch_of([(block, bucket, data)])
                    continue
                askers, (long,), *rest = unpack(data)
                said, notes = rest[:long], rest[long:]
                each = len(notes) // len(askers)
                yield batch_of([(b, bucket, answered(notes[i * each : (i + 1) * each], said)) for i, b in enumerate(askers.tolist())])
                release()

    def down(table: pa.Table) -> pa.Table:
        note, *told = table.sort_by("bucket").column("data").to_pylist()
        me, said = table.column("block")[0].as_py(), _joined(told)
        children, *notes = unpack(note)
        each = len(notes) // len(children)
        out = [(b, me & 0xFFFFFFFF, answered(notes[i * each : (i + 1) * each], said)) for i, b in enumerate(children.tolist())]
        release()
        return pa.Table.from_batches([batch_of(out)])

    answers = every if len(sizes) == 1 else every.where("bucket >= 0")
    if once:
        answers = answers.mapInArrow(spread, ASKS)
    for level in reversed(range(len(sizes) - 1)):
        answers = answers.unionByName(every.where(F.col("bucket") == -2 - level)).groupBy("block").applyInArrow(down, ASKS)
    if len(sizes) > 1:
        answers = answers.unionByName(every.where("bucket = -1"))
    return answers, found.where("part <> 'answer'").select("bucket", "data", "figures")
