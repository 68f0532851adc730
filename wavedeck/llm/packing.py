"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Only documents longer than a sequence are cut. Pieces go to groups by a hash; the number of groups follows
the number of tokens, so that a group holds about GROUP_TOKENS at every input size and leaves one sequence
part empty. In a group one sequence is filled at a time: first greedily, always by the largest piece that
still fits; then its smallest document is replaced by two unpacked ones that together fill the expanded gap
more tightly, for as long as that helps.

Nulls are empty texts (one end token each). Ids may be null or repeat: every row is a document of its own.
An empty table gives no rows. A group's rows are lengths and checksums, not texts.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .blocks import release
from .scratch import bytes_of, stored

#: Tokens of a packing group: 256 sequences of 4096, so under 0.4 % of room is lost to its last one.
GROUP_TOKENS = 1 << 20
#: Distinct chunks whose ids a worker keeps; beyond, those of the texts at hand alone stay.
MAX_CHUNKS = 150_000
#: Marks that the tokenizer splits from a letter or digit before them; those of its special tokens and contractions are left out.
_TAIL = ".,!?;:\"#$%&()*+-/=@[\\]^_`{}~"
#: Letters whose lower case and normal form are they themselves.
_LATIN = frozenset("abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)])))
#: Byte-level BPE writes bytes that don't print as the characters from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_PRINTABLE = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}

_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]

_MADE: dict[str, "Chunks"] = {}


def _packed(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)


class Chunks:
    """Ids (little-endian unsigned 32-bit) of the chunks between blanks and line ends. The tokenizer drops
    white space and no token, merge or normal form crosses a blank, so a text's ids are its chunks' ids.
    Between an ASCII letter or digit, or letters in _LATIN alone, and the marks in _TAIL it splits as well, and it ignores
    their case, so a chunk's variants are put together from one word's ids."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.known: dict[str, bytes] = {}

    def _learn(self, chunks: Iterable[str]) -> None:
        """Encode words that aren't known. Lower-case Latin letters alone are one piece that the normaliser
        and the splitter leave as it is, so the merges are asked at once, with the bytes in their printable form."""
        rest, known, merges = [], self.known, self.tokenizer.model.tokenize
        for chunk in chunks:
            if chunk.isalpha() and chunk.islower() and (chunk.isascii() or _LATIN.issuperset(chunk)):
                known[chunk] = _packed([x.id for x in merges(chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(_PRINTABLE))])
            else:
                rest.append(chunk)
        for chunk, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            known[chunk] = _packed(e.ids)

    def add(self, chunks: list[str]) -> None:
        """Put the ids of chunks, which `known` lacks, there."""
        words, variants, known = set(), [], self.known
        for chunk in chunks:
            word = chunk.rstrip(_TAIL)
            low = word.lower()
            if low != chunk and (word[-1:].isalnum() if chunk.isascii() else _LATIN.issuperset(low)):
                tail = chunk[len(word) :]
                variants.append((chunk, low, tail))
                words.add(low)
                words.add(tail)
            else:
                words.add(chunk)
        self._learn(words - known.keys())
        for chunk, word, tail in variants:
            known[chunk] = known[word] + known[tail] if tail else known[word]

    def ids(self, texts: list[str]) -> list[bytes]:
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        every = coded.dictionary.to_pylist()
        self.known[""] = b""
        made = list(map(self.known.get, every))
        if missing := [c for c, found in zip(every, made) if found is None]:
            self.add(missing)
            made = list(map(self.known.get, every))
        if len(self.known) > MAX_CHUNKS:
            self.known = dict(zip(every, made))
        sizes = np.fromiter(map(len, made), dtype=np.int64, count=len(made)) // 4
        flat = np.frombuffer(b"".join(made), dtype="<u4")
        of = coded.indices.to_numpy()
        ends = np.cumsum(sizes[of])
        at = np.repeat((np.cumsum(sizes) - sizes)[of] - (ends - sizes[of]), sizes[of]) + np.arange(ends[-1] if len(ends) else 0)
        taken = flat[at]
        cuts = np.concatenate([[0], ends])[split.offsets.to_numpy()].tolist()
        return [taken[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


def _made(data: bytes) -> Chunks:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hashlib.sha256(data).hexdigest()
    if key not in _MADE:
        _MADE[key] = Chunks(Tokenizer.from_str(data.decode()))
    return _MADE[key]


def tokenized_pieces(docs: DataFrame, vocabulary: str, length: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, row (a number for the row's occurrence), piece, start, length, ids_crc32, ids binary left out:
    the pieces of each document's ids followed by end_id."""
    data = docs.sparkSession.sparkContext.broadcast(bytes_of(docs.sparkSession, vocabulary))
    kind = docs.schema[id_col].dataType
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _made(data.value)
        for batch in batches:
            ids, texts, size = [], [], 0
            todo = batch.num_rows
            for k in range(todo):
                ids.append(batch.column(0)[k])
                texts.append(batch.column(1)[k].as_py() or "")
                size += len(texts[-1])
                if size < 4_000_000 and k + 1 < todo:
                    continue
                rows: list[list] = [[], [], [], [], []]
                for i, packed in enumerate(chunks.ids(texts)):
                    packed += end
                    n = len(packed) // 4
                    for piece, at in enumerate(range(0, n, length)):
                        part = packed[4 * at : 4 * (at + length)]
                        for column, v in zip(rows, (i, piece, at, len(part) // 4, zlib.crc32(part))):
                            column.append(v)
                keys = pa.array([x.as_py() for x in ids], batch.schema.field(0).type).take(pa.array(rows[0], pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])], names)
                ids, texts, size = [], [], 0
            release()

    names = [id_col, "piece", "start", "length", "ids_crc32"]
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each length (1 to capacity)."""
    n = len(lengths)
    by_length: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable")[::-1].tolist():
        by_length.setdefault(int(lengths[i]), []).append(i)
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for size, rows in by_length.items():
        counts[size] = len(rows)
    open_sizes = sum(1 << size for size in by_length)  # bit i: a piece of length i is unpacked

    def take(size: int) -> None:
        nonlocal open_sizes
        counts[size] -= 1
        if not counts[size]:
            open_sizes &= ~(1 << size)

    def give(size: int) -> None:
        nonlocal open_sizes
        counts[size] += 1
        open_sizes |= 1 << size

    bins, offsets, done, number = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), 0, 0
    sizes_up_to = np.arange(capacity + 1)
    while done < n:
        chosen, gap = [], capacity
        while fits := open_sizes & ((2 << gap) - 1):
            size = fits.bit_length() - 1
            take(size)
            chosen.append(size)
            gap -= size
        while gap and open_sizes:
            smallest = min(chosen)
            room = gap + smallest
            if room < 2:
                break
            largest = np.maximum.accumulate(np.where(counts[: room + 1] > 0, sizes_up_to[: room + 1], 0))
            first = np.flatnonzero(counts[: room + 1] > 0)
            first = first[2 * first >= room] if len(first) else first
            second = largest[room - first]
            sums = np.where(second > 0, first + second, 0)
            sums[(second == first) & (counts[first] < 2)] = 0
            best = int(sums.argmax()) if len(sums) else -1
            pair = (int(first[best]), int(second[best])) if best >= 0 and sums[best] else None
            low = np.flatnonzero(counts[: room // 2 + 1] > 0)  # both at most half the room
            if len(low):
                a = int(low[-1])
                b = a if counts[a] > 1 else int(low[-2]) if len(low) > 1 else 0
                if b and (pair is None or a + b > sum(pair)):
                    pair = (a, b)
            if pair is None or sum(pair) <= smallest:
                break
            chosen.remove(smallest)
            give(smallest)
            for size in pair:
                take(size)
                chosen.append(size)
            gap = room - sum(pair)
        at = 0
        for size in chosen:
            i = by_length[size].pop()
            bins[i], offsets[i] = number, at
            at += size
            done += 1
        number += 1
    return bins, offsets


def pack(pieces: DataFrame, length: int, id_col: str = "doc_id", group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """pieces with sequence_id and offset; the input is written once, as its tokens are counted first."""
    pieces = stored(pieces, "pieces")
    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0]
    groups = max(1, -(-total // group_tokens))
    kind = pieces.schema[id_col].dataType.simpleString()

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "ids_crc32", "start"], kind="stable").reset_index(drop=True)
        bins, offsets = best_two_fit(part["length"].to_numpy(), length)
        return part.drop(columns="g").assign(sequence_id=(key[0] << 32) + bins, offset=offsets)

    # by the file's part and the row's place in it as well: rows that are repeated thousands of times don't share a group
    keyed = pieces.withColumn("g", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return keyed.groupBy("g").applyInPandas(run, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, vocabulary: str, length: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(tokenized_pieces(docs, vocabulary, length, end_id, id_col, text_col), length, id_col)
