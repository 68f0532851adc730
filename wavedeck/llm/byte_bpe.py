"""Byte-level BPE as a lazily determinised transducer, and its streaming decoder.

Encoding. The merges are compiled into a transducer that reads bytes from left to right. After every
byte it knows the only last token that an encoding of the text read so far can end with: the token t,
a suffix of that text, whose pair with the last token before it survives merging. A position is live
while some token of the vocabulary could still begin there and reach past what was read. A state is the
set of live positions, each with its node in the vocabulary's trie and the tokens that lead to it. What all of them
begin with is certain and is emitted, so a token waits for a lookahead that no token of the vocabulary
outgrows. States and transitions are made when first met, and kept.

Decoding. Token bytes pass an incremental UTF-8 state machine that keeps at most three bytes of an
unfinished character between tokens. Invalid sequences become U+FFFD.

Nulls are empty texts and give no tokens; ids may be null or repeat; other columns are left aside.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .scratch import bytes_of

#: Open states and pairs that a worker keeps before it starts anew; distinct pieces that it has met lately,
#: and as many from before.
MAX_STATES, MAX_PAIRS, MAX_PIECES = 400_000, 600_000, 300_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}


def merged(ranks: dict[bytes, int], text: bytes) -> list[int]:
    """The definition: merge the adjacent pair of lowest rank, the leftmost first, until none is left."""
    parts = [text[i : i + 1] for i in range(len(text))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """encode(piece) gives the ids of one piece as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.packed = {i: int(i).to_bytes(4, "little") for i in self.token}
        self.child: dict[int, int] = {}  # node << 8 | byte to node
        self.ends_token, self.inner = [-1], [True]
        for text, token in ranks.items():
            node = 0
            for byte in text:
                self.inner[node] = True
                to = self.child.get(node << 8 | byte)
                if to is None:
                    to = self.child[node << 8 | byte] = len(self.ends_token)
                    self.ends_token.append(-1)
                    self.inner.append(False)
                node = to
            self.ends_token[node] = token
        self.pairs: dict[int, bool] = {}
        self.edges: dict[int, tuple | None] = {}
        self._reset()

    def _reset(self) -> None:
        start = (-1, ((0, ()),))
        self.ids = {start: 0}
        self.states: list[tuple[int, tuple[tuple[int, tuple[int, ...]], ...]]] = [start]
        self.ends: list[bytes] = [b""]
        self.moves: dict[int, int] = {}  # state << 8 | byte to state << 1 | whether it emits
        self.says: dict[int, bytes] = {}  # what such a move emits

    def _sides(self, token: int) -> tuple | None:
        """What stands at a token's left and right end while it is being merged, from single bytes on: lists of
        (bytes, rank at which it is merged into the next). None where the token isn't its own encoding."""
        if token in self.edges:
            return self.edges[token]
        text = self.token[token]
        parts, left, right = [text[i : i + 1] for i in range(len(text))], [], []
        highest = -1
        while len(parts) > 1:
            rank, at = min(((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None), default=(None, 0))
            if rank is None:
                break
            if at == 0:
                left.append((parts[0], rank))
            if at == len(parts) - 2:
                right.append((parts[-1], rank))
            highest = max(highest, rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        proper = len(parts) == 1 and (len(text) == 1 or highest == token)  # merged last of all: ranks grow with tokens
        made = (left + [(text, None)], right + [(text, None)]) if proper else None
        self.edges[token] = made
        return made

    def _fits(self, before: int, token: int) -> bool:
        """Whether the two tokens' bytes are encoded as these two tokens."""
        key = before << 32 | token
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._compare(before, token)
        return found

    def _compare(self, before: int, token: int) -> bool:
        if before < 0:
            return merged(self.ranks, self.token[token]) == [token]
        a, b = self._sides(before), self._sides(token)
        if a is None or b is None:
            return merged(self.ranks, self.token[before] + self.token[token]) == [before, token]
        # both sides merge by rising rank; a merge over the border comes first if its rank is the lowest, or as low
        # as that of the one to its right
        i = j = 0
        while True:
            (x, dies), (y, goes) = a[1][i], b[0][j]
            over = self.ranks.get(x + y)
            if over is not None and (dies is None or over < dies) and (goes is None or over <= goes):
                return False
            if dies is None and goes is None:
                return True
            if goes is None or dies is not None and dies <= goes:
                i += 1
            else:
                j += 1

    def _step(self, move: int) -> int:
        before, live = self.states[move >> 8]
        byte, child, ends, inner = move & 255, self.child, self.ends_token, self.inner
        new, path = [], None
        for node, tokens in live:
            to = child.get(node << 8 | byte)
            if to is None:
                continue
            token = ends[to]
            if token >= 0 and path is None and self._fits(tokens[-1] if tokens else before, token):
                path = (*tokens, token)
            if inner[to]:
                new.append((to, tokens))
        if path is None:
            raise ValueError(f"no token ends with byte {byte}")
        sure = len(path)
        for _, tokens in new:  # what all live positions' tokens begin with
            n = min(sure, len(tokens))
            sure = 0
            while sure < n and tokens[sure] == path[sure]:
                sure += 1
        if sure:
            before = path[sure - 1]
            self.says[move] = self.packed[before] if sure == 1 else b"".join([self.packed[t] for t in path[:sure]])
            new, path = [(n, t[sure:]) for n, t in new], path[sure:]
        if path and all([t for _, t in new]):
            before = -2  # nothing begins there any more
        new.append((0, path))
        self.moves[move] = to = self._state((before, tuple(new))) << 1 | (sure > 0)
        return to

    def _state(self, key: tuple[int, tuple[tuple[int, tuple[int, ...]], ...]]) -> int:
        """The number of a state; its last live position is where the text read so far ends."""
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
            self.ends.append(b"".join([self.packed[t] for t in key[1][-1][1]]))
        return to

    def encode(self, piece: bytes) -> bytes:
        whole = self.ranks.get(piece)
        if whole is not None:
            return self.packed[whole]
        if len(self.states) > MAX_STATES:
            self._reset()
        state, out, moves, says = 0, [], self.moves, self.says
        for byte in piece:
            move = state << 8 | byte
            to = moves.get(move)
            if to is None:
                if len(self.states) > MAX_STATES:  # in a very long piece: go on from this state alone
                    key = self.states[state]
                    self._reset()
                    moves, says = self.moves, self.says
                    state = self._state(key)
                    move = state << 8 | byte
                to = self._step(move)
            if to & 1:
                out.append(says[move])
            state = to >> 1
        out.append(self.ends[state])
        return b"".join(out)


class Pieces(dict):
    """The ids of each distinct piece, made when first asked for."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.before.get(piece)
        if found is None:
            found = self.transducer.encode(piece.encode())
        if len(piece) <= 64:
            if len(self) >= MAX_PIECES:
                self.before = dict(self)
                self.clear()
            self[piece] = found
        return found


class Utf8Decoder:
    """feed(bytes) gives the characters that are complete by now; state: the bytes of an unfinished one."""

    def __init__(self) -> None:
        self.state = b""

    @staticmethod
    def step(state: bytes, data: bytes) -> tuple[bytes, str]:
        """The state machine: (unfinished bytes, new bytes) to (unfinished bytes, characters)."""
        out, todo = [], state + data
        i, n = 0, len(todo)
        while i < n:
            lead = todo[i]
            if lead < 0x80:
                out.append(chr(lead))
                i += 1
                continue
            size, low, high = (2, 0x80, 0xBF) if 0xC2 <= lead <= 0xDF else (3, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF) if 0xE0 <= lead <= 0xEF else (4, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF) if 0xF0 <= lead <= 0xF4 else (0, 0, 0)
            k = 1
            while k < size and i + k < n and low <= todo[i + k] <= high:
                k, low, high = k + 1, 0x80, 0xBF
            if size and k == size:
                code = lead & (0xFF >> (size + 1))
                for b in todo[i + 1 : i + size]:
                    code = code << 6 | b & 0x3F
                out.append(chr(code))
            elif size and i + k == n:
                return todo[i:], "".join(out)
            else:
                out.append("�")
            i += k
        return b"", "".join(out)

    def feed(self, data: bytes) -> str:
        self.state, out = self.step(self.state, data)
        return out

    def close(self) -> str:
        self.state, rest = b"", self.state
        return "�" if rest else ""


class Decoder:
    """ids to text through the state machine; its moves by state and token are kept."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = {i: t for t, i in ranks.items()}
        self.moves: dict[int, tuple[bytes, str]] = {i: Utf8Decoder.step(b"", t) for i, t in self.token.items()}
        self.partial: dict[tuple[bytes, int], tuple[bytes, str]] = {}
        self.whole = {i: s for i, (state, s) in self.moves.items() if not state}

    def decode(self, ids: Iterable[int]) -> str:
        try:
            return "".join([self.whole[i] for i in ids])  # no token leaves a character unfinished
        except KeyError:
            pass
        state, out = b"", []
        for i in ids:
            if state:
                move = self.partial.get((state, i))
                if move is None:
                    if len(self.partial) > MAX_PAIRS:
                        self.partial.clear()
                    move = self.partial[state, i] = Utf8Decoder.step(state, self.token[i])
            else:
                move = self.moves[i]
            state = move[0]
            out.append(move[1])
        if state:
            out.append("�")
        return "".join(out)


_MADE: dict[str, tuple[Pieces, Decoder]] = {}


def _made(data: bytes) -> tuple[Pieces, Decoder]:
    key = hashlib.sha256(data).hexdigest()
    if key not in _MADE:
        ranks = read_ranks(data)
        _MADE[key] = Pieces(Transducer(ranks)), Decoder(ranks)
    return _MADE[key]


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, packed: bool = False) -> DataFrame:
    """One row per row of docs: id_col, ids array<int> (packed: binary, little-endian unsigned 32-bit),
    text (decoded from the ids again, if with_text).

    vocabulary: path of a rank file; pattern: the split into pieces. A map without a shuffle; a worker
    holds one Arrow batch and its caches.
    """
    data = docs.sparkSession.sparkContext.broadcast(bytes_of(docs.sparkSession, vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, decoder = _made(data.value)
        split = regex.compile(pattern).findall
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                codes = [b"".join(map(pieces.__getitem__, split(t or ""))) for t in part.column(1).to_pylist()]
                if packed:
                    columns = [part.column(0), pa.array(codes, pa.binary())]
                else:
                    flat = np.frombuffer(b"".join(codes), dtype="<u4").astype(np.int32)
                    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in codes])]).astype(np.int32)
                    columns = [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                if with_text:
                    columns.append(pa.array([decoder.decode(np.frombuffer(p, dtype="<u4").tolist()) for p in codes], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [id_col, "ids", "text"] if with_text else [id_col, "ids"]
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids {'binary' if packed else 'array<int>'}" + ", text string" * with_text)
