"""A Katz backoff model over whole documents, of any order; n-grams are evaluated recursively down to smoothed words.

Tokens: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, then one end. A text is preceded by order - 1 marks of its
beginning. With c: counts in training tokens, N: their number, V: the distinct ones, h: the k - 1 tokens before w,
h': h without its first,

    P1(w)     = (c(w) + 0.1) / (N + 0.1 (V + 1))         one unseen kind of token besides V: sums to one
    Pk(w | h) = d(c(h w)) c(h w) / c(h)                  if h w is in the model
              = a(h) Pk-1(w | h')                        otherwise; a(h) is 1 where nothing after h is in the model

All words and bigrams that were seen are in the model, and longer n-grams seen twice or more, the usual cutoff: a trigram
seen once is mostly a text's own. d is the Good-Turing discount of the order k, from the counts of counts n_r of its
n-grams, d(r) = ((r + 1) n_{r+1} / (r n_r) - q) / (1 - q), q = (K + 1) n_{K+1} / n_1, for r <= K and 1 beyond; K is the
largest up to 5 for which all these are in (0, 1]. a(h) is the mass that is left, that of the discounts and of n-grams below
the cutoff, divided by one less the Pk-1 of all that the model has after h: Pk(. | h) sums to one exactly, at every order. If no
mass is left (only counts beyond K follow h), the seen ones share c(h) / (c(h) + 1).

n-grams are known by 64-bit hashes. Blocks ask for their own (exchange.py). First, by short hashes, which of their n-grams
with a cutoff can reach it: most are one block's alone and go no further. Then for the counts of all others. Last
for sums of their histories, over what the model has after them: of the counts, and of those at the order below. An n-gram is added to its history's sums once, by the block that owns it. A block
that has so much of a history that the rest can't reach the cutoff has all that the model has after it, and sums that itself; it
asks only where it has something to add that another may need. Both tables are stored in parts of the hash range; the answers are read from them.

Null and empty texts have the end alone. Rows with a null id are scored, not learned from. Rows may repeat. Without
training documents every token is the unseen kind and P is 1. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import ASKS, ask, batch_of, bucket_count, delta, make_blocks, pack, undelta, unpack, with_answers
from .exchange import Keyed, exchange, keyed, levels, ordered, slim
from .scratch import stored

#: Tokens of the longest n-gram, largest count that is discounted, and what is added to words' counts.
ORDER, K, ADDED = 3, 5, 0.1
#: From so many tokens on an n-gram must occur so often to be in the model.
LONG, LEAST = 3, 2
#: Bytes of text in a block: its n-grams of all orders are in memory at once.
TEXT_BYTES = 11 << 20
#: Parts in which questions go through a tree of several levels.
TURNS = 8
#: Numbers that are summed of a history.
SUMS = 2 * (K + 1) + 1
#: The hash that stands for the beginning of a text.
BEGIN = np.uint64(0x5BD1E9955BD1E995)

_BYTES = [f"byte_{k}" for k in range(4)]
_MUL = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(7)


def token_hash(token: bytes) -> int:
    """Of a lower-cased word; the end is the empty one."""
    return xxhash.xxh64_intdigest(token)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_keys(tokens: np.ndarray, order: int) -> list[np.ndarray]:
    """Of token hashes on end, per place: the keys of the n-grams of 1 to `order` tokens that end there. The low bits of a key
    are its number of tokens."""
    with np.errstate(over="ignore"):
        grams, g = [], _mix(tokens)
        for k in range(1, order + 1):
            if k > 1:
                g = _mix(np.roll(g, 1) * _MUL + tokens)  # what comes before the first place never counts
            grams.append(g & ~_LOW | np.uint64(k))
    return grams


def begin_key(k: int) -> np.uint64:
    """The key of a text's beginning as the history of n-grams of k tokens."""
    return gram_keys(np.full(k - 1, BEGIN), k - 1)[-1][-1]


def _tokenised(rows: pa.Table) -> pa.Table:
    """Rows (id, text, learned) as (id, learned, words: all words' hashes packed, in the first row, byte_0 .. byte_3: of each token
    its word's number there). Frequent words have small numbers, words that are as frequent go by hash, and bytes of equal weight lie
    together, so that blocks pack well."""
    rows = rows.combine_chunks()
    texts = pc.fill_null(rows.column(1).combine_chunks().cast(pa.large_string()), "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashes = np.fromiter((token_hash(w.encode()) for w in [*words, ""]), dtype=np.uint64, count=len(words) + 1)
    index, offsets = coded.indices.to_numpy(), split.offsets.to_numpy()
    full = index != words.index("") if "" in words else np.ones(len(index), bool)  # beside white space at an end
    sizes = np.diff(np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]])
    ends = np.cumsum(sizes + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, len(words), dtype=np.int32)
    inner = np.ones(len(out), dtype=bool)
    inner[ends - 1] = False
    out[inner] = index[full]
    often = np.lexsort((hashes, -np.bincount(out, minlength=len(hashes))))
    place = np.empty(len(often), dtype="<i4")
    place[often] = np.arange(len(often))
    stops = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes())
    planes = [pa.Array.from_buffers(pa.binary(), len(ends), [None, stops, pa.py_buffer(x.tobytes())]) for x in place[out].view(np.uint8).reshape(-1, 4).T]
    words = pa.array([pack(delta(hashes[often])), *[None] * (len(ends) - 1)], pa.binary())
    return pa.Table.from_arrays([rows.column(0), rows.column(2), words, *planes], ["id", "learned", "words", *_BYTES])


def _tokens(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of rows that _tokenised() made: the places where texts begin and the last one ends, and all token hashes on end."""
    rows = rows.combine_chunks()
    hashes = undelta(unpack(rows.column("words")[0].as_py())[0])
    made = [rows.column(c).chunk(0).buffers() for c in _BYTES]
    offsets = np.frombuffer(made[0][1], dtype=np.int32, count=rows.num_rows + 1)
    index = np.empty((int(offsets[-1]), 4), dtype=np.uint8)
    for k, (_, _, plane) in enumerate(made):
        index[:, k] = np.frombuffer(plane, dtype=np.uint8, count=len(index))
    return offsets, hashes[index.view("<i4").ravel()]


def _kinds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys, of each key its place among them, and of each distinct one a place."""
    order, inside = ordered(keys)
    new = np.concatenate([[True], inside[1:] != inside[:-1]])[: len(keys)]
    of = np.empty(len(keys), dtype=np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    return inside[new], of, order[new]


class Block:
    """A block's distinct n-grams of all orders. Lists by order: keys, sorted; of, each token's n-gram; counts, in training
    texts here; lower, of each n-gram the one without its first token; head, the one without its last, its history; the
    number behind the last one is a text's beginning. least: n-grams of fewer tokens are left out, and so are lower and head."""

    def __init__(self, rows: pa.Table, order: int, least: int = 1):
        offsets, tokens = _tokens(rows)
        self.sizes = np.diff(offsets).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        teaches = np.array(rows.column("learned"), dtype=bool)[self.doc]
        first = np.zeros(len(tokens), dtype=bool)
        first[(np.cumsum(self.sizes) - self.sizes)] = True  # a text has a token at least
        real = np.arange(len(tokens)) + (self.doc + 1) * (order - 1)
        padded = np.full(len(tokens) + len(self.sizes) * (order - 1), BEGIN)
        padded[real] = tokens
        grams = gram_keys(padded, order)
        self.order, self.keys, self.of, self.counts, self.lower, self.head = order, [], [], [], [], []
        for k in range(order):
            if k + 1 < least:
                grams[k] = np.zeros(0, np.uint64)
                for x in (self.keys, self.of, self.counts, self.lower, self.head):
                    x.append(None)
                continue
            keys, of, at = _kinds(grams[k][real])
            self.keys.append(keys)
            self.of.append(of)
            self.counts.append(np.bincount(of[teaches], minlength=len(keys)))
            if k and least == 1:
                before = self.of[k - 1]
                self.lower.append(before[at])
                self.head.append(np.where(first[at], len(self.keys[k - 1]), before[np.maximum(at - 1, 0)]))
            else:
                self.lower.append(None)
                self.head.append(None)
            grams[k] = None
        if least == 1:
            self.end = int(np.searchsorted(self.keys[0], gram_keys(np.array([token_hash(b"")], np.uint64), 1)[0][0]))

    def long(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the n-grams with a cutoff: sorted distinct short keys, their counts, and each one's place among them."""
        short = np.uint64(64 - bits)
        parts = [x >> (short + np.uint64(3)) << np.uint64(3) | (x & _LOW) for x in self.keys[LONG - 1 :]]
        if len(parts) == 1:  # sorted as the keys are
            new = np.concatenate([[True], parts[0][1:] != parts[0][:-1]])[: len(parts[0])]
            keys, of = parts[0][new], np.cumsum(new, dtype=np.int32) - 1
        else:
            keys, of, _ = _kinds(np.concatenate([np.zeros(0, np.uint64), *parts]))
        counts = np.concatenate([np.zeros(0, np.int64), *self.counts[LONG - 1 :]])
        return keys << short, np.bincount(of, weights=counts, minlength=len(keys)).astype(np.int64), of

    def ask_long(self, bits: int, ranges: int) -> Iterator[tuple[int, bytes]]:
        keys, counts, _ = self.long(bits)
        return keyed(keys, [counts, np.ones(len(keys), np.uint8)], ranges)

    def choose(self, bits: int, answers: list[bytes]) -> None:
        """Take from the answers which n-grams to ask for: those that may reach their cutoff, and all without one."""
        keys, _, of = self.long(bits)
        told = np.concatenate([np.zeros(0, np.uint8), *(unpack(a)[0] for a in answers)]).astype(bool)
        cuts = np.cumsum([len(x) for x in self.keys[LONG - 1 :]])[:-1]
        may = np.split(told[of] if len(keys) else np.zeros(0, bool), cuts) if self.order >= LONG else []
        self.asked = [np.arange(len(x)) for x in self.keys[: LONG - 1]] + [np.flatnonzero(x) for x in may]
        every = np.concatenate([x[at] for x, at in zip(self.keys, self.asked)])
        self.merge, self.sorted = ordered(every)

    def questions(self, ranges: int) -> Iterator[tuple[int, bytes]]:
        counts = np.concatenate([x[at] for x, at in zip(self.counts, self.asked)])[self.merge]
        return keyed(self.sorted, [counts, np.ones(len(counts), np.uint8)], ranges)

    def learn(self, answers: list[bytes]) -> None:
        """Take its n-grams' counts over all documents, 0 below the cutoff, which of them are its own to add to histories'
        sums, and which of them no other block has."""
        told = [np.concatenate(x) for x in zip(*map(unpack, answers))] if answers else [np.zeros(0, np.int64)] * 3
        self.count, self.alone, self.own = [], [], []
        for out, kind, x in zip((self.count, self.alone, self.own), (np.int64, bool, bool), told):
            column = np.empty(len(self.sorted), dtype=kind)
            column[self.merge] = x
            for keys, at, part in zip(self.keys, self.asked, np.split(column, np.cumsum([len(a) for a in self.asked])[:-1])):
                whole = np.zeros(len(keys), dtype=kind)
                whole[at] = part
                out.append(whole)

    def totals(self, k: int) -> np.ndarray:
        """How often the histories of n-grams of k + 1 tokens occur; a text begins as often as it ends."""
        return np.append(self.count[k - 1], self.count[0][self.end])

    def here(self, k: int) -> np.ndarray:
        """Of which histories of n-grams of k + 1 tokens this block has all that the model has after them: what the other
        blocks have of it is less than the cutoff."""
        return self.totals(k) - np.append(self.counts[k - 1], self.counts[0][self.end]) < self.cutoff(k)

    @staticmethod
    def cutoff(k: int) -> int:
        return LEAST if k + 1 >= LONG else 1

    def summed(self, whole: bool) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        """Per order from two on: histories, and what this block's own n-grams add to each, in whole numbers; or if `whole`, those
        that this block has all of, and all that the model has after them. SUMS of numbers: how many n-grams occur once, twice,
        ... K times, the occurrences of the others, the same of the n-grams below, how many in all."""
        out = []
        for k in range(1, self.order):
            mine = np.flatnonzero((self.count[k] > 0) & self.here(k)[self.head[k]] if whole else self.own[k])
            at, head = np.unique(self.head[k][mine], return_inverse=True)
            made = []
            for c in (self.count[k][mine], self.count[k - 1][self.lower[k][mine]]):
                made += [np.bincount(head[c == r], minlength=len(at)) for r in range(1, K + 1)]
                more = c > K
                made.append(np.bincount(head[more], weights=c[more], minlength=len(at)).astype(np.int64))
            out.append((at, [slim(x) for x in (*made, np.bincount(head, minlength=len(at)))]))
        return out

    def heads(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """The sorted keys of the histories to ask for, which these are by order, and the order that sorts them. A history
        that is rarer than the cutoff of what follows it isn't asked for, nor one that this block can sum itself, but where it
        has something to add and other blocks have the history: they may have it in texts that don't teach."""
        asked, every = [], []
        for k in range(1, self.order):
            adds = np.zeros(len(self.keys[k - 1]) + 1, dtype=bool)
            adds[self.head[k][self.own[k]]] = True
            adds &= ~np.append(self.alone[k - 1], False)
            at = np.flatnonzero((self.totals(k) >= self.cutoff(k)) & (adds | ~self.here(k)))
            asked.append(at)
            every.append(np.append(self.keys[k - 1], begin_key(k + 1))[at])
        keys = np.concatenate([np.zeros(0, np.uint64), *every])
        # the same keys mean histories of one order only: their low bits are the number of their tokens
        order, keys = ordered(keys)
        return keys, asked, order

    def sums(self, ranges: int) -> Iterator[tuple[int, bytes]]:
        keys, asked, order = self.heads()
        columns: list[list[np.ndarray]] = [[np.zeros(0, np.uint8)] for _ in range(SUMS)]
        for (at, mine), wanted in zip(self.summed(False), asked):
            place = np.minimum(np.searchsorted(wanted, at), max(len(wanted) - 1, 0))
            there = wanted[place] == at if len(wanted) else np.zeros(len(at), bool)
            for column, x in zip(columns, mine):
                whole = np.zeros(len(wanted), dtype=x.dtype)
                whole[place[there]] = x[there]
                column.append(whole)
        return keyed(keys, [np.concatenate(c)[order] for c in columns], ranges)

    def scores(self, model: Model, answers: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n_known, base score and score of its documents."""
        told = [np.concatenate(x) for x in zip(*map(unpack, answers))] if answers else [np.zeros(0, np.int64)] * SUMS
        _, asked, order = self.heads()
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        ends = np.cumsum([len(at) for at in asked])
        masses = []
        for k, ((at, mine), wanted, end) in enumerate(zip(self.summed(True), asked, ends), 1):
            held, low = np.zeros(len(self.keys[k - 1]) + 1), np.zeros(len(self.keys[k - 1]) + 1)
            held[wanted], low[wanted] = model.masses(k, [x[back[end - len(wanted) : end]] for x in told])
            held[at], low[at] = model.masses(k, mine)
            masses.append((held, low))
        p = one = model.word(self.count[0])
        kept = total = None
        for k in range(1, self.order):
            before = kept, total
            total, (held, low) = self.totals(k), masses[k - 1]
            if k == 1:
                mass = low / (model.size + ADDED * (model.kinds + 1))
            else:  # a history's own history is the n-gram without its first token; the beginning's is the beginning
                shorter = np.append(self.lower[k - 1], len(self.keys[k - 2]))
                mass = before[0][shorter] * low / np.maximum(before[1][shorter], 1)
            kept, weight = model.history(total, held, mass)
            head, c = self.head[k], self.count[k]
            p = np.where(c > 0, model.kept(k, c) * kept[head] * c / np.maximum(total[head], 1), weight[head] * p[self.lower[k]])
        add = lambda x: np.bincount(self.doc, weights=x, minlength=len(self.sizes))
        return add(self.count[0][self.of[0]] > 0).astype(np.int64), add(np.log10(one)[self.of[0]]), add(np.log10(p)[self.of[-1]])


def _reachable(order: int, bits: int):
    def run(question: Keyed) -> tuple[bytes, None, list[int]]:
        """Which short keys may stand for an n-gram seen twice or more, and by order the number of the others seen once."""
        count, asks = question.numbers
        may = (asks > 1) | (count >= LEAST)
        of = question.keys >> np.uint64(64 - bits) & _LOW
        return pack(may.astype(np.uint8)), None, [int((~may & (count == 1) & (of == k)).sum()) for k in range(LONG, order + 1)]

    return run


def _counted(order: int):
    def run(question: Keyed) -> tuple[bytes, bytes, list[int]]:
        """The answer, the table and N, V, and the counts of counts of each order from two on, of a bucket."""
        (count, asks), of = question.numbers, question.keys & _LOW
        figures = [int(count[of == 1].sum()), int(((count > 0) & (of == 1)).sum())]
        for k in range(2, order + 1):
            figures += np.bincount(np.minimum(count[of == k], K + 2), minlength=K + 3)[1 : K + 2].tolist()
        count = np.where((of >= LONG) & (count < LEAST), 0, count)
        seen = count > 0
        return pack(slim(count), (asks == 1).astype(np.uint8), seen.astype(np.uint8)), pack(delta(question.keys[seen]), slim(count[seen])), figures

    return run


def _summed(question: Keyed) -> tuple[bytes, bytes, list[int]]:
    seen = question.numbers[-1] > 0
    return pack(*map(slim, question.numbers)), pack(delta(question.keys[seen]), *(slim(x[seen]) for x in question.numbers)), []


def discounts(few: list[int]) -> np.ndarray:
    """d(1) .. d(k) from n_1 .. n_{K+1}, for the largest k that gives proper ones; none if there is no such k."""
    n = np.array([0, *few], dtype=np.float64)
    for k in range(len(few) - 1, 0, -1):
        if (n[1 : k + 2] <= 0).any():
            continue
        r = np.arange(1, k + 1)
        q = (k + 1) * n[k + 1] / n[1]
        if q >= 1:
            continue
        d = ((r + 1) * n[r + 1] / (r * n[r]) - q) / (1 - q)
        if (d > 0).all() and (d <= 1).all():
            return d
    return np.zeros(0)


@dataclass
class Model:
    """What all blocks need: N, V and each order's discounts, from two tokens on; grams and sums are the stored tables."""

    size: int
    kinds: int
    discount: list[np.ndarray]
    grams: DataFrame | None = None
    sums: DataFrame | None = None

    def word(self, count: np.ndarray) -> np.ndarray:
        return (count + ADDED) / (self.size + ADDED * (self.kinds + 1))

    def kept(self, k: int, count: np.ndarray) -> np.ndarray:
        """The discounts of counts of n-grams of k + 1 tokens."""
        d = np.concatenate([[1.0], self.discount[k - 1], [1.0]])
        return d[np.minimum(count, len(d) - 1)]

    def masses(self, k: int, sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of histories of n-grams of k + 1 tokens: the discounted counts of what follows, and of the n-grams below."""
        held, low = sums[K].astype(np.float64), sums[2 * K + 1].astype(np.float64)
        for r in range(1, K + 1):
            held += float(self.kept(k, np.array(r))) * r * sums[r - 1]
            low += (1.0 if k == 1 else float(self.kept(k - 1, np.array(r)))) * r * sums[K + r]
        return held, low + ADDED * sums[-1] if k == 1 else low

    def history(self, total: np.ndarray, held: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of histories the share of the discounted counts that is kept, and the backoff weight. held: the discounted counts of
        what the model has after them, mass: what the order below gives to that."""
        left = np.where(held > 0, 1 - held / np.maximum(total, 1), 1.0)
        none = left <= 1e-12
        kept = np.where(none, total / (total + 1.0), 1.0)
        return kept, np.where(none, 1 / (total + 1.0), left) / (1 - np.where(held > 0, mass, 0))


def score_documents(docs: DataFrame, teaches: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> tuple[DataFrame, Model]:
    """Learn n-grams of up to `order` tokens (2 to 7) from the rows for which `teaches` holds, then score all: id_col,
    n_tokens, n_known, base_score (words alone), score (log10 probability of the text); and the model."""
    if not 2 <= order <= 7:
        raise ValueError("an order is from 2 to 7")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_0"), F.col(text_col).alias("_1"), (F.col(id_col).isNotNull() & F.coalesce(teaches, F.lit(False))).alias("_2"))
    blocks = make_blocks(rows, 1, "ngrams", TEXT_BYTES, _tokenised)
    n, size = blocks.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).head()
    buckets = bucket_count(blocks)
    ranges, several = levels(buckets)[0], len(levels(buckets)) > 1
    bits = min(64, 8 + int(size // 4 + 1).bit_length())  # a short key has company by chance with probability 1/32 about

    def data(answers: pa.Table, turn: int) -> list[bytes]:
        return answers.filter(pc.equal(answers.column("turn"), turn)).sort_by("bucket").column("data").to_pylist()

    def block_of(table: pa.Table, answers: pa.Table) -> Block:
        block = Block(table, order)
        block.choose(bits, data(answers, 0))
        if 1 in answers.column("turn").to_pylist():
            block.learn(data(answers, 1))
        return block

    def asks(questions: Callable[[Block], Iterator[tuple[int, bytes]]]):
        def run(block: int, table: pa.Table, answers: pa.Table) -> pa.Table:
            return pa.Table.from_batches([batch_of([(block, b, q) for b, q in questions(block_of(table, answers))])])

        return run

    def turned(answers: DataFrame, turn: int) -> DataFrame:
        """Answers with the number of their question; those that come down a tree are written, as they are read twice."""
        return (stored(answers, "answers") if several else answers).withColumn("turn", F.lit(turn))

    first = ask(blocks, lambda _, table: Block(table, order, LONG).ask_long(bits, ranges))
    may, once = exchange(first, n, buckets, Keyed, _reachable(order, bits), "ngrams-seen")
    # a block that asks nothing has an answer too
    may = turned(may, 0).unionByName(blocks.select("block", F.lit(-1).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("data"), F.lit(-1).alias("turn")))
    counts, grams = exchange(with_answers(blocks, may, asks(lambda b: b.questions(ranges)), ASKS), n, buckets, lambda d: Keyed(d, owned=True), _counted(order), "ngrams", turns=TURNS)
    total = lambda table, i: F.coalesce(F.sum(F.get("figures", F.lit(i))), F.lit(0))
    figures = [int(x) for x in grams.agg(*(total(grams, i) for i in range(2 + (order - 1) * (K + 1)))).head()]
    alone = [0] * (LONG - 2) + ([int(x) for x in once.agg(*(total(once, i) for i in range(order - LONG + 1))).head()] if order >= LONG else [])
    few = [figures[2 + k * (K + 1) : 2 + (k + 1) * (K + 1)] for k in range(order - 1)]
    plain = Model(figures[0], figures[1], [discounts([f[0] + a, *f[1:]]) for f, a in zip(few, alone)])
    both = may.unionByName(turned(counts, 1))
    sums, histories = exchange(with_answers(blocks, both, asks(lambda b: b.sums(ranges)), ASKS), n, buckets, Keyed, _summed, "histories", once=True, turns=TURNS)
    every = both.unionByName(sums.withColumn("turn", F.lit(2)))  # read once

    def last(block: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        own = block_of(table, answers)
        n_known, base, score = own.scores(plain, data(answers, 2))
        return pa.Table.from_arrays([table.column(0), pa.array(own.sizes), pa.array(n_known), pa.array(base), pa.array(score)], [id_col, "n_tokens", "n_known", "base_score", "score"])

    model = Model(plain.size, plain.kinds, plain.discount, grams, histories)
    return with_answers(blocks, every, last, f"`{id_col}` {kind}, n_tokens long, n_known long, base_score double, score double"), model


def ngram_tables(model: Model) -> tuple[DataFrame, DataFrame]:
    """The stored tables as rows, with the number of tokens and the key as gram_keys() makes it: n-grams and their count;
    histories that a block couldn't sum alone, and of what the model has after them how many kinds occur once, twice, ..., the
    occurrences of the rest, the same of the n-grams below, and all kinds."""

    def rows(names: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    keys, *numbers = unpack(data)
                    keys = undelta(keys)
                    yield pa.RecordBatch.from_arrays([pa.array((keys & _LOW).astype(np.int32)), pa.array(keys.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in numbers)], ["tokens", "key", *names])

        return run

    names = [*(f"kinds_{r}" for r in range(1, K + 1)), "more", *(f"below_{r}" for r in range(1, K + 1)), "more_below", "kinds"]
    kinds = lambda names: "tokens int, key long, " + ", ".join(f"{n} long" for n in names)
    return model.grams.select("data").mapInArrow(rows(["count"]), kinds(["count"])), model.sums.select("data").mapInArrow(rows(names), kinds(names))
