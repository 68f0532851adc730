"""Chat conversations as one formatted text with offset-aligned loss masks.

Template, per turn: `<|start|>` role `<|sep|>` text `<|end|>`. Inside roles and texts `\\` becomes `\\\\` and
`<|` becomes `<\\|`: no control string can stand there, and the original is read back exactly.

A conversation is rendered whole and encoded once, with offsets; the four control strings are special tokens,
so no token reaches over a turn's border. The sorted spans of the turns to learn from are intersected with the
token spans by binary search.

Rows go by turn (nulls first), then role, then text. Null roles and texts are empty. Rows without a conv_id
are conversations of one turn each. An empty table gives no rows. A conversation is one record and lies in one
task; beside it a task holds one Arrow batch, as its rows arrive in order.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer, processors

from .scratch import bytes_of

#: Control strings of the template; fixed values.
START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"

_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.DOTALL)
_MADE: dict[str, Tokenizer] = {}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the span of each turn's escaped text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role) + SEP, escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        at = spans[-1][1] + len(END)
        parts += [head, body, END]
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def masked(spans: list[tuple[int, int]], starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which tokens lie in one of the sorted, disjoint spans: a binary search a token."""
    if not spans:
        return np.zeros(len(starts), dtype=bool)
    lows, highs = np.array(spans).T
    k = np.searchsorted(lows, starts, side="right") - 1
    return (k >= 0) & (stops <= highs[np.maximum(k, 0)]) & (starts < stops)


def tokenizer(data: bytes) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hashlib.sha256(data).hexdigest()
    if key not in _MADE:
        made = Tokenizer.from_str(data.decode())
        made.post_processor = processors.ByteLevel(trim_offsets=False)
        made.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, SEP, END)])
        _MADE[key] = made
    return _MADE[key]


SCHEMA = "formatted string, ids array<int>, starts array<int>, stops array<int>, loss array<boolean>"


def format_conversations(rows: DataFrame, vocabulary: str, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """rows(conv_id, turn, role, text) -> per conversation: conv_id, formatted, and per token ids, starts,
    stops (code points) and loss (whether it is under the mask)."""
    data = rows.sparkSession.sparkContext.broadcast(bytes_of(rows.sparkSession, vocabulary))
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).otherwise(0)
    dealt = rows.withColumn("_alone", alone).repartition("conv_id", "_alone").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tokenizer(data.value)

        def done(ids: list, of: list[list[tuple[str, str]]]) -> pa.RecordBatch:
            columns: list[list] = [[], [], [], [], []]
            for turns in of:
                text, spans = render(turns)
                e = made.encode(text, add_special_tokens=False)
                starts, stops = np.array(e.offsets, dtype=np.int64).reshape(-1, 2).T
                loss = masked([s for s, (role, _) in zip(spans, turns) if role in learn_from], starts, stops)
                for column, v in zip(columns, (text, e.ids, starts.tolist(), stops.tolist(), loss.tolist())):
                    column.append(v)
            kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
            return pa.RecordBatch.from_arrays([pa.array(ids, key_type), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["conv_id", "formatted", "ids", "starts", "stops", "loss"])

        ids: list = []
        of: list[list[tuple[str, str]]] = []
        key_type, size = pa.int64(), 0
        for batch in batches:
            key_type = batch.schema.field(0).type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if not ids or conv is None or ids[-1] != conv:
                    if size > 1_000_000:
                        yield done(ids, of)
                        ids, of, size = [], [], 0
                    ids.append(conv)
                    of.append([])
                of[-1].append((role, text))
                size += len(text)
        if ids:
            yield done(ids, of)

    return dealt.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, {SCHEMA}")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what format_conversations made, read from its output alone: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, n_tokens, n_loss_tokens."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for text, starts, stops, loss in zip(*(batch.column(c) for c in ("formatted", "starts", "stops", "loss"))):
                text = text.as_py()
                turns = parse(text)
                on = np.array(loss.values, dtype=bool)
                a, b = (np.array(x.values, dtype=np.int64)[on] for x in (starts, stops))
                # tokens that share a character overlap: a run goes on where a token doesn't start after the last one's end
                new = np.flatnonzero(a[1:] > b[:-1]) + 1
                runs = zip(a[[0, *new]].tolist(), b[[*(new - 1), -1]].tolist()) if len(a) else ()
                learnt = "".join(unescape(text[x:y]) for x, y in runs)
                said = "".join(f"{role}\n{said}\n" for role, said in turns)
                for column, v in zip(columns, (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text), len(on), int(on.sum()))):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, pa.string() if "sha" in n else pa.int64()) for c, n in zip(columns, names))], ["conv_id", *names])

    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"]
    return formatted.select("conv_id", "formatted", "starts", "stops", "loss").mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{n} {'string' if 'sha' in n else 'long'}" for n in names))
