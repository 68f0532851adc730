import hashlib

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from wavedeck.llm.chat_format import escape, format_conversations, parse, read_back, render, unescape
from wavedeck.llm.queries import op3_chat_masks

PATH = P.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("<|>\\sep endtar", max_size=8), st.text("<|>\\sep endtar\n", max_size=30))))
def test_round_trip(turns):
    assert all(unescape(escape(t)) == t and "<|" not in escape(t) for _, t in turns)
    text, spans = render(turns)
    assert parse(text) == turns
    assert [unescape(text[a:b]) for a, b in spans] == [t for _, t in turns]


def expected(rows):
    by = {}
    for k, (conv, turn, role, text) in enumerate(rows):
        by.setdefault((conv, k) if conv is None else (conv, 0), []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for (conv, _), turns in by.items():
        turns = [t[2:] for t in sorted(turns)]
        said = "".join(t for r, t in turns if r == "assistant")
        out.append((conv if conv is not None else -1000, len(turns), SHA("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), SHA(said)))
    return sorted(out)


def got(df):
    return sorted((-1000 if r.conv_id is None else r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect())


def test_conversations_read_back(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    assert got(op3_chat_masks(spark, sf_dir)) == expected(rows)


def test_rows(spark):
    rows = [(1, 2, "assistant", "<|end|> \\ <|start|>assistant<|sep|>"), (1, 1, "user", None), (1, None, None, "x"), (1, 3, "assistant", ""), (1, 4, "assistant", " é🙂日本 <|endoftext|>\n "), (2, 0, "assistant", "<"), (2, 0, "assistant", "|" * 9), (2, 0, "assistant", "|" * 9), (None, 1, "assistant", "a"), (None, 2, "user", "b"), (3, 0, "user", "w " * 30000), (3, 1, "assistant", "z" * 30000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    made = format_conversations(df, PATH)
    assert got(read_back(made)) == expected(rows)
    assert read_back(format_conversations(df.limit(0), PATH)).count() == 0
