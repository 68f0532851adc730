import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from wavedeck.llm import byte_bpe
from wavedeck.llm.byte_bpe import Decoder, Pieces, Transducer, Utf8Decoder, encode_texts, merged, read_ranks

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = read_ranks(open(PATH, "rb").read())
PIECES, DECODER = Pieces(Transducer(RANKS)), Decoder(RANKS)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SPLIT = regex.compile(P.PATTERN).findall


def ids(text):
    packed = b"".join(map(PIECES.__getitem__, SPLIT(text)))
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdeinrst THE'sll  \n\t,.019é日本語🙂\x1c\x85　́"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_are_the_librarys(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert DECODER.decode(ids(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=14))
def test_transducer_is_the_definition(piece):
    expected = [RANKS[piece]] if piece in RANKS else merged(RANKS, piece)
    got = Transducer.encode(PIECES.transducer, piece)
    assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == expected


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=30), st.integers(1, 5))
def test_streaming_decode_is_the_whole_decode(data, step):
    decoder = Utf8Decoder()
    got = "".join(decoder.feed(data[i : i + step]) for i in range(0, len(data), step)) + decoder.close()
    assert got == data.decode(errors="replace")


def test_states_can_be_dropped(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MAX_STATES", 5)
    monkeypatch.setattr(byte_bpe, "MAX_PIECES", 3)
    monkeypatch.setattr(byte_bpe, "MAX_PAIRS", 3)
    small = Pieces(Transducer(RANKS))
    text = "unbelievable transducers determinise lazily, überall и везде"
    packed = b"".join(map(small.__getitem__, SPLIT(text)))
    assert packed == b"".join(i.to_bytes(4, "little") for i in LIBRARY.encode_ordinary(text))


@pytest.mark.parametrize("packed", [False, True])
def test_rows(odd, empty, odd_docs, packed):
    got = encode_texts(odd, PATH, P.PATTERN, packed=packed).collect()
    as_ids = lambda x: [int.from_bytes(x[i : i + 4], "little") for i in range(0, len(x), 4)] if packed else x
    assert sorted((r.doc_id or -1, as_ids(r.ids), r.text) for r in got) == sorted((d[0] or -1, LIBRARY.encode_ordinary(d[1] or ""), d[1] or "") for d in odd_docs)
    assert encode_texts(empty, PATH, P.PATTERN).count() == 0


def test_states_are_bounded_inside_a_piece(monkeypatch):
    import random

    import public_tokenizers as P

    from wavedeck.llm import byte_bpe
    from wavedeck.llm.byte_bpe import Transducer, merged, read_ranks

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = read_ranks(f.read())
    rng = random.Random(6)
    piece = "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(3000)).encode()
    expected = b"".join(int(i).to_bytes(4, "little") for i in merged(ranks, piece))
    monkeypatch.setattr(byte_bpe, "MAX_STATES", 100)
    made = Transducer(ranks)
    assert made.encode(piece) == expected and len(made.states) <= 102
