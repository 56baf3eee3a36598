"""SentencePiece by the table of prefixes, beside the library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import pieces
from weftline.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
CODEC, LIBRARY = pieces.Codec(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = [
    "", " ", "   ", "  a", "a  ", "▁", "▁▁a", "▁ x▁", "a\x00b", "Ω x ΩΩ", "🙂🙂 ok", "\n\n\t x", "<s> </s> <unk> <0x41>", "a" * 20, "the" * 50, "x" * 3000, " " * 70 + "q", "一二三 ゼ梦", "ﬁ½", "�", "=---=" * 9,
    "q́é", "word, word.\nWord|", "a1b22c", "​‍ ", "İstanbul ß",
]


def check(text):
    want = LIBRARY.encode(text, add_eos=True)
    got = CODEC.encode(text)
    assert got == want
    shown = LIBRARY.decode(want)
    assert CODEC.pieces.decode(got) == shown
    assert CODEC.digests(text) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())


@pytest.mark.parametrize("at", range(len(ODD)))
def test_odd(at):
    check(ODD[at])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("abethin ▁Ωé一\n0=-._/", max_size=80)))
def test_any_text(text):
    check(text)


def test_stretches(monkeypatch):
    """A long text comes in parts of whole chunks, and spaces by the run do not part."""
    r = random.Random(5)
    text = "".join(r.choice(["the ", "▁", "  ", "Wort,", "é", "\n", "x" * 40]) for _ in range(3000))
    for size in (1, 7, 1000):
        monkeypatch.setattr(pieces, "STRETCH", size)
        assert "".join(pieces.stretches(text)) == pieces.SPACE + text.replace(" ", pieces.SPACE)
        check(text)


def test_full_caches(monkeypatch):
    for name in ("CACHE_CHUNKS", "CACHE_PARTS", "CACHE_PAIRS"):
        monkeypatch.setattr(pieces, name, 3)
    full = pieces.Codec(PATH)
    text = "some words of a text, and again some words of a text"
    assert full.digests(text) == CODEC.digests(text) == full.digests(text)
    assert len(full.cache) <= 3 and len(full.parts) <= 3


def test_long_word_is_linear():
    r = random.Random(3)
    word = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/") for _ in range(400_000))
    assert CODEC.encode(word) == LIBRARY.encode(word, add_eos=True)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 31_999), st.integers(3, 258), st.integers(259, 300)), max_size=12))
def test_decoding_any_ids(ids):
    assert CODEC.pieces.decode(ids) == LIBRARY.decode(ids)


def test_compatible_pairs():
    """Each pair test is the library's own encoding of the two pieces' text."""
    r = random.Random(1)
    p = CODEC.pieces
    tokens = [t for t in p.left if pieces.SPACE not in p.names[t]]
    for _ in range(3000):
        a, b = r.choice(tokens), r.choice(tokens)
        raw = LIBRARY.encode("\n" + p.names[a] + p.names[b])  # behind a line's end nothing merges with what is before
        assert p.compatible(a, b) == (raw[-2:] == [a, b] and len(raw) == len(LIBRARY.encode("\n")) + 2)


def test_frames(spark):
    rows = [(1, "Hello  world", "k", 1), (1, "Hello  world", "k", 1), (2, None, None, None), (None, "", "x", 2), (3, "é" * 5000, "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, ids int")
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.round_trips(docs, PATH).collect()), key=repr)
    assert got == sorted(((i, *CODEC.digests(t or "")) for i, t, _, _ in rows), key=repr)
    whole = {(r.doc_id, tuple(r.ids), r.decoded) for r in pieces.encode_documents(docs, PATH).collect()}
    assert whole == {(i, tuple(LIBRARY.encode(t or "", add_eos=True)), t or "") for i, t, _, _ in rows}
    assert pieces.round_trips(docs.limit(0), PATH).count() == 0


def test_query_is_the_library(spark):
    sf = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = LIBRARY.encode(r.text or "", add_eos=True)
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op12_sentencepiece_roundtrip"](spark, sf).collect()]
    assert sorted(got) == sorted(want)
