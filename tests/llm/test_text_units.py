"""Unit tests of the training-data operators' cores, without Spark."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm import components, licenses, packing, pii, quality, recompress, simhash, suffixes
from weftline.llm.bpe import Codec

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
CODECS = {f: (Codec(public_tokenizers.path(f)), Tokenizer.from_file(public_tokenizers.path(f))) for f in FILES}
ODD = [
    "", " ", "a<|endoftext|>b", "<|startoftext|> x", "x   y\n\n z \t", "I'll don'T", "ΣΑΣ İstanbul ﬁ Ω ½ 一二  x　 y", "a\x1cb \x85", "éx" * 3, "q" * 5000,
    "🙂 👩‍👩‍👧 x", "a<|endoftext|>", "ǅ ß ẞ", "\x1d \x1e<|endoftext|>", "foo\n bar  baz", "a, b| c.", "...", " lead", "trail ",
]


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.sampled_from(ODD)), max_size=4))
def test_codec(name, texts):
    codec, lib = CODECS[name]
    got, want = codec.encode(texts), [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert got == want
    assert [codec.decode(x) for x in got] == [lib.decode(x, skip_special_tokens=False) for x in want]


@pytest.mark.parametrize("name", FILES)
def test_codec_odd(name):
    codec, lib = CODECS[name]
    assert codec.encode(ODD) == [e.ids for e in lib.encode_batch(ODD, add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.sampled_from(ODD), st.text("ab ,.\n\t'1é", max_size=80)), max_size=5))
def test_packed_ids(name, texts):
    import pyarrow as pa

    codec, lib = CODECS[name]
    want = [packing.pack_ids(lib.encode(t or "", add_special_tokens=False).ids) for t in texts]
    held, codec.cache = codec.cache, {}
    try:
        assert codec.packed(pa.array(texts, pa.string())) == want
        assert codec.packed(pa.array(texts, pa.string())) == want
    finally:
        codec.cache = held


def test_first_fit_decreasing():
    r = random.Random(2)
    sizes = sorted((r.randint(1, 100) for _ in range(300)), reverse=True)
    free = []
    want = []
    for s in sizes:
        k = next((i for i, f in enumerate(free) if f >= s), len(free))
        if k == len(free):
            free.append(100)
        want.append((k, 100 - free[k]))
        free[k] -= s
    assert list(zip(*packing.first_fit_decreasing(sizes, 100))) == want


def test_suffix_sort():
    r = random.Random(3)
    data = bytes(r.choice(b"ab") for _ in range(400))
    start = np.array(sorted(r.sample(range(300), 120)))
    length = np.array([r.randint(1, 100) for _ in start])
    group = np.sort(np.array([r.randrange(4) for _ in start]))
    s = suffixes.SuffixSort(np.frombuffer(data, np.uint8), start, length, group)
    want = sorted(range(len(start)), key=lambda i: (group[i], data[start[i] : start[i] + length[i]], i))
    body = lambda i: (group[i], data[start[i] : start[i] + length[i]])
    assert [body(i) for i in s.order] == [body(i) for i in want]


def literal_windows(words, width):
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


@pytest.mark.parametrize("letters", [2, 5, 1000])
def test_spellings_are_equal_where_strings_are(letters):
    r = random.Random(letters)
    w = recompress.WIDTH
    part = [b"w%d" % r.randrange(letters) for _ in range(80)]
    texts = [[b"w%d" % r.randrange(letters) for _ in range(60)] + part, part + [b"x"] * 60, part[5:] + part, [b"x"] * 90, [b"a", b"b"] * 50]
    words, offsets = [x for t in texts for x in t], np.cumsum([0, *map(len, texts)])
    begin = np.concatenate([np.arange(a, b - w + 1) for a, b in zip(offsets, offsets[1:])])
    two, rounds = recompress.spellings(recompress.names_of(words), offsets, begin, begin + w)
    kinds = {}
    for key, text in zip(map(tuple, two.tolist()), [x for t in texts for x in literal_windows(t, w)]):
        kinds.setdefault(key, set()).add(text)
    assert all(len(v) == 1 for v in kinds.values()) and len(kinds) == len({next(iter(v)) for v in kinds.values()})
    assert rounds >= 5 or letters < 1000
    # equal windows name equal anchors
    doc, first, count, place, anchor = recompress._spans(recompress.names_of(words), offsets)
    at = {}
    for f, c, a in zip(first.tolist(), count.tolist(), anchor.tolist()):
        for i in range(f, f + c):
            at.setdefault(b" ".join(words[i : i + w]), set()).add(a)
    assert sum(count) == len(begin) and all(len(v) == 1 for v in at.values())


def test_ambiguous_names_are_told_apart_by_words():
    plain = recompress.names_of
    words = [b"w%d" % i for i in range(40)] + [b"cat"] + [b"w%d" % i for i in range(40)] + [b"dog"]
    names = plain([b"cat" if x == b"dog" else x for x in words])
    offsets, begin, end = np.array([0, 41, 82]), np.array([3, 44]), np.array([41, 82])
    two, _ = recompress.spellings(names, offsets, begin, end)
    told, _ = recompress.spellings(names, offsets, begin, end, plain([b"cat"]), lambda a, b: words[a:b])
    assert (two[0] == two[1]).all() and (told[0] != told[1]).any()


def test_names_in_are_those_of_split_words(monkeypatch):
    r = random.Random(7)
    texts = [bytes(r.choice(b"ab \t\r\x0b\x1c\x85\xc3\xa9") for _ in range(n)) for n in (0, 1, 5, 300, 4000)]
    for chunk in (1 << 21, 64):
        monkeypatch.setattr(recompress, "CHUNK", chunk)
        names, offsets = recompress.names_in(texts)
        assert [b - a for a, b in zip(offsets, offsets[1:])] == [len(t.split()) for t in texts]
        assert names.tolist() == [recompress.names_of([w])[0] for t in texts for w in t.split()]


def test_repeated_windows_under_colliding_hashes(monkeypatch):
    r = random.Random(8)
    w, g = suffixes.WIDTH, suffixes.GRAM
    anchor, common = bytes(r.choice(b"xy") for _ in range(g)), [bytes(r.choice(b"ab") for _ in range(260)) for _ in range(3)]
    bodies = []
    for i in range(24):
        left, right = common[i % 3][-100 - i % 5 :], common[(i // 3) % 3][: 150 - i % 7]
        whole, o = left + anchor + right, len(left)
        low, high = max(0, o - (w - g)), min(o, len(whole) - w)
        bodies.append((o - low, whole[low : high + w]))
    bodies = list(dict.fromkeys(bodies))
    size = np.array([len(b) for _, b in bodies])
    data, begin, off = np.frombuffer(b"".join(b for _, b in bodies), np.uint8), np.cumsum(size) - size, np.array([o for o, _ in bodies])
    count = size - w + 1
    want = Counter()
    for b, c, o, k in zip(begin, count, off, range(len(off))):
        for i in range(c):
            if 0 <= o - i <= w - g:
                want[(o - i, data[b + i : b + i + w].tobytes())] += 1
    expected = sorted((k, i) for k, (b, c, o) in enumerate(zip(begin, count, off)) for i in range(c) if want.get((o - i, data[b + i : b + i + w].tobytes()), 0) > 1)
    for primes in (suffixes.Hashes.PRIMES, (10007, 10009)):
        monkeypatch.setattr(suffixes.Hashes, "PRIMES", primes)
        rows, windows = suffixes.repeated_windows(data, begin, count, off, np.zeros(len(off), np.int64))
        assert sorted(zip(rows.tolist(), windows.tolist())) == expected and expected


def test_split_keeps_windows_together():
    import pyarrow as pa

    r = random.Random(9)
    common = bytes(r.choice(b"abc") for _ in range(230))
    bodies = [bytes([65 + i]) * 20 + common + bytes([97 + i]) * 15 for i in range(6)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7] * 6), pa.array([60] * 6), pa.array(bodies, pa.binary()), pa.array([1] * 6), pa.array(range(6)), pa.array([1000] * 6)], names=["b", "off", "body", "n", "h", "first"]
    )
    w = suffixes.WIDTH
    whole = Counter(b[i : i + w] for b in bodies for i in range(len(b) - w + 1))
    for step in (21, 2, 1):
        (out,) = suffixes._split(step)([batch])
        seen, where = Counter(), {}
        for b, off, body, h, first in zip(*(out.column(i).to_pylist() for i in (0, 1, 2, 4, 5))):
            assert bodies[h][first - 1000 :].startswith(body) and bodies[h].find(common) + 40 == off + first - 1000
            for i in range(len(body) - w + 1):
                seen[body[i : i + w]] += 1
                where.setdefault((off - i, body[i : i + w]), set()).add(b)
        assert seen == whole and all(len(v) == 1 for v in where.values())


def test_fingerprints():
    assert simhash.fingerprint_arrays([b"", b" \n"]).tolist() == [0, 0]
    one = simhash.fingerprint_arrays([b"One TWO", b"one two"])
    assert one[0] == one[1] == simhash.xxhash.xxh64_intdigest(b"one two", 42)


def test_links_within():
    r = random.Random(5)
    fp = np.array([r.getrandbits(64) for _ in range(20)], np.uint64)
    near = fp ^ np.uint64(0b10010001)
    u, v = simhash._links_within(32 << 32, np.concatenate([fp, near]))
    assert len(u) == 20


def test_spanning():
    u, v = components.spanning(np.array([1, 5, 3, 9]), np.array([2, 3, 2, 8]))
    assert dict(zip(u.tolist(), v.tolist())) == {2: 1, 3: 1, 5: 1, 9: 8}


def test_quality_counts():
    text = "a b c a b c\n\na b c a b c\n x|$ "
    n, chars, symbols, dup, rep, *_ = quality.measure(text, "en")
    assert (n, chars, symbols, dup, rep) == (13, 15, 2, 1, 12)
    assert quality.measure("", None)[:5] == (0, 0, 0, 0, 0)


def test_distance_bounds():
    d = quality.distance(np.array([[1.0, 0], [0, 1], [0, 0]]), np.array([1.0, 0]))
    assert d[0] == 0 and d[1] == pytest.approx(1)


def test_base_spans():
    text = "mail a.b+c@ex-1.org, 10.0.0.256 10.0.0.255, 4111 1111 1111 1111 and +1 (555) 010-9999 x@y"
    assert [(k, text[a:b]) for a, b, k in sorted(pii.base_spans(text))] == [
        ("email", "a.b+c@ex-1.org"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 010-9999")
    ]
    assert pii.base_spans("") == []


def test_long_texts_are_linear():
    for text in ("4" * 200_000, "a" * 200_000, "a." * 100_000, "+1" * 100_000, "@" * 100_000, "1.2.3." * 30_000):
        pii.find([text], *pii.model())


def test_pii_model_holds_out():
    trees, limits = pii.model()
    x, y = pii.labelled(1500, seed=99)
    p = trees.score(x)
    hit = np.array([q >= limits[pii.ADDED[int(k)]] for q, k in zip(p, x[:, 0])])
    assert y[hit].mean() > 0.98 and hit[y == 1].mean() > 0.8


def test_license_model_holds_out():
    weights, bias = licenses.model()
    texts, y = licenses.training(400, seed=77)
    z = np.array([np.array(bias) + sum((np.array(weights[g]) for g in set(licenses.grams(t, 1)) | set(licenses.grams(t, 2)) if g in weights), np.zeros(len(bias))) for t in texts])
    assert (z.argmax(1) == y).mean() > 0.97


def test_gate_covers_templates():
    words = set(licenses.gate())
    for ts in licenses.TEMPLATES.values():
        for t in ts:
            w = licenses.windows(t)
            assert sum(not words & set(x.split()) for x in w) < licenses.CONFIRM * len(w)


def test_repeat_words_by_hand():
    assert quality._repeats(b"a b c d a b c".split()) == 6
    assert Counter([1])[2] == 0


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["ab", "aab", "aeiou", "abcdefghijklmnop", "é", "hax"]), st.integers(240, 900), st.integers(0, 10**6))
def test_long_words(name, letters, size, seed):
    """Words that are merged a pair's places at a time, with runs whose places overlap."""
    codec, lib = CODECS[name]
    r = random.Random(seed)
    word = "".join(r.choice([r.choice(letters), letters, r.choice(letters) * 3]) for _ in range(size))
    assert codec.merger.rising
    assert codec.encode([word]) == [lib.encode(word, add_special_tokens=False).ids]
