"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word is a row of symbols. A segment tree over its adjacent pairs holds (merge rank, position); the root
is the leftmost pair of lowest rank. A merge changes two pairs, and each change climbs the tree in
logarithmic time; a word is done when its root holds no mergeable pair. Many words are encoded at once: one
tree per row of a matrix, so that a step is one array operation over all words that still merge. In a long word a step merges
all places of the root's pair.

Defined results: null text is the empty text, which has no ids and decodes to the empty string; texts of any length are
taken whole; repeated rows give repeated results; ties of rank go to the leftmost pair; extra columns stay out of the
results, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from weftline.llm.common import by_batch, claim, texts

#: Chunks that a worker's cache holds, and their longest length.
CACHE_WORDS = 700_000
CACHE_CHARS = 64
#: First characters of chunks' keys: the chunk alone, one word, a special token. Texts that hold them are cut into words.
AS_IS, WORD, SPECIAL = "\x1c", "\x1d", "\x1e"
#: Marks that are words of their own behind a word of letters.
PLAIN_MARKS = tuple(",.!?;:|")
#: Words of so many bytes are encoded one at a time, all places of a pair in one step.
LONG = 256
#: No merge: larger than any rank and position.
NONE = np.int64(1) << 62
_POS = 32  # low bits of a tree entry hold the position


def byte_chars() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class Merger:
    """Merges of one vocabulary: encodes byte words to ids."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str) -> None:
        self.suffix, chars = suffix, byte_chars()
        self.plain = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        a = np.array([vocab[x] for x, _ in pairs], np.int64)
        b = np.array([vocab[y] for _, y in pairs], np.int64)
        key = a << 20 | b
        self.order = np.argsort(key, kind="stable")
        self.keys, self.rank_of = key[self.order], self.order.astype(np.int64)
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int64)
        first = np.full(max(vocab.values()) + 1, -1, np.int64)
        np.maximum.at(first, self.made, np.arange(len(pairs)))
        #: Whether every merge ranks behind those that make its parts.
        self.rising = bool((np.maximum(first[a], first[b]) < np.arange(len(pairs))).all())

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank_of[at], -1)

    def encode(self, words: list[bytes], packed: bool = False) -> list:
        """Ids of each word (not empty), as a list, or packed as little-endian 32-bit."""
        out: list = [None] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(lengths, kind="stable")
        width, start = 4, 0
        while start < len(order):
            end = int(np.searchsorted(lengths[order], width, side="right"))
            step = max(1, (1 << 18) // width)
            if width >= LONG and self.rising:
                for k in order[start:end].tolist():
                    ids = self._long(words[k], width)
                    out[k] = ids.astype("<u4").tobytes() if packed else ids.tolist()
                start = end
            for i in range(start, end, step):
                part = order[i : min(end, i + step)]
                ids, ends = self._rows([words[j] for j in part], lengths[part], width)
                flat, ends = (ids.astype("<u4").tobytes(), 4 * ends) if packed else (ids.tolist(), ends)
                at = 0
                for k, to in zip(part.tolist(), ends.tolist(), strict=True):
                    out[k] = flat[at:to]
                    at = to
            start = max(start, end)
            width *= 2
        return out

    def _rows(self, words: list[bytes], length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        rows = len(words)
        symbols = np.full((rows, width), -1, np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(rows), length)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        symbols[row, col] = self.plain[flat]
        every = np.arange(rows)
        ends = np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)
        symbols[every, length - 1] = self.last[ends]
        after = np.tile(np.arange(1, width + 1), (rows, 1))  # next living symbol
        before = np.tile(np.arange(-1, width - 1), (rows, 1))
        # the tree: leaves at [width, 2 * width), root at 1
        tree = np.full((rows, 2 * width), NONE, np.int64)
        rank = self.ranks(symbols[:, :-1], symbols[:, 1:])
        leaf = np.where(rank >= 0, rank << _POS | np.arange(width - 1), NONE)
        tree[:, width : 2 * width - 1] = leaf
        half = width // 2
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2
        live = every[tree[:, 1] < NONE]
        while len(live):
            root = tree[live, 1]
            at = root & ((1 << _POS) - 1)
            gone = after[live, at]
            symbols[live, at] = self.made[root >> _POS]
            symbols[live, gone] = -1
            nxt = after[live, gone]
            after[live, at] = nxt
            inner = nxt < width
            before[live[inner], nxt[inner]] = at[inner]
            self._point(tree, live, gone, np.full(len(live), NONE), width)
            right = np.where(inner, symbols[live, np.minimum(nxt, width - 1)], -1)
            r = self.ranks(symbols[live, at], right)
            self._point(tree, live, at, np.where(r >= 0, r << _POS | at, NONE), width)
            prev = before[live, at]
            has = prev >= 0
            who, p = live[has], prev[has]
            r = self.ranks(symbols[who, p], symbols[who, at[has]])
            self._point(tree, who, p, np.where(r >= 0, r << _POS | p, NONE), width)
            live = live[tree[live, 1] < NONE]
        kept = symbols >= 0
        return symbols[kept], np.cumsum(kept.sum(1))

    def _long(self, word: bytes, width: int) -> np.ndarray:
        """One long word: a step merges all places of the root's pair, left to right without overlaps.

        Where every merge ranks behind those that make its parts (`rising`), a merge leaves only pairs that rank behind
        it, so that the places of one pair follow each other in any case.
        """
        n = len(word)
        symbols = np.full(width, -1, np.int64)
        symbols[:n] = self.plain[np.frombuffer(word, np.uint8)]
        symbols[n - 1] = self.last[word[-1]]
        after, before = np.arange(1, width + 1), np.arange(-1, width - 1)
        tree = np.full(2 * width, NONE, np.int64)
        rank = self.ranks(symbols[:-1], symbols[1:])
        tree[width : 2 * width - 1] = np.where(rank >= 0, rank << _POS | np.arange(width - 1), NONE)
        half = width // 2
        while half:
            tree[half : 2 * half] = np.minimum(tree[2 * half : 4 * half : 2], tree[2 * half + 1 : 4 * half : 2])
            half //= 2
        while tree[1] < NONE:
            best = tree[1] >> _POS
            node = np.array([1])
            while node[0] < width:  # down to all leaves of the root's rank
                node = (2 * node[:, None] + (0, 1)).ravel()
                node = node[tree[node] >> _POS == best]
            at = node - width
            # of a run of overlapping places every other one
            fresh = np.concatenate([[True], after[at[:-1]] != at[1:]])
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
            gone = after[at]
            nxt = after[gone]
            symbols[at], symbols[gone], after[at] = self.made[best], -1, nxt
            inner = nxt < width
            before[nxt[inner]] = at[inner]
            prev = before[at]
            left = np.concatenate([at, prev[prev >= 0]])
            right = after[left]
            rank = self.ranks(symbols[left], np.where(right < width, symbols[np.minimum(right, width - 1)], -1))
            tree[gone + width] = NONE
            tree[left + width] = np.where(rank >= 0, rank << _POS | left, NONE)
            node = np.concatenate([gone, left]) + width
            while node[0] > 1:
                node = np.unique(node >> 1) if len(node) > 8 else node >> 1
                tree[node] = np.minimum(tree[2 * node], tree[2 * node + 1])
        return symbols[symbols >= 0]

    @staticmethod
    def _point(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
        node = at + width
        tree[rows, node] = value
        while width > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width //= 2


class Codec:
    """A tokenizer file's encoding and decoding: special tokens, normal form, words, merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merger = Merger(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.lower = spec["normalizer"] is not None
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        if self.lower:
            self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        else:
            import public_tokenizers

            self.words = regex.compile(public_tokenizers.PATTERN)
        self.strange = re.compile("[\x1c-\x1f\u0250-\U0010ffff]").search
        self.library = Tokenizer.from_file(path)
        self.byte = {c: b for b, c in enumerate(byte_chars())}
        self.marks = re.compile("[\x1c-\x1e]").search
        self.cache: dict[str, object] = {}

    def pieces(self, text: str) -> list[str]:
        """Keys of chunks whose encodings, put together, are the text's encoding.

        Where white space is dropped, chunks are what stands between it, in NFC and lower case (of each code point
        alone). Else a single space starts a word of its own: a key stands for itself behind a space, or for itself alone
        behind AS_IS or WORD; a text with longer or rare white space is cut into words right away. Texts with code points
        above Latin are normalised and cut by the library.
        """
        if self.strange(text):
            if self.lower:
                return [AS_IS + w for w in self.library.normalizer.normalize_str(text).split(" ") if w]
            return list(map(self.key_of, self.library_words(text)))
        if self.lower:
            return unicodedata.normalize("NFC", text).lower().split()
        if "  " in text or "\x85" in text or "\xa0" in text:
            return list(map(self.key_of, self.words.findall(text)))
        out = text.split(" ")
        out[0] = AS_IS + out[0]
        return out

    def library_words(self, text: str) -> list[str]:
        """Words by the library's own classes of characters, for code points whose classes differ between versions."""
        cut = self.library.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(self.byte[c] for c in w).decode() for w, _ in cut]

    def word_of(self, key: str) -> str:
        """The word that a key of one word stands for."""
        return key[1:] if key[:1] in (AS_IS, WORD) else key if self.lower else " " + key

    def key_of(self, word: str) -> str:
        """The key of a word."""
        if self.marks(word):
            return WORD + word
        if self.lower:
            return word
        return word[1:] if word[:1] == " " else AS_IS + word

    def words_of(self, key: str) -> list[str]:
        """The keys of a chunk's words; the chunk's own where it is one word."""
        if key[:1] == WORD or key.isalpha():
            return [key]
        lead = "" if self.lower or key[:1] == AS_IS else " "
        body = key[1:] if key[:1] == AS_IS else key
        if self.strange(body):
            return list(map(self.key_of, self.library_words(lead + body)))
        if body.isalpha():
            return [self.key_of(lead + body)]
        if body[-1:] in PLAIN_MARKS and body[:-1].isalpha():
            return [self.key_of(lead + body[:-1]), self.key_of(body[-1])]
        return list(map(self.key_of, self.words.findall(lead + body)))

    def split(self, text: str) -> list[str]:
        """The text's ordinary stretches and, at odd places, special tokens."""
        if "<|" not in text:
            return [text]
        return self.split_special.split(text)

    def fill(self, texts: list[str], make: Callable[[list[int]], object] | None, join: Callable[[list], object]) -> list[list]:
        """For each text the values of its chunks: make(ids) gives a word's value (see `values`), join(values) a chunk's."""
        flat: list = []
        ends = []
        for text in texts:
            for k, part in enumerate(self.split(text)):
                if k % 2:
                    flat.append(SPECIAL + part)
                elif part:
                    flat += self.pieces(part)
            ends.append(len(flat))
        values = self.values(flat, make, join)
        return [values[a:b] for a, b in zip([0, *ends], ends)]

    def values(self, keys: list[str], make: Callable[[list[int]], object] | None, join: Callable[[list], object]) -> list:
        """The values of chunks by their keys; without make, their ids packed as little-endian 32-bit.

        The cache keeps the first CACHE_WORDS chunks, words among them, of up to CACHE_CHARS characters, which hold the
        frequent ones; others are made each time.
        """
        cache, words_of = self.cache, self.words_of
        values = list(map(cache.get, keys))
        gaps = [i for i, v in enumerate(values) if v is None]
        if not gaps:
            return values
        made: dict[str, object] = {}
        fresh: dict[str, None] = {}
        parts: list[tuple[str, list[str]]] = []
        for key in {keys[i] for i in gaps}:
            if key.isalpha():
                fresh[key] = None
                continue
            if key[:1] == SPECIAL:
                ids = [self.special[key[1:]]]
                made[key] = make(ids) if make else np.array(ids, "<u4").tobytes()
                continue
            own = words_of(key)
            if own == [key]:
                fresh[key] = None
            else:
                parts.append((key, own))
                for w in own:
                    if w not in cache:
                        fresh[w] = None
        words = list(fresh)
        ids = self.merger.encode([self.word_of(w).encode() for w in words], packed=make is None)
        made.update(zip(words, map(make, ids) if make else ids, strict=True))
        for key, own in parts:
            held = [cache[w] if w in cache else made[w] for w in own]
            made[key] = held[0] if len(held) == 1 else join(held)
        if len(cache) < CACHE_WORDS:
            cache.update([(k, v) for k, v in made.items() if len(k) <= CACHE_CHARS])
        for i in gaps:
            values[i] = made[keys[i]]
        return values

    def packed(self, texts: pa.Array) -> list[bytes]:
        """The texts' ids as little-endian 32-bit. Texts that are cut at single spaces alone are cut, and their different chunks
        found, by Arrow; null is the empty text."""
        body = pc.fill_null(texts.cast(pa.string()), "")
        if self.lower:
            return [b"".join(x) for x in self.fill(body.to_pylist(), None, b"".join)]
        hard = pc.match_substring_regex(body, r"[\x1c-\x1f\x{85}\x{a0}\x{250}-\x{10ffff}]|  |<\|")
        out = np.empty(len(body), object)
        for own, easy in ((pc.invert(hard), True), (hard, False)):
            at = np.flatnonzero(own.to_numpy(zero_copy_only=False))
            if not len(at):
                continue
            part = body.filter(own)
            if easy:
                chunks = pc.split_pattern(pc.binary_join_element_wise(AS_IS, part, ""), " ")
                coded = pc.list_flatten(chunks).dictionary_encode()
                each = pa.array(self.values(coded.dictionary.to_pylist(), None, b"".join), pa.binary())
                offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(chunks).to_numpy())]).astype(np.int32)
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), each.take(coded.indices)), b"")
                out[at] = joined.to_pylist()
            else:
                out[at] = [b"".join(x) for x in self.fill(part.to_pylist(), None, b"".join)]
        return out.tolist()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, with a cache of their own."""
        held, self.cache = self.cache, {}
        got = self.fill(texts, list, lambda parts: [i for p in parts for i in p])
        self.cache = held
        return [[i for ids in x for i in ids] for x in got]

    def decode(self, ids) -> str:
        """Without a decoder in the file, tokens joined by a space; else the bytes that the tokens stand for."""
        tokens = [self.token[int(i)] for i in ids]
        if self.lower:
            return " ".join(tokens)
        raw = bytearray()
        for t in tokens:
            raw += t.encode() if t in self.special else bytes(self.byte[c] for c in t)
        return raw.decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def _codec(path: str) -> Codec:
    return Codec(path)


def _forget() -> None:
    _codec.cache_clear()
    gc.enable()
    gc.collect()


def codec(path: str, kind: str) -> Codec:
    """The worker's codec of a file, with its cache of values of one kind; another kind begins anew."""
    claim(f"codec {kind}", _forget)
    gc.disable()  # a worker's cache holds no cycles, and walking it again and again costs more than all merges
    return _codec(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: key, ids (array of int) and the text that they decode to."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, "ids")
        got = [[i for ids in x for i in ids] for x in c.fill(texts(batch.column(1)), list, lambda parts: [i for p in parts for i in p])]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(got, pa.list_(pa.int32())), pa.array([c.decode(x) for x in got])], names=["key", "ids", "decoded"]
        )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).mapInArrow(
        by_batch(run, 1), f"key {kind}, ids array<int>, decoded string"
    ).withColumnRenamed("key", key)


def round_trips(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: the number of ids, the ids' SHA-256 and the decoded text's SHA-256, without moving either.

    Ids and decoded tokens come chunk by chunk from `Codec.fill`; for a file whose decoding joins tokens by a
    space, so do the digests' inputs.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, "digests")
        joined = c.lower
        number = [str(i) for i in range(max(c.token) + 1)]

        def make(ids: list[int]) -> tuple:
            return len(ids), " ".join([number[i] for i in ids]), " ".join([c.token[i] for i in ids]) if joined else ids

        def join(parts: list[tuple]) -> tuple:
            n, a, b = zip(*parts) if parts else ((), (), ())
            return sum(n), " ".join(a), " ".join(b) if joined else [i for x in b for i in x]

        counts, digests, decoded = [], [], []
        for parts in c.fill(texts(batch.column(1)), make, join):
            parts = [p for p in parts if p[0]]
            counts.append(sum([p[0] for p in parts]))
            digests.append(hashlib.sha256(" ".join([p[1] for p in parts]).encode()).hexdigest())
            back = " ".join([p[2] for p in parts]) if joined else c.decode([i for p in parts for i in p[2]])
            decoded.append(hashlib.sha256(back.encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())],
            names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).mapInArrow(
        by_batch(run, 1), f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    ).withColumnRenamed("key", key)
