"""SentencePiece encoding and decoding (merge-type models) by a table of prefixes.

The encoding of a text's prefix ends in one token and no other. The table keeps that token for each prefix: an automaton
over the vocabulary finds the tokens that end at a place, and the one is it whose own start holds a token (in the table)
that it is compatible with, which is to say that merging the two tokens' characters gives these two again. The ids are
then read off from the text's end backwards. A place has few matches, so that the work is linear in the text's length.

Merging a pair of tokens is simulated once and remembered; most pairs need none, as no merge over their border exists.

Texts are cut before each space that follows another character: no piece of a model holds such a place (checked when
the model is read), so that chunks are encoded on their own, and frequent ones once. A chunk that is not at hand is cut
where letters and other characters meet that do so in no piece, as over such a place nothing merges either.

Defined results: null text is the empty text, which has the end id alone and decodes to the empty string; texts of any
length are taken whole, a stretch of whole chunks at a time; characters outside the vocabulary are bytes; a space and the
model's mark for it are the same, as in the library; repeated rows give repeated results; ties of score go to the
leftmost pair; extra columns stay out of the results, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from weftline.llm.common import by_batch, claim, texts

#: What stands for a space in pieces.
SPACE = "▁"
#: Chunks and parts of chunks that a worker's caches hold, and their longest length; pairs that it remembers.
CACHE_CHUNKS, CACHE_PARTS, CACHE_CHARS = 300_000, 600_000, 64
CACHE_PAIRS = 1_000_000
#: Characters of a stretch of whole chunks, which a long text is cut into.
STRETCH = 1 << 20
#: Runs of letters and of what else there is; the mark for a space is its word's.
RUNS = re.compile(f"(?:{SPACE}*[^\\W\\d_]+|[\\W\\d_]+?(?={SPACE}*[^\\W\\d_])|[\\W\\d_]+)")


class Pieces:
    """A model's vocabulary: pieces with their scores, and how its tokens are built."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.names, self.size, self.end = names, n, model.eos_id()
        self.hidden = {i for i in range(n) if model.is_control(i)}
        self.byte = {i: int(names[i][3:-1], 16) for i in range(n) if model.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte.items()}
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if len(self.byte) != 256 or any(SPACE in names[i].lstrip(SPACE) for i in plain) or model.normalize(" ﬁ ") != f"{SPACE}{SPACE}ﬁ{SPACE}":
            raise ValueError("the model needs byte pieces, spaces at pieces' starts alone and the identity as normal form")
        self.score = {names[i]: model.get_score(i) for i in plain}
        self.token = {names[i]: i for i in plain}
        # characters that pieces hold but that are none themselves merge like others, and come out as bytes
        for c in sorted({c for p in self.score for c in p} - set(self.token)):
            self.token[c] = len(self.names)
            self.names.append(c)
        self.left: dict[int, list[str]] = {}
        self.right: dict[int, list[str]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, token in self.token.items():
            built: dict[str, tuple[str, str]] = {}
            if self.merged(list(piece), built) == [piece]:  # else no text's encoding holds it
                self.left[token] = self._edge(piece, built, 0)
                self.right[token] = self._edge(piece, built, 1)
                self.automaton.add_word(piece, (len(piece), token))
        self.automaton.make_automaton()
        #: Pairs of characters that meet in a piece.
        self.meet = {p[i : i + 2] for p in self.token for i in range(len(p) - 1)}
        self.fits: dict[int, bool] = {}
        #: What tokens are in a text; None for bytes.
        self.texts = [None if i in self.byte else "" if i in self.hidden else p.replace(SPACE, " ") for i, p in enumerate(self.names)]

    @staticmethod
    def _edge(piece: str, built: dict[str, tuple[str, str]], side: int) -> list[str]:
        """The piece, its part on that side, that part's part and so on."""
        out = [piece]
        while piece in built:
            piece = built[piece][side]
            out.append(piece)
        return out

    def merged(self, symbols: list[str], built: dict[str, tuple[str, str]] | None = None) -> list[str]:
        """Merges of the best score first, leftmost among equals, until no pair is a piece. For a few characters."""
        score = self.score
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return symbols
            made = symbols[at] + symbols[at + 1]
            if built is not None:
                built[made] = (symbols[at], symbols[at + 1])
            symbols[at : at + 2] = [made]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the characters of both tokens, merged, give the two tokens."""
        score = self.score
        if not any(x + y in score for x in self.right[a] for y in self.left[b]):
            return True
        x, y = self.names[a], self.names[b]
        return self.merged([*x, *y]) == [x, y]

    def encode_chunk(self, chunk: str) -> list[int]:
        """The ids of a chunk by the table of its prefixes."""
        fits, n, size = self.fits, len(self.names), len(chunk)
        # of each prefix, by its last character: the token that ends its encoding, none behind a character of no piece,
        # and that token's length; at -1, the empty prefix
        last, long = [-1] * (size + 1), [0] * size
        for end, (length, token) in self.automaton.iter(chunk):
            if last[end] >= 0:
                continue
            before = last[end - length]
            if before >= 0:  # else nothing merges over the token's start
                key = before * n + token
                ok = fits.get(key)
                if ok is None:
                    if len(fits) >= CACHE_PAIRS:
                        fits.clear()
                    ok = fits[key] = self.compatible(before, token)
                if not ok:
                    continue
            last[end], long[end] = token, length
        out: list[int] = []
        end = size - 1
        while end >= 0:
            token = last[end]
            if 0 <= token < self.size:
                out.append(token)
                end -= long[end]
            else:
                out += [self.byte_id[b] for b in reversed(chunk[end].encode())]
                end -= 1
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: spaces for their marks, one less where the first piece starts with one; runs of byte pieces
        are UTF-8, with a replacement character for each byte that fits nowhere."""
        first = next((i for i in ids if i not in self.hidden), None)
        marked = first is not None and first not in self.byte and self.names[first].startswith(SPACE)
        return self.shown([i for i in ids if i not in self.hidden])[marked:]

    def shown(self, ids: list[int]) -> str:
        """The text of ids, none left out at the start."""
        plain = [self.texts[i] for i in ids]
        if None not in plain:
            return "".join(plain)
        out = []
        for is_byte, run in groupby(ids, self.byte.__contains__):
            out += [utf8(bytes(map(self.byte.get, run)))] if is_byte else [self.texts[i] for i in run]
        return "".join(out)


def utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError as error:
        return raw[: error.start].decode() + "\ufffd" + utf8(raw[error.start + 1 :])


def chunks_of(body: str) -> list[str]:
    """The chunks of a text with marks for spaces, which starts with one; each without its first mark."""
    if SPACE + SPACE in body:
        return [m[1:] for m in re.findall(f"{SPACE}+[^{SPACE}]*", body)]
    return body.split(SPACE)[1:]


def stretches(text: str) -> Iterator[str]:
    """The text with marks for spaces and one before it, in parts of whole chunks."""
    if not text:
        return
    body = SPACE + text.replace(" ", SPACE)
    start, border = 0, re.compile(f"(?<=[^{SPACE}]){SPACE}")
    while len(body) - start > STRETCH and (cut := border.search(body, start + STRETCH)):
        yield body[start : cut.start()]
        start = cut.start()
    yield body[start:]


class Codec:
    """A model's pieces, and what frequent chunks come to."""

    def __init__(self, path: str) -> None:
        self.pieces = Pieces(path)
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.parts: dict[str, tuple[int, str, str]] = {}
        self.number = [str(i) for i in range(self.pieces.size)]

    def values(self, body: str) -> list[tuple[int, str, str]]:
        """Of each chunk the number of ids, the ids in decimals and the decoded text."""
        keys = chunks_of(body)
        out = list(map(self.cache.get, keys))
        if None in out:
            fresh = {k: self._chunk(k) for k in {k for k, v in zip(keys, out) if v is None}}
            out = [fresh[k] if v is None else v for k, v in zip(keys, out)]
        return out

    def _chunk(self, key: str) -> tuple[int, str, str]:
        chunk = SPACE + key
        if key.isalpha():
            v = self._part(chunk)
        else:
            meet, cuts = self.pieces.meet, [0]
            cuts += [i for i in [m.start() for m in RUNS.finditer(chunk)][1:] if chunk[i - 1 : i + 1] not in meet]
            n, ids, shown = zip(*[self._part(chunk[a:b]) for a, b in zip(cuts, [*cuts[1:], len(chunk)])])
            v = sum(n), " ".join(ids), "".join(shown)
        if len(key) <= CACHE_CHARS and len(self.cache) < CACHE_CHUNKS:
            self.cache[key] = v
        return v

    def _part(self, part: str) -> tuple[int, str, str]:
        v = self.parts.get(part)
        if v is None:
            ids = self.pieces.encode_chunk(part)
            v = len(ids), " ".join([self.number[i] for i in ids]), self.pieces.shown(ids)
            if len(part) <= CACHE_CHARS and len(self.parts) < CACHE_PARTS:
                self.parts[part] = v
        return v

    def encode(self, text: str) -> list[int]:
        """The text's ids and the end id."""
        return [i for part in stretches(text) for c in chunks_of(part) for i in self.pieces.encode_chunk(SPACE + c)] + [self.pieces.end]

    def digests(self, text: str) -> tuple[int, str, str]:
        """The number of ids, the digest of the ids and of the decoded text, a stretch at a time."""
        n, first = 1, True
        ids, shown = hashlib.sha256(), hashlib.sha256()
        for part in stretches(text):
            values = self.values(part)
            n += sum([v[0] for v in values])
            ids.update((" ".join([v[1] for v in values]) + " ").encode())
            back = "".join([v[2] for v in values])
            shown.update((back.removeprefix(" ") if first else back).encode())
            first = False
        ids.update(str(self.pieces.end).encode())
        return n, ids.hexdigest(), shown.hexdigest()


@lru_cache(maxsize=2)
def _codec(path: str) -> Codec:
    return Codec(path)


def _forget() -> None:
    _codec.cache_clear()
    gc.enable()
    gc.collect()


def codec(path: str) -> Codec:
    """The worker's codec of a file."""
    claim("pieces", _forget)
    gc.disable()  # caches hold no cycles, and walking them again and again costs more than the encoding
    return _codec(path)


def _mapped(docs: DataFrame, text: str, key: str, run, columns: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(by_batch(run, 1), f"key {kind}, {columns}").withColumnRenamed("key", key)


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: key, ids (array of int, the end id last) and the text that they decode to."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        got = [c.encode(t) for t in texts(batch.column(1))]
        shown = [c.pieces.decode(x) for x in got]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int32())), pa.array(shown, pa.string())], names=["key", "ids", "decoded"])

    return _mapped(docs, text, key, run, "ids array<int>, decoded string")


def round_trips(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: the number of ids, the ids' SHA-256 and the decoded text's SHA-256, without moving either."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        n, ids, shown = zip(*map(c.digests, texts(batch.column(1))))
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(shown, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _mapped(docs, text, key, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
