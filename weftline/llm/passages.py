"""Repeated windows over whole corpora: the plan that substring and suffix-array dedup share.

A window is `width` consecutive tokens (bytes or words) of one document. Every window names one anchor in it by a
rule that looks at the window's content alone, so equal windows name equal anchors. A run of windows with the same
anchor is a span.

1. Equal texts become one row with a count, grouped byte by byte (`distinct_texts`); all else is done once for each
   different text, whatever its copies.
2. Anchors that occur once cannot be in a repeated window: only spans of repeated anchors go on (`spans_of`).
3. Spans of an anchor with equal content form a class, grouped by the content itself and counted with map-side sums
   (`classes_of`). A class of two or more is repeated as a whole.
4. The windows of single spans are compared with those of the anchor's other classes by the caller's method.

Anchors only bring together what may be equal. No step gathers a hot anchor's rows: they are counted, and joined with a
key's single row (which Spark may split). Tables that grow with the input are merged, never broadcast.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from weftline.llm.common import Scratch, claim, slices

#: Tokens that are hashed at once; longer documents are taken in overlapping stretches.
TOKENS = 1 << 18
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Prefix:
    """Polynomial prefix hashes modulo 2**64 of a token array; any stretch's hash in constant time."""

    def __init__(self, codes: np.ndarray, base: int) -> None:
        n = 1 << max(10, int(len(codes) + 1).bit_length())
        self.back = _powers(pow(base, -1, 1 << 64), n)
        self.sum = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * _powers(base, n)[: len(codes)], out=self.sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sum[end] - self.sum[start]) * self.back[start]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, m = 1, x
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    n = len(x) - width + 1
    return np.minimum(m[:n], m[width - size : width - size + n])


def pack(start: np.ndarray, count: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """A span's first window, its number of windows and its anchor's place after the first window's start."""
    return start.astype(np.int64) << 18 | count.astype(np.int64) << 9 | anchor.astype(np.int64)


def runs(anchor: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """From the anchor of each place of a buffer to the spans in it: document, first window, number of windows."""
    length = np.diff(offsets)
    windows = np.maximum(length - width + 1, 0)
    doc = np.repeat(np.arange(len(length)), windows)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + offsets[:-1][doc]
    if not len(at):
        e = np.zeros(0, np.int64)
        return e, e, e
    own = anchor[at]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])]))
    count = np.diff(np.concatenate([first, [len(at)]]))
    return doc[first], at[first], count


@dataclass(frozen=True)
class Unit:
    """Tokens of texts, the window width, and the spans of a buffer of tokens.

    codes: bytes of texts to an array of uint64 and each text's offset in it. spans: (codes, offsets) to document, first
    window, number of windows, anchor place and anchor hash of each span.
    """

    width: int
    codes: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    spans: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]


def groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum to about `most`."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _pieces(unit: Unit, raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of a few TOKENS tokens at most: documents, their first token in it, tokens, offsets."""
    for start, end in groups([len(t) for t in raw], 4 * TOKENS):
        codes, offsets = unit.codes(raw[start:end])
        if end - start > 1 or len(codes) <= 2 * TOKENS:
            yield np.arange(start, end), np.zeros(end - start, np.int64), codes, offsets
            continue
        for a in range(0, len(codes) - unit.width + 1, TOKENS):
            part = codes[a : a + TOKENS + unit.width - 1]
            yield np.array([start]), np.array([a]), part, np.array([0, len(part)])


def body_of(docs: DataFrame, text: str) -> Column:
    return F.coalesce(docs[text].cast("string"), F.lit(""))


@dataclass
class Texts:
    """rows: (h, m, z), each different text once: h names it, m is 1 or, for any number of copies, 2, z is the text in
    zstd. seed: h is the text's xxhash64 under it."""

    rows: DataFrame
    seed: int

    def name(self, docs: DataFrame, text: str) -> Column:
        return F.xxhash64(F.lit(self.seed), body_of(docs, text))


def distinct_texts(docs: DataFrame, text: str, scratch: Scratch) -> Texts:
    """Texts are grouped by their bytes; a seed under which two of them had one name is thrown away."""
    for seed in itertools.count(42):
        body = body_of(docs, text)
        named = docs.select(F.xxhash64(F.lit(seed), body).alias("h"), packed(body).alias("z"))
        rows = scratch.put(named.groupBy("h", "z").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("m")))
        if rows.groupBy("h").count().filter("count > 1").isEmpty():
            return Texts(rows, seed)
        scratch.drop(rows)


def span_rows(texts: DataFrame, unit: Unit) -> DataFrame:
    """(h, m, z) to a row (a, h, pos, m) per span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("passages")
        for batch in chain.from_iterable(slices(b, 2) for b in batches):
            for ids, base, codes, offsets in _pieces(unit, unpacked(batch.column(2))):
                doc, first, count, place, a = unit.spans(codes, offsets)
                local = first - offsets[:-1][doc] + base[doc]
                row = pa.array(ids[doc])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), batch.column(0).take(row), pa.array(pack(local, count, place - first)), batch.column(1).take(row)], names=["a", "h", "pos", "m"]
                )

    return texts.select("h", "m", "z").mapInArrow(run, "a long, h long, pos long, m int")


def spans_of(texts: Texts, unit: Unit, scratch: Scratch) -> DataFrame:
    """(a, h, pos, m) of every span whose anchor occurs twice or more."""
    rows = scratch.put(span_rows(texts.rows, unit))
    often = scratch.put(rows.groupBy("a").agg(F.sum("m").alias("n")).filter("n > 1").select("a"))
    spans = scratch.put(rows.join(often.hint("merge"), "a"))
    scratch.drop(rows)
    scratch.drop(often)
    scratch.release()
    return spans


@F.arrow_udf(T.BinaryType())
def packed(text: pa.Array) -> pa.Array:
    """Texts in zstd, for shuffles. Equal texts give equal bytes."""
    press = zstandard.ZstdCompressor(level=3).compress
    return pa.array([None if t is None else press(t) for t in text.cast(pa.binary()).to_pylist()], pa.binary())


def unpacked(column: pa.Array) -> list[bytes]:
    open_ = zstandard.ZstdDecompressor().decompress
    return [b"" if t is None else open_(t) if t else b"" for t in column.to_pylist()]


def with_texts(texts: Texts, rows: DataFrame, per_text: Callable, schema: str, *fields: str) -> DataFrame:
    """rows (h, fields) gathered by text and met with it: per_text(raw texts, batch of (h, z, own)) makes rows of
    schema. A text's rows are bounded by its length."""
    own = rows.groupBy("h").agg(F.collect_list(F.struct(*fields)).alias("own"))
    met = texts.rows.select("h", "z").join(own.hint("merge"), "h").select("h", "z", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("passages")
        for batch in chain.from_iterable(slices(b, 1) for b in batches):
            yield from per_text(unpacked(batch.column(1)), batch.column(0), batch.column(2))

    return met.mapInArrow(run, schema)


def flat(own: pa.Array, *fields: str) -> tuple[np.ndarray, ...]:
    """A list column of structs as the row of each entry and its fields."""
    size = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
    each = pc.list_flatten(own)
    return np.repeat(np.arange(len(own)), size), *(pc.struct_field(each, f).to_numpy(zero_copy_only=False) for f in fields)


def contested(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """The classes of anchors that have several, one of them a single span."""
    many = scratch.put(classes.groupBy("a").agg(F.count("*").alias("k"), F.count_if(F.col("n") == 1).alias("open")).filter("k > 1 and open > 0").select("a"))
    return classes.join(many, "a")


#: Kinds of marks on a text: a span, a span taken back, a range of repeated windows, a window taken back.
SPAN, NOT_SPAN, WINDOWS, NOT_WINDOW = range(4)


def mark(kind: int, x: Column, y: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), x.cast("long").alias("x"), (F.lit(0) if y is None else y).cast("long").alias("y"))


def removed(kind: np.ndarray, x: np.ndarray, y: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal removed token ranges [from, to) of one text's marks."""
    span = kind <= NOT_SPAN
    first, last = np.where(span, x >> 18, x), np.where(kind == WINDOWS, y, x)
    last = np.where(span, first + (x >> 9 & 511) - 1, last)
    step = np.zeros(int(last.max()) + 2, np.int32)
    for add in (SPAN, WINDOWS):
        np.add.at(step, first[kind == add], 1)
        np.add.at(step, last[kind == add] + 1, -1)
    # spans taken back were marked as spans, windows taken back as part of one: they are marked by nothing else
    for sub in (NOT_SPAN, NOT_WINDOW):
        np.add.at(step, first[kind == sub], -1)
        np.add.at(step, last[kind == sub] + 1, 1)
    hit = np.concatenate([[False], np.cumsum(step) > 0, [False]])
    edge = np.flatnonzero(hit[1:] != hit[:-1])
    out: list[tuple[int, int]] = []
    for a, b in zip(edge[::2].tolist(), (edge[1::2] - 1 + width).tolist()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def finished(texts: Texts, marks: DataFrame, finish: Callable, result: str) -> DataFrame:
    """(h, cut) of each text: finish(raw text, removed ranges) gives cut's values."""
    fields = T._parse_datatype_string(result)
    own = marks.groupBy("h").agg(F.collect_list("mark").alias("marks"))
    met = texts.rows.select("h", "z").join(own.hint("merge"), "h", "left").select("h", "z", "marks")
    kind = pa.struct([(f.name, to_arrow_type(f.dataType)) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("passages")
        for batch in chain.from_iterable(slices(b, 1) for b in batches):
            raw, at = unpacked(batch.column(1)), 0
            _, kinds, x, y = flat(batch.column(2), "kind", "x", "y")
            out = []
            for text, n in zip(raw, pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_pylist()):
                out.append(finish(text, (kinds[at : at + n], x[at : at + n], y[at : at + n]) if n else None))
                at += n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([dict(zip(fields.names, r)) for r in out], kind)], names=["h", "cut"])

    return met.mapInArrow(run, f"h long, cut {result}")


def apply(docs: DataFrame, texts: Texts, cut: DataFrame, text: str) -> DataFrame:
    """(row, empty, cut) of each row of docs: its columns but the text in a struct, whose names clash with nothing, and
    whether its text is null."""
    others = [docs[c] for c in docs.columns if c != text]
    rows = docs.select(F.struct(*others).alias("row"), docs[text].isNull().alias("empty"), texts.name(docs, text).alias("h"))
    return rows.join(cut, "h").select("row", "empty", "cut")
