"""Substring dedup by recompression of word sequences.

Removes each word covered by a window of WIDTH words that also starts anywhere else, in the same document or another
one. Words are runs of bytes other than space and \\t..\\r, unchanged.

A round of recompression names first runs (a symbol that stands any number of times in a row), then pairs: a symbol of
side 0 joins a following symbol of side 1, sides being drawn by a hash of the symbol and the round. Rounds go on until
symbols outgrow the strings in question. What a round makes of a string's inside does not depend on what stands around
the string: of its symbols, the first and last run may go on outside, as may the pair of a first symbol of side 1 or a
last one of side 0. These are set apart, round after round, until nothing is left; the symbols set apart, in order,
spell the string, so that equal strings have equal spellings and others do not (`spellings`).

Shared symbols reveal repeats: a window's anchor is, of the symbols that ANCHOR_ROUNDS rounds leave inside it (or as
many rounds as leave any), the leftmost of least hash, taken with the words that every window round it holds. They
verify repeats too: spans of an anchor are classes by their spelling, and where a span stands alone beside other classes,
so are windows; spellings are compared as digests of 128 bits.

A name is a hash of what it names, so that all tasks name alike. That names are one to one is not left to chance: over
all stretches that hold repeated anchors, the rounds are Spark jobs, one after the other, each of which gathers its
round's dictionary of names over all tasks (`ambiguous`). Should a name stand for two things, spellings are made again,
and those that hold it are told apart by their words.

Defined results: null text has no words; texts of under WIDTH words stay whole; repeated rows are copies of each
other; no rows give no rows; extra columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weftline.llm import passages
from weftline.llm.common import Scratch
from weftline.llm.passages import TOKENS, Prefix, Texts, Unit, groups, mark, mix, removed, runs

WIDTH = 35
ANCHOR_ROUNDS = 4
_BASE = 0x9E3779B97F4A7C15
_RUN, _LEFT, _RIGHT = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


#: The six high bits of a name say in which round it was made, and whether of a run or a pair, up to this round.
TAGGED = 31
#: Names that stand for two things come to the driver, up to so many.
MOST_AMBIGUOUS = 100_000


def _tag(hashed: np.ndarray, number: int) -> np.ndarray:
    return hashed >> np.uint64(6) | np.uint64(min(number, 63)) << np.uint64(58)


#: Bytes of texts whose words are named at once.
CHUNK = 1 << 21
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _words_in(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a buffer of bytes begin, and their names."""
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    begin, end = edge[::2], edge[1::2]
    hashed = Prefix(_TABLE[data], _BASE).of(begin, end)
    return begin, _tag(mix(hashed + (end - begin).astype(np.uint64) * _RUN), 0)


def names_in(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The names of the words of texts, and each text's offset among them."""
    names, counts = [np.zeros(0, np.uint64)], []
    for start, end in groups([len(t) for t in texts], CHUNK):
        part = texts[start:end]
        if len(part) == 1 and len(part[0]) > 2 * CHUNK:  # a long text, cut between words
            at, total = 0, 0
            while at < len(part[0]):
                to = next((i for i in range(at + CHUNK, len(part[0])) if _BLANK[part[0][i]]), len(part[0]))
                names.append(_words_in(np.frombuffer(part[0], np.uint8)[at:to])[1])
                total += len(names[-1])
                at = to
            counts.append(total)
            continue
        begin, own = _words_in(np.frombuffer(b" ".join(part), np.uint8))
        names.append(own)
        edges = np.cumsum([len(t) + 1 for t in part])
        counts += np.diff(np.concatenate([[0], np.searchsorted(begin, edges)])).tolist()
    return np.concatenate(names), np.cumsum([0, *counts])


def names_of(words: list[bytes]) -> np.ndarray:
    return names_in(words)[0]


class Symbols:
    """The symbols of a buffer of texts: names, first words, lengths in words, texts, and whether a name in them is among
    the ambiguous ones (`odd`, sorted)."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, odd: np.ndarray | None = None) -> None:
        self.name, self.start, self.size = codes, np.arange(len(codes)), np.ones(len(codes), np.int64)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        self.round = 0
        self.made: tuple[np.ndarray, ...] = ()
        self.odd = odd if odd is not None and len(odd) else None
        self.unsure = np.zeros(len(codes), bool)
        self._doubt()

    def _doubt(self) -> None:
        if self.odd is not None:
            at = np.minimum(np.searchsorted(self.odd, self.name), len(self.odd) - 1)
            self.unsure = self.unsure | (self.odd[at] == self.name)

    def find_runs(self) -> None:
        """block: the run of each symbol; first: where runs begin, and the end."""
        new = np.ones(len(self.name), bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.block = np.cumsum(new, dtype=np.int32) - 1
        self.first = np.append(np.flatnonzero(new), len(new))

    def name_runs(self) -> None:
        at, count = self.first[:-1], np.diff(self.first)
        many = np.flatnonzero(count > 1)
        old, count = self.name[at[many]], count[many]
        if len(many):
            self.name, self.start, self.doc, self.unsure, self.size = (x[at] for x in (self.name, self.start, self.doc, self.unsure, self.size))
            self.name[many] = _tag(mix(old ^ _RUN * count.astype(np.uint64)), 2 * self.round + 1)
            self.size[many] *= count  # symbols of one name are of one size
            self._doubt()
        self.made = self.name[many], old, count.astype(np.uint64)

    def find_pairs(self) -> None:
        """side of each symbol; joined: the left symbols of pairs; into: each symbol's place after the joining."""
        salt = mix(np.array([self.round + 1], np.uint64))
        self.side = (mix(self.name ^ salt) & np.uint64(1)).astype(np.int32)
        self.joined = np.flatnonzero((self.side[:-1] < self.side[1:]) & (self.doc[1:] == self.doc[:-1]))
        self.keep = np.ones(len(self.name), bool)
        self.keep[self.joined + 1] = False
        self.into = np.cumsum(self.keep, dtype=np.int32) - 1

    def name_pairs(self) -> None:
        a, b = self.name[self.joined], self.name[self.joined + 1]
        self.name, self.size = self.name.copy(), self.size.copy()
        self.name[self.joined] = _tag(mix(a * _LEFT + b * _RIGHT), 2 * self.round + 2)
        self.made = self.name[self.joined], a, b
        self.size[self.joined] += self.size[self.joined + 1]
        self.unsure[self.joined] |= self.unsure[self.joined + 1]
        self.name, self.size, self.start, self.doc, self.unsure = (x[self.keep] for x in (self.name, self.size, self.start, self.doc, self.unsure))
        self._doubt()
        self.round += 1


def least_within(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The leftmost place of the least value (of its 42 high bits) in each [low, high), none empty."""
    mask = np.uint64((1 << 22) - 1)
    best = x & ~mask | np.arange(len(x), dtype=np.uint64)
    out = np.empty(len(low), np.uint64)
    power = np.frexp((high - low).astype(np.float32))[1] - 1
    for k in range(int(power.max()) + 1 if len(power) else 0):
        own = np.flatnonzero(power == k)
        out[own] = np.minimum(best[low[own]], best[high[own] - (1 << k)])
        best = np.minimum(best[: len(best) - (1 << k)], best[1 << k :])
    return (out & mask).astype(np.int64)


def _spans(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    windows = np.maximum(np.diff(offsets) - WIDTH + 1, 0)
    doc = np.repeat(np.arange(len(windows)), windows)
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + offsets[:-1][doc]
    live, low, high = np.arange(len(begin)), begin.astype(np.int32), (begin + WIDTH).astype(np.int32)
    place, level, size = (np.zeros(len(begin), np.int64) for _ in range(3))
    s = Symbols(codes, offsets)

    def settle(stop: np.ndarray, t: int) -> None:
        own = np.flatnonzero(stop)
        if not len(own):
            return
        at = least_within(mix(s.name + _LEFT), low[own], high[own])
        place[live[own]], level[live[own]], size[live[own]] = s.start[at], t, s.size[at]

    for t in range(2 * ANCHOR_ROUNDS + 1):
        if not len(live):
            break
        if t % 2:
            s.find_pairs()
            a = low + s.side[low]
            b = high - 1 + s.side[high - 1]
            ok = a < b
            settle(~ok, t)
            live, a, b = live[ok], a[ok], b[ok]
            low, high = s.into[a], s.into[b - 1] + 1
            s.name_pairs()
        else:
            s.find_runs()
            a, b = s.block[low] + 1, s.block[high - 1]
            ok = (a < b) & (t < 2 * ANCHOR_ROUNDS)
            settle(~ok, t)
            live, low, high = live[ok], a[ok], b[ok]
            s.name_runs()
    named = np.zeros(len(codes), np.int64)
    named[begin] = place << 6 | level
    doc, first, count = runs(named, offsets, WIDTH)
    at = np.searchsorted(begin, first)
    place, level, size = place[at], level[at], size[at]
    around = (level + 1) // 2  # each round of runs has set a word apart on either side
    anchor = mix(Prefix(codes, _BASE).of(place - around, place + size + around) + level.astype(np.uint64))
    return doc, first, count, place, anchor


WORDS = Unit(WIDTH, names_in, _spans)


def spellings(
    names: np.ndarray, offsets: np.ndarray, begin: np.ndarray, end: np.ndarray, odd: np.ndarray | None = None, words: Callable[[int, int], list[bytes]] | None = None
) -> tuple[np.ndarray, int]:
    """The digests (two columns) of the spellings of strings of words [begin, end), none empty, and the rounds they take.

    A spelling is a sequence of (symbol, times and round and side), 12 bytes each; behind one that holds an ambiguous
    name stand the string's words, which words(begin, end) gives.
    """
    s = Symbols(names, offsets, odd)
    live, low, high = np.arange(len(begin)), begin, end
    unsure = np.zeros(len(begin), bool)
    rows, slots, symbols, times = [], [], [], []

    def apart(own: np.ndarray, at: np.ndarray, count: np.ndarray, slot: int) -> None:
        at = at[own]
        rows.append(live[own])
        symbols.append(s.name[at])
        times.append(count[own])
        slots.append(np.full(len(at), slot))
        unsure[rows[-1][s.unsure[at]]] = True

    while len(live):
        t = 4 * s.round
        s.find_runs()
        left, right = s.block[low], s.block[high - 1]
        one = left == right
        every = np.ones(len(live), bool)
        apart(every, low, np.where(one, high, s.first[left + 1]) - low, t)
        apart(~one, high - 1, high - s.first[right], t + 1)
        ok = left + 1 < right
        live, low, high = live[ok], left[ok] + 1, right[ok]
        s.name_runs()
        s.find_pairs()
        single = np.ones(len(live), np.int64)
        out = s.side[low] == 1
        apart(out, low, single, t + 2)
        low = low + out
        out = (low < high) & (s.side[high - 1] == 0)
        apart(out, high - 1, single, t + 3)
        high = high - out
        ok = low < high
        live, low, high = live[ok], s.into[low[ok]], s.into[high[ok] - 1] + 1
        s.name_pairs()
    row, slot = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, slots))
    by = np.lexsort((slot, row))
    spelt = np.empty(len(row), np.dtype([("symbol", "<u8"), ("how", "<u4")]))
    if len(row):
        spelt["symbol"] = np.concatenate(symbols)[by]
        spelt["how"] = np.concatenate(times)[by] << 14 | slot[by]
    digest, view = xxhash.xxh3_128_digest, memoryview(spelt.tobytes())
    ends = (np.cumsum(np.bincount(row, minlength=len(begin))) * spelt.itemsize).tolist()
    digests = [digest(view[a:b]) for a, b in zip([0, *ends], ends)]
    for i in np.flatnonzero(unsure).tolist():
        digests[i] = digest(digests[i] + b" ".join(words(int(begin[i]), int(end[i]))))
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2), s.round


@dataclass
class Stretches:
    """Stretches of texts that hold spans, in a buffer: the words' names, the stretches' offsets, each span's first word
    and end in the buffer, its own first word, its text's place, and fields."""

    names: np.ndarray
    offsets: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    row: np.ndarray
    fields: list[np.ndarray]
    words: Callable[[int, int], list[bytes]]


def _stretches(raw: list[bytes], own: pa.Array, *fields: str) -> Iterator[Stretches]:
    row, pos, *rest = passages.flat(own, "pos", *fields)
    first = pos >> 18
    end = first + (pos >> 9 & 511) - 1 + WIDTH
    by = np.lexsort((first, row))
    row, first, end, rest = row[by], first[by], end[by], [x[by] for x in rest]
    for a, b in groups([len(t) for t in raw], CHUNK):
        names, text_at = names_in(raw[a:b])
        i, j = np.searchsorted(row, [a, b])
        if i == j:
            continue
        # a stretch goes on as long as spans of its text meet, and no further than TOKENS words
        start, stop = first[i:j] + text_at[row[i:j] - a], end[i:j] + text_at[row[i:j] - a]
        reach = np.maximum.accumulate(stop)
        cut = np.flatnonzero(np.concatenate([[True], (row[i + 1 : j] != row[i : j - 1]) | (start[1:] > reach[:-1])]))
        sizes = np.maximum.reduceat(stop, cut) - start[cut]
        for x, y in groups(sizes.tolist(), TOKENS):
            low, high = cut[x], cut[y] if y < len(cut) else len(start)
            offsets = np.cumsum([0, *sizes[x:y]])
            from_ = np.repeat(start[cut[x:y]] - offsets[:-1], sizes[x:y]) + np.arange(offsets[-1])
            shift = np.repeat(start[cut[x:y]] - offsets[:-1], np.diff([*cut[x:y], high]))

            def words(p: int, q: int, from_: np.ndarray = from_, a: int = a, text_at: np.ndarray = text_at) -> list[bytes]:
                at = int(from_[p])
                t = int(np.searchsorted(text_at, at, side="right")) - 1
                return raw[a + t].split()[at - text_at[t] : at - text_at[t] + q - p]

            own_rows = slice(i + low, i + high)
            yield Stretches(names[from_], offsets, start[low:high] - shift, stop[low:high] - shift, first[own_rows], row[own_rows], [f[own_rows] for f in rest], words)


#: Rows of a survey: spans (a and what follows), names of stretches (name), different words of a batch (name and word).
_SURVEY = "a long, d1 long, d2 long, h long, pos long, m int, rounds int, name array<long>, word binary"


def _survey(odd: np.ndarray) -> Callable:
    """Spans with the digests of their spellings; the names of stretches that hold spans; their words with their names."""

    def run(raw: list[bytes], h: pa.Array, own: pa.Array) -> Iterator[pa.RecordBatch]:
        def rows(n: int, **cols: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(n, f.type)) for f in kind], schema=kind)

        words: set[bytes] = set()
        for s in _stretches(raw, own, "a", "m"):
            two, rounds = spellings(s.names, s.offsets, s.begin, s.end, odd, s.words)
            n, (a, m) = len(s.first), s.fields
            pos = s.first << 18 | (s.end - s.begin - WIDTH + 1) << 9
            yield rows(n, a=pa.array(a), d1=pa.array(two[:, 0]), d2=pa.array(two[:, 1]), h=h.take(pa.array(s.row)), pos=pa.array(pos), m=pa.array(m), rounds=pa.array(np.full(n, rounds, np.int32)))
            yield rows(len(s.offsets) - 1, name=_lists(s.offsets, pa.array(s.names.view(np.int64))))
        row, pos = passages.flat(own, "pos")
        for i in np.unique(row).tolist():
            words.update(raw[i].split())
        each = list(words)
        for x in range(0, len(each), 1 << 16):
            part = each[x : x + (1 << 16)]
            yield rows(len(part), name=_lists(np.arange(len(part) + 1), pa.array(names_of(part).view(np.int64))), word=pa.array(part, pa.binary()))

    kind = to_arrow_schema(T._parse_datatype_string(_SURVEY))
    return run


def _windows(odd: np.ndarray) -> Callable:
    """The windows of spans with the digests of their spellings."""

    def run(raw: list[bytes], h: pa.Array, own: pa.Array) -> Iterator[pa.RecordBatch]:
        for s in _stretches(raw, own, "n"):
            count = s.end - s.begin - WIDTH + 1
            of = np.repeat(np.arange(len(count)), count)
            at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            two, _ = spellings(s.names, s.offsets, s.begin[of] + at, s.begin[of] + at + WIDTH, odd, s.words)
            cols = [two[:, 0], two[:, 1], h.take(pa.array(s.row[of])), s.first[of] + at, s.fields[0][of]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["d1", "d2", "h", "first", "n"])

    return run


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _read(batch: pa.RecordBatch, number: int) -> Symbols:
    """Sequences of names before a round."""
    sizes = pc.list_value_length(batch.column(0)).to_numpy()
    s = Symbols(pc.list_flatten(batch.column(0)).to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(sizes)]))
    s.round = number
    return s


def _next(number: int) -> Callable:
    """Sequences after a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = _read(batch, number)
                for step in (s.find_runs, s.name_runs, s.find_pairs, s.name_pairs):
                    step()
                cuts = np.concatenate([[0], np.cumsum(np.bincount(s.doc, minlength=batch.num_rows))])
                yield pa.RecordBatch.from_arrays([_lists(cuts, pa.array(s.name.view(np.int64)))], names=["name"])

    return run


def _dictionary(number: int) -> Callable:
    """The names that a round makes, with what they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = _read(batch, number)
                s.find_runs()
                s.name_runs()
                made = [np.stack(s.made)]
                s.find_pairs()
                s.name_pairs()
                rows = np.concatenate([*made, np.stack(s.made)], axis=1)
                rows = rows[:, np.lexsort(rows)]
                new = np.ones(rows.shape[1], bool)
                new[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in rows[:, new]], names=["name", "left", "right"])

    return run


def ambiguous(survey: DataFrame, rounds: int, scratch: Scratch) -> np.ndarray:
    """The names made in these rounds, over all stretches of the survey, that stand for more than one thing."""

    def some(found: DataFrame) -> list[int]:
        return [r.name for r in found.select("name").limit(MOST_AMBIGUOUS + 1).collect()]

    words = survey.filter("word is not null").groupBy(F.col("name")[0].alias("name"), "word").agg(F.count("*").alias("n"))
    out = some(words.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1"))
    now, old, untold = survey.filter("word is null and name is not null"), None, None
    for number in range(rounds):
        now = now.select("name").filter("size(name) > 1")
        names = now.mapInArrow(_dictionary(number), "name long, left long, right long")
        if number >= TAGGED:  # names of these rounds are not told apart by their tags
            untold = names if untold is None else untold.unionByName(names)
            names = untold
        least = [f(c).alias(f"{n}_{c}") for c in ("left", "right") for n, f in (("low", F.min), ("high", F.max))]
        out += some(names.groupBy("name").agg(*least).filter("low_left < high_left or low_right < high_right"))
        if number + 1 < rounds:
            now = scratch.put(now.mapInArrow(_next(number), "name array<long>"))
            scratch.release()
            if old is not None and number < TAGGED:
                scratch.drop(old)
            old = now
    if len(out) > MOST_AMBIGUOUS:
        raise RuntimeError("too many names stand for two things: names must be wider for so much text")
    return np.unique(np.array(out, np.int64).view(np.uint64))


def repeats(texts: Texts, scratch: Scratch) -> DataFrame:
    """(h, mark) of the texts with repeated windows."""
    spans = passages.spans_of(texts, WORDS, scratch)
    odd = np.zeros(0, np.uint64)
    while True:
        survey = scratch.put(passages.with_texts(texts, spans, _survey(odd), _SURVEY, "pos", "a", "m"))
        scratch.release()
        sums = [F.sum("m").cast("long").alias("n"), F.min("h").alias("h"), F.min_by("pos", "h").alias("pos"), F.max("rounds").alias("rounds")]
        classes = scratch.put(survey.filter("a is not null").groupBy("a", "d1", "d2").agg(*sums))
        found = odd if len(odd) else ambiguous(survey, classes.agg(F.max("rounds")).first()[0] or 0, scratch)
        scratch.drop(survey)
        scratch.release()
        if len(found) == len(odd):
            break
        odd = found
    edges = passages.contested(classes, scratch).select("h", "pos", "n")
    each = passages.with_texts(texts, edges, _windows(odd), "d1 long, d2 long, h long, first long, n long", "pos", "n")
    alone = each.groupBy("d1", "d2").agg(F.sum("n").alias("n"), F.min("h").alias("h"), F.min("first").alias("first")).filter("n = 1")
    alone = scratch.put(alone.select("h", "first"))
    scratch.release()
    marks = spans.select("h", mark(passages.SPAN, F.col("pos")).alias("mark"))
    return marks.union(alone.select("h", mark(passages.NOT_WINDOW, F.col("first"), F.col("first")).alias("mark")))


def _finish(text: bytes, marks: tuple | None) -> tuple:
    words = text.split()
    rest = words
    if marks:
        at, rest = 0, []
        for a, b in removed(*marks, WIDTH):
            rest += words[at:a]
            at = b
        rest = rest + words[at:]
    joined = b" ".join(rest)
    return len(words), len(words) - len(rest), hashlib.sha256(joined).hexdigest(), joined


_RESULT = "struct<n_words: long, n_removed: long, kept_sha256: string, kept: binary>"


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row of docs: `row`, its columns but the text, `empty`, whether the text is null, and `cut`: n_words,
    n_removed, kept_sha256 and the kept words joined."""
    scratch = Scratch(docs.sparkSession)
    texts = passages.distinct_texts(docs, text, scratch)
    return passages.apply(docs, texts, passages.finished(texts, repeats(texts, scratch), _finish, _RESULT), text)
