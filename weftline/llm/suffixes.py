"""Suffix-array dedup by a hash-compared suffix sort.

Removes each byte covered by a string of WIDTH bytes that also starts anywhere else, in the same document or another
one; matches do not cross documents, overlaps count, and strings are judged on the input.

The plan is that of `passages`: a window's anchor is the leftmost least hash of its GRAM-byte strings. Spans are one class
where the bytes at which their windows start are equal, byte by byte, and a digest of 128 bits of all their bytes is. The
classes of an anchor come, with their bytes, to its bucket, each one suffix with a count. There the suffixes that start
at the anchor are sorted by a mergesort whose comparisons find two suffixes' common extension by binary search over
prefix polynomial hashes; neighbours' extensions are then compared byte by byte, and a sort that a hash collision
misled is done again under other bases. In suffix order, the windows that start `o` bytes before the anchor are equal
where neighbours share the WIDTH - o bytes after it and the hash of the o bytes before it; these windows are compared
byte by byte as well, and grouped by their bytes where that hash collides.

A bucket of over BUCKET suffixes is split, by the bytes round the anchor: into ranges of o, and in each by the bytes
that all windows of the range hold. Windows that are equal stay together. Parts that are equal byte by byte are repeated
and go on as one, and buckets of parts are sorted like any other, or split again, down to single windows.

Defined results: null text has no bytes; texts of under WIDTH bytes stay whole; rows repeated with the same key and
text are copies of each other, and so each loses what the other has; no rows give no rows; extra columns stay, whatever
their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import passages
from weftline.llm.common import Scratch
from weftline.llm.passages import Prefix, Texts, Unit, mark, mix, removed, runs, sliding_min

WIDTH = 200
GRAM = 32
#: Suffixes of a bucket that are sorted in one place.
BUCKET = 4096
_BASE = 0x9E3779B97F4A7C15
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return _TABLE[np.frombuffer(b"".join(texts), np.uint8)], np.cumsum([0, *map(len, texts)])


def _spans(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    if len(codes) < WIDTH:
        e = np.zeros(0, np.int64)
        return e, e, e, e, e.view(np.uint64)
    hashes = Prefix(codes, _BASE)
    at = np.arange(len(codes) - GRAM + 1)
    gram = mix(hashes.of(at, at + GRAM))
    low = np.uint64((1 << 22) - 1)
    least = sliding_min(gram & ~low | at.astype(np.uint64), WIDTH - GRAM + 1)
    anchor = (least & low).astype(np.int64)
    doc, first, count = runs(anchor, offsets, WIDTH)
    place = anchor[first] if len(first) else first
    return doc, first, count, place, gram[place]


BYTES = Unit(WIDTH, _codes, _spans)


class Hashes:
    """Prefix polynomial hashes of bytes modulo two primes; any stretch's hash in constant time."""

    PRIMES = (2147483647, 2147483629)

    def __init__(self, data: np.ndarray, seed: int) -> None:
        self.parts = []
        for k, p in enumerate(self.PRIMES):
            base = int(mix(np.array([97 * seed + k + 1], np.uint64))[0]) % (p - 1000) + 500
            power, back = self._powers(base, p, len(data)), self._powers(pow(base, -1, p), p, len(data))
            total = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data.astype(np.int64) + 1) * power[: len(data)] % p, out=total[1:])
            self.parts.append((total, back, p))

    @staticmethod
    def _powers(base: int, p: int, n: int) -> np.ndarray:
        """base**0 to base**n modulo p, by doubling."""
        out = np.ones(1, np.int64)
        step = base
        while len(out) <= n:
            out = np.concatenate([out, out * step % p])
            step = step * step % p
        return out

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Below 2**62."""
        a, b = ((total[end] - total[start]) % p * back[start] % p for total, back, p in self.parts)
        return a << 31 | b


class SuffixSort:
    """Suffixes of a buffer in order, by a bottom-up mergesort in which all runs of a level merge at once."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> None:
        """group: not falling; suffixes are sorted within equal groups. lcp: common prefixes of neighbours in order."""
        self.data, self.start, self.length, self.group = data, start, length, group
        for seed in itertools.count():
            self.hash = Hashes(data, seed)
            self.order = self._sort()
            i, j = self.order[:-1], self.order[1:]
            self.lcp = np.where(group[i] == group[j], self.common(i, j), -1)
            if self._verified():
                break

    def _verified(self) -> bool:
        """Whether the neighbours' common prefixes are equal byte by byte, end where they must, and rise in order."""
        own = np.flatnonzero(self.lcp >= 0)
        n, x, y = self.lcp[own], self.order[:-1][own], self.order[1:][own]
        a, b = self.start[x], self.start[y]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if not (self.data[np.repeat(a, n) + within] == self.data[np.repeat(b, n) + within]).all():
            return False
        short = n >= self.length[x]
        inside = ~short & (n < self.length[y])
        return bool((short | inside).all() and (self.data[a[inside] + n[inside]] < self.data[b[inside] + n[inside]]).all())

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of common prefixes, by binary search over prefix hashes."""
        a, b = self.start[i], self.start[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.hash.of(a, a + mid) == self.hash.of(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def compare(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for suffix i before, equal to or after suffix j."""
        out = np.sign(self.group[i] - self.group[j])
        own = np.flatnonzero((out == 0) & (i != j))
        if len(own):
            x, y = i[own], j[own]
            n = self.common(x, y)
            inside = (n < self.length[x]) & (n < self.length[y])
            end = len(self.data) - 1
            a = self.data[np.minimum(self.start[x] + n, end)].astype(np.int64)
            b = self.data[np.minimum(self.start[y] + n, end)].astype(np.int64)
            out[own] = np.where(inside, np.sign(a - b), np.sign(self.length[x] - self.length[y]))
        return out

    def _sort(self) -> np.ndarray:
        n = len(self.start)
        order, index, width = np.arange(n), np.arange(n), 1
        while width < n:
            block = index // (2 * width) * (2 * width)
            left = index - block < width
            low = np.minimum(np.where(left, block + width, block), n)
            high = np.minimum(np.where(left, block + 2 * width, block + width), n)
            first = low.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                c = self.compare(order[mid], order[open_])
                go = (c < 0) | (c == 0) & ~left[open_]
                low[open_] = np.where(go, mid + 1, low[open_])
                high[open_] = np.where(go, high[open_], mid)
            to = np.where(left, index, index - width) + low - first
            merged = np.empty_like(order)
            merged[to] = order
            order, width = merged, 2 * width
        return order


def _equal_windows(data: np.ndarray, x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the windows at x equal those at y, byte by byte."""
    span = np.arange(WIDTH)
    return all((data[x[k : k + 4096, None] + span] == data[y[k : k + 4096, None] + span]).all() for k in range(0, len(x), 4096))


def _regrouped(data: np.ndarray, at: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows at `at` that puts equal ones of a block together, and whether neighbours are equal."""
    whole = np.ascontiguousarray(data[at[:, None] + np.arange(WIDTH)]).view(f"V{WIDTH}").ravel()
    _, kind = np.unique(whole, return_inverse=True)
    by = np.lexsort((kind, block))
    kind, block = kind[by], block[by]
    return by, (kind[1:] == kind[:-1]) & (block[1:] == block[:-1])


def repeated_windows(data: np.ndarray, begin: np.ndarray, count: np.ndarray, off: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, window) pairs of rows' windows that equal a window of another row of the group.

    Row r's bytes are data[begin[r]:begin[r] + count[r] - 1 + WIDTH], its anchor stands at off[r].
    """
    place = begin + off
    sort = SuffixSort(data, place, count - 1 + WIDTH - off, group)
    order = sort.order
    rows, windows = [], []
    for o in range(WIDTH - GRAM + 1):
        at = off[order] - o
        part = np.flatnonzero((at >= 0) & (at < count[order]))
        if len(part) < 2:
            continue
        block = np.concatenate([[0], np.cumsum(sort.lcp < WIDTH - o)])[part]
        r = order[part]
        before = sort.hash.of(place[r] - o, place[r])
        by = np.lexsort((before, block))
        r, block, before = r[by], block[by], before[by]
        same = (block[1:] == block[:-1]) & (before[1:] == before[:-1])
        pairs = np.flatnonzero(same)
        if not len(pairs):
            continue
        if not _equal_windows(data, place[r[pairs]] - o, place[r[pairs + 1]] - o):
            by, same = _regrouped(data, place[r] - o, block)
            r = r[by]
        hit = np.zeros(len(r), bool)
        hit[:-1] |= same
        hit[1:] |= same
        rows.append(r[hit])
        windows.append(off[r[hit]] - o)
    if not rows:
        e = np.zeros(0, np.int64)
        return e, e
    return np.concatenate(rows), np.concatenate(windows)


def _cut(raw: list[bytes], h: pa.Array, own: pa.Array, *fields: str) -> tuple:
    """Spans' bytes, first windows and fields, and their texts' names."""
    row, pos, *rest = passages.flat(own, "pos", *fields)
    first = pos >> 18
    ends = first + (pos >> 9 & 511) - 1 + WIDTH
    body = [raw[i][x:y] for i, x, y in zip(row.tolist(), first.tolist(), ends.tolist())]
    return body, first, pos & 511, h.take(pa.array(row)), *rest


def _own(raw: list[bytes], h: pa.Array, own: pa.Array) -> Iterator[pa.RecordBatch]:
    """Spans with the bytes at which their windows start and a digest of all their bytes."""
    digest = xxhash.xxh3_128_digest
    body, first, off, name, a, m = _cut(raw, h, own, "a", "m")
    two = np.frombuffer(b"".join(map(digest, body)), np.int64).reshape(-1, 2)
    start = [x[: len(x) - WIDTH + 1] for x in body]
    cols = [pa.array(a), pa.array(off), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(start, pa.binary()), name, pa.array(first), pa.array(m)]
    yield pa.RecordBatch.from_arrays(cols, names=["a", "off", "d1", "d2", "own", "h", "first", "m"])


def _bodies(raw: list[bytes], h: pa.Array, own: pa.Array) -> Iterator[pa.RecordBatch]:
    """Spans with their bytes."""
    body, first, off, name, a, n = _cut(raw, h, own, "a", "n")
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(off), pa.array(body, pa.binary()), pa.array(n), name, pa.array(first)], names=["b", "off", "body", "n", "h", "first"])


def _sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (b, off, body, n, h, first) sorted by b to the repeated windows of those with n = 1; a bucket that runs over
    a batch's end is carried on."""
    rest = None

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        b, off, n, first = (batch.column(i).to_numpy() for i in (0, 1, 3, 5))
        bodies = batch.column(2).to_pylist()
        size = np.array([len(x) for x in bodies], np.int64)
        group = np.concatenate([[0], np.cumsum(b[1:] != b[:-1])])
        rows, windows = repeated_windows(np.frombuffer(b"".join(bodies), np.uint8), np.cumsum(size) - size, size - WIDTH + 1, off, group)
        mine = n[rows] == 1
        rows, windows = rows[mine], windows[mine]
        if not len(rows):
            return None
        by = np.lexsort((windows, rows))
        rows, windows = rows[by], windows[by]
        new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (windows[1:] != windows[:-1] + 1)]))
        end = np.concatenate([new[1:], [len(rows)]]) - 1
        at = first[rows[new]]
        return pa.RecordBatch.from_arrays([batch.column(4).take(pa.array(rows[new])), pa.array(at + windows[new]), pa.array(at + windows[end])], names=["h", "x", "y"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        b = batch.column(0).to_numpy()
        edge = np.flatnonzero(b[1:] != b[:-1])
        cut = int(edge[-1]) + 1 if len(edge) else 0
        rest = batch.slice(cut)
        if cut and (out := solve(batch.slice(0, cut))) is not None:
            yield out
    if rest is not None and (out := solve(rest)) is not None:
        yield out


def _split(step: int):
    """Rows (b, off, body, n, h, first) to their parts in each range of `step` places of o, named by b, the range and
    the bytes that all windows of the range hold."""
    name = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, b, off, body, first = [], [], [], [], []
            rows = zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 5)))
            for i, (bucket, o, text, start) in enumerate(rows):
                least = o - (len(text) - WIDTH)  # o falls from window to window
                for low in range(least // step * step, o + 1, step):
                    high = low + step - 1
                    x, y = max(low, least), min(high, o)
                    take.append(i)
                    b.append(name(text[o - low : o - high + WIDTH], seed=(bucket ^ low) & (1 << 64) - 1))
                    off.append(y)
                    body.append(text[o - y : o - x + WIDTH])
                    first.append(start + o - y)
            row = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(b, np.uint64).view(np.int64)), pa.array(off, pa.int64()), pa.array(body, pa.binary()), batch.column(3).take(row), batch.column(4).take(row), pa.array(first, pa.int64())],
                names=["b", "off", "body", "n", "h", "first"],
            )

    return run


_VIEW = "b long, off long, body binary, n long, h long, first long"


def bucket_hits(edges: DataFrame, scratch: Scratch, limit: int | None = None) -> list[DataFrame]:
    """Tables (h, x, y) of the repeated windows of rows (b, off, body, n, h, first) with n = 1; bodies of a b differ."""
    limit = limit or BUCKET
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same, out, step = ["b", "off", "body"], [], WIDTH - GRAM + 1
    while True:
        size = scratch.put(edges.groupBy("b").agg(F.count("*").alias("k"), F.count_if(F.col("n") == 1).alias("open")).filter("k > 1 and open > 0"))
        small = edges.join(size.filter(F.col("k") <= limit).select("b"), "b")
        ordered = small.repartition(parts, "b").sortWithinPartitions("b", "h", "first")
        out.append(scratch.put(ordered.mapInArrow(_sorted_buckets, "h long, x long, y long")))
        scratch.release()
        large = size.filter(F.col("k") > limit).select("b")
        if large.isEmpty():
            return out
        # the parts of large buckets: those with equal bytes are repeated as a whole, and one of them goes on
        step = max(1, step // 8)
        split = scratch.put(edges.join(large, "b").select(*same, "n", "h", "first").mapInArrow(_split(step), _VIEW))
        edges = scratch.put(split.groupBy(*same).agg(F.sum("n").alias("n"), F.min("h").alias("h"), F.min("first").alias("first")))
        hits = split.filter("n = 1").join(edges.filter("n > 1").select(*same), same)
        out.append(scratch.put(hits.select("h", F.col("first").alias("x"), (F.col("first") + F.length("body") - WIDTH).alias("y"))))
        if step == 1:  # all windows of a bucket were one
            return out


def repeats(texts: Texts, scratch: Scratch) -> DataFrame:
    """(h, mark) of the texts with repeated strings."""
    spans = passages.spans_of(texts, BYTES, scratch)
    each = scratch.put(passages.with_texts(texts, spans, _own, "a long, off long, d1 long, d2 long, own binary, h long, first long, m int", "pos", "a", "m"))
    scratch.release()
    sums = [F.sum("m").cast("long").alias("n"), F.min("h").alias("h"), F.min_by("first", "h").alias("first")]
    classes = each.groupBy("a", "off", "d1", "d2", "own").agg(*sums)
    count = F.length("own").cast("long")
    pos = F.shiftleft(F.col("first"), 18).bitwiseOR(F.shiftleft(count, 9)).bitwiseOR(F.col("off"))
    classes = scratch.put(classes.select("a", pos.alias("pos"), "n", "h"))
    scratch.drop(each)
    scratch.release()
    met = passages.contested(classes, scratch).select("h", "pos", "a", "n")
    edges = scratch.put(passages.with_texts(texts, met, _bodies, _VIEW, "pos", "a", "n"))
    scratch.release()
    hits = bucket_hits(edges, scratch)
    marks = spans.select("h", mark(passages.SPAN, F.col("pos")).alias("mark"))
    marks = marks.union(classes.filter("n = 1").select("h", mark(passages.NOT_SPAN, F.col("pos")).alias("mark")))
    for found in hits:
        marks = marks.union(found.select("h", mark(passages.WINDOWS, F.col("x"), F.col("y")).alias("mark")))
    return marks


def _finish(text: bytes, marks: tuple | None) -> tuple:
    cut = removed(*marks, WIDTH) if marks else []
    at, parts = 0, []
    for a, b in cut:
        parts.append(text[at:a])
        at = b
    rest = b"".join([*parts, text[at:]]) if cut else text
    return len(text), len(text) - len(rest), len(cut), hashlib.sha256(rest).hexdigest(), rest


_RESULT = "struct<n_bytes: long, n_removed: long, n_spans: long, kept_sha256: string, kept: binary>"


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row of docs: `row`, its columns but the text, `empty`, whether the text is null, and `cut`: n_bytes,
    n_removed, n_spans, kept_sha256 and the kept bytes."""
    scratch = Scratch(docs.sparkSession)
    texts = passages.distinct_texts(docs, text, scratch)
    return passages.apply(docs, texts, passages.finished(texts, repeats(texts, scratch), _finish, _RESULT), text)


def dedup_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each text reduced to what stays (a character cut in two goes as a whole). Null text stays null."""
    @F.arrow_udf("string")
    def decoded(kept: pa.Array) -> pa.Array:
        return pa.array([None if k is None else k.decode("utf-8", errors="ignore") for k in kept.to_pylist()], pa.string())

    kept = F.when(~F.col("empty"), decoded(F.col("cut.kept")))
    return dedup(docs, text).select(*[kept.alias(text) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
