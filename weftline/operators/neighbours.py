"""Exact nearest neighbours by cosine distance, with pivots and the triangle inequality.

Unit vectors lie at Euclidean distance sqrt(2 d) for a cosine distance d, so that distances to pivots bound distances
between vectors. Equal vectors are one class, with its least keys. Every class goes to its nearest pivot's cell; cells are
bundled, and bundles of many dealt, into blocks of about BLOCK classes. Two rounds follow:

1. within each block, the k + 1 nearest give every class a first radius (pivots give another one);
2. blocks travel whole, a packed row a cell: a task holds the queries of up to SPAN blocks and streams past them the blocks
   that a radius of theirs reaches, nearest bundles first, while radii shrink to the k + 1 nearest found. A row tells how far
   its members go from their pivot toward each other one; a query is as far from them as what is left between the two on the
   line from its own pivot to theirs, and passes the row over where that is beyond its radius.

Where the bounds prune nothing of a block, a block goes to every group of SPAN blocks once: a vector is sent n / (SPAN x BLOCK) times,
not n / BLOCK. Products are taken in single precision, and those that rounding leaves in doubt once more in double. What one
block holds is compared right away.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.folds import written

#: Classes of a block; pivots at most, and classes of a cell that their number aims at: of few and of many classes.
BLOCK, PIVOTS, CELL = 2048, 1024, 128
MANY_PIVOTS, MANY_CELL = 4096, 1024
#: Blocks of queries that a task holds at most, bytes of a packed row, bytes of blocks that pass one task, and groups of
#: queries and parts of what passes them at least (where there are so many blocks), for their product is the tasks.
SPAN, ROW_BYTES, PASS_BYTES, SIDES = 64, 1 << 20, 256 << 20, 7
#: Packed rows of an Arrow batch, products looked at once more in one step, products of a step, and vectors that meet all
#: pivots in one.
_ROWS, _DOUBTS, _TILE, _STEP = 16, 1 << 16, 1 << 18, 256
#: Distances are compared to so many digits; ties go to the lowest key.
DIGITS = 9
#: What rounding may add to a squared Euclidean distance.
_SLACK = 1e-6


@dataclass
class Cells:
    """Pivots, and of each one's cell the least and greatest distance of a member and the number of members."""

    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray
    bundle: np.ndarray
    parts: np.ndarray

    def from_pivots(self, v: np.ndarray) -> np.ndarray:
        return to_pivots(v, self.pivots)

    def radius(self, far: np.ndarray, k: int) -> np.ndarray:
        """A cosine distance within which k members lie: those of one cell, or of the cells that are sure to be nearest."""
        worst, alone = far + self.high, self.n >= k
        if alone.any():
            return worst[:, alone].min(axis=1) ** 2 / 2
        order = np.argsort(worst, axis=1)
        enough = np.argmax(np.cumsum(self.n[order], axis=1) >= k, axis=1)
        at = np.take_along_axis(worst, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0]
        return np.where(self.n.sum() >= k, at**2 / 2, np.inf)

    @property
    def first(self) -> np.ndarray:
        """Of each bundle the number of its first block; blocks are numbered along the walk."""
        return np.cumsum(self.parts) - self.parts

    def apart(self, at: np.ndarray) -> np.ndarray:
        """Distances of some pivots to all."""
        return to_pivots(self.pivots[at], self.pivots)

    def reached(self, far: np.ndarray, own: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Whether a member within the radius may lie in a cell, all cells, at whose pivots' distances `far` is."""
        held, at = np.unique(own, return_inverse=True)
        rows = np.arange(len(far))
        planes = (far**2 - far[rows, own][:, None] ** 2) / (2 * np.maximum(self.apart(held), 1e-12)[at])  # the distance to the plane between two pivots
        planes[rows, own] = 0
        low = np.maximum(np.maximum(far - self.high, self.low - far), np.maximum(planes, 0))
        return (low**2 <= 2 * radius[:, None] + _SLACK) & (self.n > 0)

    def toward(self, v: np.ndarray, cell: int) -> np.ndarray:
        """How far members of a cell go toward each pivot at most, times the pivots' distance; never less in single precision."""
        far = np.full(len(self.pivots), -np.inf)
        for lo in range(0, len(v), _STEP):
            products = v[lo : lo + _STEP] @ self.pivots.T
            far = np.maximum(far, (products - products[:, [cell]]).max(axis=0))
        return np.nextafter(far.astype(np.float32), np.float32(np.inf))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of doubles as rows; lists that are not as long as each other are an error."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    if size.size and (size != size[0]).any():
        raise ValueError("vectors are not as long as each other")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def shape(v: np.ndarray) -> np.ndarray:
    """Unit vectors with one more axis, on which zero vectors lie, at distance 1 from all others."""
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.hstack([v / np.maximum(norm, 1e-300), (norm == 0).astype(float)])


def to_pivots(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (v @ pivots.T), 0))


def _bundles(pivots: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells next to each other in a walk from pivot to nearest pivot, up to BLOCK members a bundle; and bundles' parts."""
    at, order, gone = 0, [0], np.zeros(len(pivots))
    for _ in range(1, len(pivots)):
        gone[at] = np.inf
        at = int((to_pivots(pivots[at : at + 1], pivots)[0] + gone).argmin())
        order.append(at)
    bundle, size = np.zeros(len(pivots), np.int64), [0]
    for c in order:
        if size[-1] and size[-1] + n[c] > BLOCK:
            size.append(0)
        bundle[c] = len(size) - 1
        size[-1] += int(n[c])
    return bundle, np.maximum(1, -(-np.array(size) // BLOCK))


def classes(vectors: DataFrame, k: int, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(id, v, keys): distinct vectors with their k + 1 least keys, the least of which is the id; and (key, id)."""
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null and key is not null")
    marked = rows.withColumn("h", F.sha2(F.array_join(F.col("v").cast("array<string>"), ",", "null"), 256))
    place = F.row_number().over(Window.partitionBy("h").orderBy("key"))
    few = marked.withColumn("_r", place).filter(F.col("_r") <= k + 1)
    own = written(few.groupBy("h").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("key")).alias("keys")).withColumn("id", F.col("keys")[0]))
    return own.select("id", "v", "keys"), marked.join(own.select("h", "id"), "h").select("key", "id")


def _celled(own: DataFrame, pivots: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = shape(matrix(b.column(1)))
                cell, far = np.zeros(len(v), np.int64), np.zeros(len(v))
                for lo in range(0, len(v), _STEP):
                    d = to_pivots(v[lo : lo + _STEP], pivots)
                    cell[lo : lo + _STEP], far[lo : lo + _STEP] = d.argmin(1), d.min(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], names=["id", "v", "keys", "cell", "far"])

    return written(own.mapInArrow(run, "id long, v array<double>, keys array<long>, cell long, far double"))


def layout(own: DataFrame) -> tuple[DataFrame, Cells]:
    """Classes with their cells, and the cells. Pivots are the classes with the least hashes of their ids, PIVOTS at most, or
    MANY_PIVOTS of very many; of the cells, that many rows reach the driver."""
    n = own.count()
    wanted = max(1, min(PIVOTS, n // CELL), min(MANY_PIVOTS, n // MANY_CELL))
    chosen = own.select(F.xxhash64("id").alias("h"), "v").orderBy("h").limit(wanted).collect()
    pivots = shape(np.array([r.v for r in chosen], np.float64)) if chosen else np.zeros((1, 1))
    celled = _celled(own, pivots)
    low, high, size = np.full(len(pivots), np.inf), np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in celled.groupBy("cell").agg(F.min("far").alias("a"), F.max("far").alias("b"), F.count("*").alias("n")).collect():
        low[r.cell], high[r.cell], size[r.cell] = r.a, r.b, r.n
    bundle, parts = _bundles(pivots, size)
    return celled, Cells(pivots, low, high, size, bundle, parts)


def _flat(keys: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys as rows of one width, and which of them are real."""
    width = max(map(len, keys))
    return np.array([ks + [0] * (width - len(ks)) for ks in keys], np.int64), np.arange(width) < np.array([len(ks) for ks in keys])[:, None]


def _best(q: np.ndarray, x: np.ndarray, keys: list[list[int]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each query the k + 1 nearest keys, as (query's place, key, distance), 256 queries at a time."""
    flat, held = _flat(keys)
    width = flat.shape[1]
    q, x = q[:, :-1], x[:, :-1]
    for lo in range(0, len(q), 256):
        d = np.round(1 - q[lo : lo + 256] @ x.T, DIGITS)
        most = min(k + 1, d.shape[1])
        edge = np.partition(d, most - 1, axis=1)[:, most - 1]  # a class has a key at least
        row, col = np.nonzero(d <= edge[:, None])
        real = held[col].ravel()
        dist = np.repeat(d[row, col], width)[real]
        row, own = np.repeat(row, width)[real], flat[col].ravel()[real]
        by = np.lexsort((own, dist, row))
        row, dist, own = row[by], dist[by], own[by]
        kept = np.arange(len(row)) - np.searchsorted(row, row) <= k
        yield row[kept] + lo, own[kept], dist[kept]


def _dealt(celled: DataFrame, cells: Cells) -> DataFrame:
    def of(values: np.ndarray, name: str) -> Column:
        return F.element_at(F.lit(values.tolist()), (F.col(name) + 1).cast("int")).cast("long")

    bundled = celled.withColumn("bundle", of(cells.bundle, "cell"))
    return bundled.withColumn("block", of(cells.first, "bundle") + F.pmod(F.xxhash64("id"), of(cells.parts, "bundle")))


def _measured(t: pa.Table, cells: Cells, k: int) -> tuple[np.ndarray, list[list[int]], np.ndarray, np.ndarray]:
    """Of a block's classes the vectors, the keys, a distance that k + 1 keys lie within, and which cells that reaches."""
    v, keys, own = shape(matrix(t["v"])), t["keys"].to_pylist(), t["cell"].to_numpy()
    found = np.full(len(v), np.inf)
    for row, _, dist in _best(v, v, keys, k):
        count = np.bincount(row, minlength=len(v))
        last = np.cumsum(count) - 1
        full = count == k + 1
        found[full] = dist[last[full]]
    hit = np.zeros((len(v), len(cells.n)), bool)
    for lo in range(0, len(v), _STEP):
        at = slice(lo, lo + _STEP)
        far = cells.from_pivots(v[at])
        found[at] = np.minimum(found[at], cells.radius(far, k + 1))
        hit[at] = cells.reached(far, own[at], found[at])
    return v, keys, found, hit


def reach(celled: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(id, v, radius, bundles): each class, a distance that k + 1 keys lie within, and the bundles which that reaches."""

    def solve(t: pa.Table) -> pa.Table:
        _, _, radius, hit = _measured(t, cells, k)
        bundles = [np.unique(cells.bundle[h]).tolist() for h in hit]
        return pa.table({"id": t["id"], "v": t["v"], "radius": pa.array(radius), "bundles": pa.array(bundles, pa.list_(pa.int64()))})

    return _dealt(celled, cells).groupBy("bundle", "block").applyInArrow(solve, "id long, v array<double>, radius double, bundles array<long>")


#: A packed row, of one cell: the block, its bundle, the cell, the bundles that the row's classes reach, keys a class at most,
#: and arrays as bytes.
_PACKED = "block long, bundle long, cell long, reaches array<long>, width int, ids binary, v binary, keys binary, held binary, radius binary, toward binary"


def blocks(celled: DataFrame, cells: Cells, k: int) -> DataFrame:
    """The classes with their radii in packed rows, as a table."""

    def solve(t: pa.Table) -> pa.Table:
        v, keys, radius, hit = _measured(t, cells, k)
        flat, held = _flat(keys)
        ids, own, rows = t["id"].to_numpy(), t["cell"].to_numpy(), []
        step = max(1, ROW_BYTES // (v.shape[1] * 8 + flat.shape[1] * 8 + 24))
        for cell in np.unique(own):
            members = np.flatnonzero(own == cell)
            for lo in range(0, len(members), step):
                at = members[lo : lo + step]
                reaches = np.unique(cells.bundle[hit[at].any(axis=0)]).tolist()
                arrays = ids[at], v[at], flat[at], held[at].sum(axis=1), radius[at], cells.toward(v[at], cell)
                rows.append([t["block"][0].as_py(), t["bundle"][0].as_py(), int(cell), reaches, flat.shape[1], *(np.ascontiguousarray(a).tobytes() for a in arrays)])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), *[pa.binary()] * 6]
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _PACKED.split(", ")])

    return written(_dealt(celled, cells).groupBy("bundle", "block").applyInArrow(solve, _PACKED))


@contextmanager
def _few_rows(spark: SparkSession) -> Iterator[None]:
    """Small Arrow batches, as packed rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _Asked:
    """A task's queries and the k + 1 nearest keys of each so far; what lies beyond the radius is left out."""

    def __init__(self, rows: list[dict], cells: Cells, k: int) -> None:
        def whole(name: str, kind: type) -> np.ndarray:
            return np.concatenate([np.frombuffer(r[name], kind) for r in rows])

        self.cells, self.k = cells, k
        self.ids, self.radius = whole("ids", np.int64), whole("radius", np.float64)
        self.v = whole("v", np.float64).reshape(len(self.ids), -1)
        self.short = self.v[:, :-1].astype(np.float32)
        self.doubt = (self.v.shape[1] + 8) * 2.0**-22 + 2 * 10.0**-DIGITS
        self.row_cell, self.row_n = np.array([r["cell"] for r in rows]), np.array([len(r["ids"]) // 8 for r in rows])
        self.row_toward, self.row_at = np.stack([np.frombuffer(r["toward"], np.float32) for r in rows]), np.cumsum(self.row_n) - self.row_n
        self.row_of = np.repeat(np.arange(len(rows)), self.row_n)
        self.near = np.concatenate([self.v[lo : lo + n] @ cells.pivots[c] for lo, n, c in zip(self.row_at, self.row_n, self.row_cell)])
        self.room = np.empty(0, np.float32)
        self.dist, self.key = np.full((len(self.ids), k + 1), np.inf), np.zeros((len(self.ids), k + 1), np.int64)

    def _room(self, rows: int, width: int) -> np.ndarray:
        """Memory that products take in turn."""
        if len(self.room) < rows * width:
            self.room = np.empty(rows * width, np.float32)
        return self.room[: rows * width].reshape(rows, width)

    def reaching(self, cell: int, toward: np.ndarray) -> np.ndarray:
        """The queries within whose radius a member of a row may lie; toward: how far its members go toward each pivot."""
        pivot, radius = self.cells.pivots[cell], np.minimum(self.radius, 4)
        apart = to_pivots(pivot[None], self.cells.pivots[self.row_cell])[0]
        least = -toward[self.row_cell].astype(np.float64)
        most = np.sqrt(2 * np.maximum.reduceat(radius, self.row_at) + _SLACK) * apart + 1e-9
        near = (least - self.row_toward[:, cell] <= most) | (self.row_cell == cell)  # of all queries of a row the farthest
        at = np.flatnonzero(np.repeat(near, self.row_n))
        row = self.row_of[at]
        left = least[row] - (self.v[at] @ pivot - self.near[at])
        return at[(left <= np.sqrt(2 * radius[at] + _SLACK) * apart[row] + 1e-9) | (self.row_cell[row] == cell)]

    def meet(self, row: dict) -> None:
        todo = self.reaching(row["cell"], np.frombuffer(row["toward"], np.float32))
        if not len(todo):
            return
        n = np.frombuffer(row["held"], np.int64)
        x = np.frombuffer(row["v"], np.float64).reshape(len(n), -1)[:, :-1]
        keys, held = np.frombuffer(row["keys"], np.int64).reshape(len(n), -1), np.arange(row["width"]) < n[:, None]
        short = np.ascontiguousarray(x.astype(np.float32).T)
        step = max(64, _TILE // len(n))
        for lo in range(0, len(todo), step):
            q = todo[lo : lo + step]
            s = np.matmul(self.short[q], short, out=self._room(len(q), len(n)))
            least = (1 - self.radius[q] - self.doubt).astype(np.float32)
            some = np.flatnonzero(s.max(axis=1) >= least)
            q, s, least = q[some], s[some], least[some]
            hit = np.flatnonzero(s >= least[:, None])
            many = np.bincount(hit // len(n), minlength=len(q)) > 8 * (self.k + 1)
            if many.any() and len(n) > self.k:  # a class has a key at least: k + 1 nearest classes are enough
                top = np.partition(s[many], len(n) - self.k - 1, axis=1)[:, len(n) - self.k - 1]
                least[many] = np.maximum(least[many], top - np.float32(2 * self.doubt))
                hit = np.flatnonzero(s >= least[:, None])
            for at in range(0, len(hit), _DOUBTS):
                r, c = np.divmod(hit[at : at + _DOUBTS], len(n))
                self._take(q[r], np.round(1 - np.einsum("ij,ij->i", self.v[q[r], :-1], x[c]), DIGITS) + 0.0, keys[c], held[c])

    def _take(self, q: np.ndarray, dist: np.ndarray, keys: np.ndarray, held: np.ndarray) -> None:
        near = dist <= self.radius[q] + 2 * 10.0**-DIGITS
        q, dist, keys, held = q[near], dist[near], keys[near], held[near]
        old = np.unique(q)
        row = np.concatenate([np.repeat(old, self.k + 1), np.repeat(q, keys.shape[1])[held.ravel()]])
        far = np.concatenate([self.dist[old].ravel(), np.repeat(dist, keys.shape[1])[held.ravel()]])
        key = np.concatenate([self.key[old].ravel(), keys.ravel()[held.ravel()]])
        by = np.lexsort((key, far, row))
        row, far, key = row[by], far[by], key[by]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place <= self.k
        self.dist[row[kept], place[kept]], self.key[row[kept], place[kept]] = far[kept], key[kept]
        self.radius[old] = np.minimum(self.radius[old], self.dist[old, self.k])

    def found(self) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(self.ids), 4096):
            dist = self.dist[lo : lo + 4096]
            row, place = np.nonzero(dist < np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[lo + row]), pa.array(self.key[lo + row, place]), pa.array(dist[row, place])], names=["id", "neighbour", "distance"])


def sides(n_blocks: int, n_bytes: int) -> tuple[int, int]:
    """Blocks of a group of queries, and parts in which other blocks pass a group: the fewer, the sooner radii shrink."""
    span = max(1, min(SPAN, -(-n_blocks // SIDES)))
    groups = max(1, -(-n_blocks // span))
    return span, max(min(SIDES, -(-SIDES * SIDES // groups)), -(-n_bytes // PASS_BYTES))


def meetings(packed: DataFrame, span: int, parts: int) -> DataFrame:
    """Packed rows by (group, part), those of the group's queries (kind 0) before those that pass them (kind 1)."""
    group = F.floor(F.col("block") / span).cast("long").alias("group")
    reached = packed.select(group, F.explode("reaches").alias("bundle")).distinct()
    asked = packed.select(group, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), F.lit(0.0).alias("far"), *packed.columns)
    passing = packed.join(reached, "bundle").withColumn("far", F.abs(F.col("block") - (F.col("group") + 0.5) * span))
    passing = passing.withColumn("radius", F.lit(None).cast("binary"))
    passing = passing.select("group", F.pmod("block", F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "far", *packed.columns)
    return asked.unionByName(passing).drop("reaches")


def _met(celled: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(id, neighbour, distance): each class beside the blocks that it reaches, as a table."""
    total = int(cells.parts.sum())
    span, parts = sides(total, int(cells.n.sum()) * (cells.pivots.shape[1] + k + 1) * 8)
    task = (F.col("group") * parts + F.col("part")).cast("int")
    dealt = meetings(blocks(celled, cells, k), span, parts).withColumn("task", task).repartitionById(-(-total // span) * parts, "task").sortWithinPartitions("task", "kind", "far")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows, asked = None, [], None
        for b in batches:
            for r in b.to_pylist():
                if r["task"] != task:
                    if asked is not None:
                        yield from asked.found()
                    task, rows, asked = r["task"], [], None
                if r["kind"] == 0:
                    rows.append(r)
                    continue
                if asked is None:
                    rows, asked = [], _Asked(rows, cells, k)
                asked.meet(r)
        if asked is not None:
            yield from asked.found()

    with _few_rows(celled.sparkSession):
        return written(dealt.mapInArrow(run, "id long, neighbour long, distance double"))


def _within(own: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, distance) of classes that one block holds."""

    def solve(t: pa.Table) -> pa.Table:
        v, ids = shape(matrix(t["v"])), t["id"].to_numpy()
        row, near, dist = (np.concatenate(c) for c in zip(*_best(v, v, t["keys"].to_pylist(), k)))
        return pa.table({"id": ids[row], "neighbour": near, "distance": dist})

    return own.groupBy(F.lit(0).alias("block")).applyInArrow(solve, "id long, neighbour long, distance double")


def nearest(vectors: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    """(query, rank, neighbour, distance) of each vector's k nearest others by cosine distance (ties: lowest key).

    Zero vectors are at distance 1 from all; vectors or keys that are null take no part; keys must be distinct.
    """
    own, members = classes(vectors, k, key, vector)
    if own.count() <= BLOCK:
        met = _within(own, k)
    else:
        celled, cells = layout(own)
        met = _met(celled, cells, k)
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))
    best = met.withColumn("_r", place).filter(F.col("_r") <= k + 1).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))).alias("x"))
    found = members.join(best, "id").select("key", F.slice(F.filter("x", lambda e: e.neighbour != F.col("key")), 1, k).alias("x"))
    return found.select(F.col("key").alias("query"), F.posexplode("x").alias("r", "e")).select("query", (F.col("r") + 1).alias("rank"), "e.neighbour", "e.distance")
