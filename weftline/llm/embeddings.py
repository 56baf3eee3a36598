"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors link when their labels are equal and not null and their cosine, in double precision, reaches the threshold.
Vectors that are null, zero, or hold null or non-finite components link with nothing.

Equal vectors of a label become one class with a count. Unit vectors are turned onto the principal axes of all of
them, which keeps products. Two unit vectors at cosine t are at most sqrt(2 - 2t) apart, so classes go to bins of half
that width along the first axis, and bins, in ranges of the second axis, to tiles of about TILE classes. Tiles at most
two bins apart meet if their boxes over the first BOX axes are near enough. In a pair of tiles, products are summed over leading axes first; what the other axes can add is bounded by the
product of the suffix norms, and a pair is dropped once the bound stays under the threshold. Pairs left are computed
from the vectors as they are, a block of a few rows at a time. A pair of tiles passes on link counts and a spanning star,
and holds no more of its pairs than a block's.

Defined results: n_links counts the other vectors linked directly (copies among them), component_id is the smallest
vec_id reachable (itself where nothing is), null ids are kept; vectors of unlike lengths do not link; repeated rows
count as vectors of their own; vectors of any length are compared whole; extra columns stay out of the result, whatever
their names; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch
from weftline.llm.components import components, spanning

TILE = 1024
#: Rows and columns of a block within a pair of tiles.
ROWS, COLUMNS = 64, 1024
BOX = 8
#: Ranges of the second axis that a bin is cut into at most; larger ones are dealt by hash.
RANGES = 64
#: Products are bounded after each of these shares of the axes.
STEPS = (8, 4, 2, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of unit vectors' components, per length of vector."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        sizes = pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False)
        for d in np.unique(sizes):
            x = _matrix(batch.column(0).filter(pa.array(sizes == d)))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            sums[int(d)] = sums.get(int(d), 0) + x.T @ x
    for d, s in sums.items():
        n = d * d
        yield pa.RecordBatch.from_arrays([pa.array([d] * n, pa.int64()), pa.array(np.arange(n)), pa.array(s.ravel())], names=["d", "i", "s"])


def axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes (columns, widest first) for each length of vector."""
    total = classes.select("v").mapInArrow(_moments, "d long, i long, s double").groupBy("d", "i").agg(F.sum("s").alias("s"))
    found: dict[int, dict[int, float]] = {}
    for r in total.collect():  # a square of the vectors' length, whatever their number
        found.setdefault(r.d, {})[r.i] = r.s
    out = {}
    for d, s in found.items():
        m = np.array([s[i] for i in range(d * d)]).reshape(d, d)
        out[d] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    return out


def near(x: np.ndarray, y: np.ndarray, turn: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of x and y whose cosine reaches the threshold, a block of ROWS x COLUMNS pairs at a time."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    a, b = (x / nx[:, None]) @ turn, (y / ny[:, None]) @ turn
    d = x.shape[1]
    least = threshold - 1e-9
    cuts = sorted({max(1, d // s) for s in STEPS})
    rest_a, rest_b = ({k: np.sqrt((m[:, k:] ** 2).sum(1)) for k in cuts} for m in (a, b))
    for lo in range(0, len(x), ROWS):
        for at in range(0, len(y), COLUMNS):
            p, q, c = a[lo : lo + ROWS], b[at : at + COLUMNS], cuts[0]
            ra, rb = ({k: r[o : o + n] for k, r in rest.items()} for rest, o, n in ((rest_a, lo, ROWS), (rest_b, at, COLUMNS)))
            lead = p[:, :c] @ q[:, :c].T
            i, j = np.nonzero(lead + np.outer(ra[c], rb[c]) >= least)
            part = lead[i, j]
            for k in cuts[1:]:
                part = part + np.einsum("ij,ij->i", p[i, c:k], q[j, c:k])
                keep = part + ra[k][i] * rb[k][j] >= least
                i, j, part, c = i[keep], j[keep], part[keep], k
            i, j = i + lo, j + at
            cosine = (x[i] * y[j]).sum(1) / (nx[i] * ny[j])
            keep = cosine >= threshold
            yield i[keep], j[keep]


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per row: key, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    v = vectors[vector].cast("array<double>")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    valid = F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & (norm > 0) & (norm < math.inf)
    rows = vectors.select(vectors[key].alias("key"), vectors[label].alias("label"), v.alias("v"))
    rows = rows.withColumn("ok", F.coalesce(valid, F.lit(False)))
    rows = scratch.put(rows.withColumn("v", F.when(F.col("ok"), F.col("v"))))
    same = rows.filter("ok").groupBy("label", "v").agg(F.count("*").alias("n"), F.min("key").alias("least"))
    classes = scratch.put(same.withColumn("c", F.monotonically_increasing_id()))
    turns = axes(classes)
    reach = math.sqrt(2 - 2 * threshold) + 1e-9

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            box = np.zeros((len(sizes), max(BOX, 2)))
            for d in np.unique(sizes):
                own = sizes == d
                x = _matrix(batch.column(2).filter(pa.array(own)))
                turned = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ turns[int(d)][:, : box.shape[1]]
                box[own, : turned.shape[1]] = turned
            bins = np.floor(box[:, 0] / (reach / 2)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes.astype(np.int64)), pa.array(bins), pa.array(list(box), pa.list_(pa.float64()))], names=[*batch.schema.names, "d", "bin", "box"])

    kind = vectors.schema[label].dataType.simpleString()
    binned = scratch.put(classes.select("c", "label", "v", "n").mapInArrow(placed, f"c long, label {kind}, v array<double>, n long, d long, bin long, box array<double>"))
    second = F.col("box")[1]
    cuts = F.percentile_approx(second, [k / RANGES for k in range(1, RANGES)], 1000)
    bins = binned.groupBy("label", "d", "bin").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), cuts.alias("cuts"))
    ranges = F.least("tiles", F.lit(RANGES))
    # of the RANGES - 1 cuts, those that part a bin into as many ranges as it has tiles
    chosen = F.transform(F.when(ranges > 1, F.sequence(F.lit(1), ranges - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.element_at("cuts", (k * RANGES / ranges).cast("int")))
    bins = scratch.put(bins.select("label", "d", "bin", chosen.alias("cuts"), F.ceil(F.col("tiles") / RANGES).cast("long").alias("deal")))
    place = F.size(F.filter("cuts", lambda x: x < second)).cast("long")
    tiled = binned.join(bins, ["label", "d", "bin"]).withColumn("i", place * F.col("deal") + F.pmod(F.xxhash64("c"), F.col("deal")))
    tiled = scratch.put(tiled.select("c", "label", "v", "n", "d", "bin", "i", "box"))
    # ranges of more than TILE, as of ties on the second axis, are dealt by hash
    deal = tiled.groupBy("label", "d", "bin", "i").agg(F.ceil(F.count("*") / TILE).cast("long").alias("deal")).filter("deal > 1")
    again = F.pmod(F.xxhash64("c", F.lit(1)), F.coalesce("deal", F.lit(1)))
    tiled = tiled.join(deal, ["label", "d", "bin", "i"], "left").withColumn("i", F.shiftleft("i", 32) + again).drop("deal")
    tiled = scratch.put(tiled.select("c", "label", "v", "n", "d", "bin", "i", "box"))
    ends = [f(F.col("box")[k]).alias(f"{name}{k}") for k in range(BOX) for name, f in (("low", F.min), ("high", F.max))]
    boxes = scratch.put(tiled.groupBy("label", "d", "bin", "i").agg(*ends))
    other = boxes.withColumnsRenamed({"bin": "b2", "i": "j"} | {f"{x}{k}": f"{x}_{k}" for x in ("low", "high") for k in range(BOX)})
    gap = sum((F.pow(F.greatest(F.col(f"low_{k}") - F.col(f"high{k}"), F.col(f"low{k}") - F.col(f"high_{k}"), F.lit(0.0)), 2) for k in range(BOX)), F.lit(0.0))
    meets = boxes.withColumn("b2", F.explode(F.array(*[F.col("bin") + k for k in range(3)]))).join(other, ["label", "d", "b2"])
    pairs = meets.filter("bin < b2 or i <= j").filter(gap <= reach * reach).select("label", "d", "bin", "i", "b2", "j")
    sides = scratch.put(
        pairs.withColumn("pair", F.monotonically_increasing_id()).select(
            "pair", "label", "d", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("bin"), F.col("i")), F.struct(F.lit(1).alias("side"), F.col("b2").alias("bin"), F.col("j").alias("i")))).alias("t")
        ).select("pair", "label", "d", "t.side", "t.bin", "t.i", F.lit(True).alias("x"))
    )
    # a tile that meets itself has one side
    alone = sides.groupBy("pair", "label", "d", "bin", "i").agg(F.min("side").alias("side"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = tiled.join(alone, ["label", "d", "bin", "i"]).select("pair", "side", "c", "n", "v")
    met = met.repartition(parts, "pair").sortWithinPartitions("pair", "side")

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        pair, side, c, n = (batch.column(i).to_numpy() for i in range(4))
        x = _matrix(batch.column(4))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        own = not len(right)
        right = left if own else right
        degree = np.zeros(len(c), np.int64)
        star = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, j in near(x[left], x[right], turns[x.shape[1]], threshold):
            i, j = left[i], right[j]
            if own:
                keep = i < j
                i, j = i[keep], j[keep]
            degree += np.bincount(i, n[j], len(c)).astype(np.int64) + np.bincount(j, n[i], len(c)).astype(np.int64)
            # what is held of the links is a spanning star
            star = spanning(np.concatenate([star[0], c[i]]), np.concatenate([star[1], c[j]]))
        linked = np.flatnonzero(degree)
        if not len(linked):
            return None
        a, b = star
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([c[linked], a])), pa.array(np.concatenate([c[linked], b])), pa.array(np.concatenate([degree[linked], np.zeros(len(a), np.int64)]))], names=["u", "v", "w"]
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            pair = batch.column(0).to_numpy()
            bounds = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist()]
            for a, b in zip(bounds, bounds[1:]):
                if (out := solve(batch.slice(a, b - a))) is not None:
                    yield out
            rest = batch.slice(bounds[-1])
        if rest is not None and (out := solve(rest)) is not None:
            yield out

    found = scratch.put(met.mapInArrow(compare, "u long, v long, w long"))
    stars = components(found.select("u", "v"), scratch)
    degree = found.groupBy("u").agg(F.sum("w").alias("deg")).withColumnRenamed("u", "c")
    rooted = classes.join(stars.select(F.col("u").alias("c"), F.col("v").alias("root")), "c", "left").join(degree, "c", "left")
    rooted = scratch.put(rooted.select("label", "v", "n", "least", F.coalesce("root", "c").alias("root"), F.coalesce("deg", F.lit(0)).alias("deg")))
    least = rooted.groupBy("root").agg(F.min("least").alias("comp"))
    named = rooted.join(least, "root").select("label", "v", (F.col("n") - 1 + F.col("deg")).alias("links"), "comp", F.lit(True).alias("ok"))
    out = rows.join(named, ["label", "v", "ok"], "left")
    component = F.coalesce("comp", "key")
    return out.select(
        F.col("key").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept")
    )
