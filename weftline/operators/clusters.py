"""k-means by Lloyd's rounds with farthest-first seeds: the same rows give the same clusters, in whatever order they come.

A seed is the row farthest from those before it (ties: lowest key), the first being the row of the lowest key. A round sums
each centroid's vectors where they lie; k rows a task leave it, and k x dimensions numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.folds import written
from weftline.operators.neighbours import matrix


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, summed term by term."""
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def farthest_first(rows: DataFrame, k: int) -> np.ndarray:
    """k seeds from (key, v); fewer where there are fewer different vectors."""
    first = rows.orderBy("key").limit(1).collect()
    if not first:
        return np.zeros((0, 0))
    seeds = np.array([first[0].v], np.float64)
    while len(seeds) < k:
        held = seeds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    far = distances(matrix(b.column(1)), held).min(1)
                    keys = b.column(0).to_numpy()
                    i = np.lexsort((keys, -far))[0]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array(far[i : i + 1])], names=["key", "v", "far"])

        # one row a batch is left
        best = rows.mapInArrow(run, "key long, v array<double>, far double").agg(F.max_by(F.struct("v", "far"), F.struct("far", -F.col("key"))).alias("x")).first().x
        if not best.far > 0:
            break
        seeds = np.vstack([seeds, best.v])
    return seeds


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows with the cluster of the nearest centroid (ties: the first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(distances(matrix(b.column(1)), centroids).argmin(1))], names=["key", "v", "cluster"])

    return rows.mapInArrow(run, "key long, v array<double>, cluster long")


def lloyd(rows: DataFrame, seeds: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after so many rounds, or once they stand still; a centroid without vectors stays."""
    centroids = seeds
    for _ in range(rounds):
        held = centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, n = np.zeros_like(held), np.zeros(len(held), np.int64)
            for b in batches:
                if b.num_rows:
                    x = matrix(b.column(1))
                    own = distances(x, held).argmin(1)
                    sums += np.eye(len(held))[own].T @ x
                    n += np.bincount(own, minlength=len(held))
            at, both = np.flatnonzero(n), np.hstack([sums, n[:, None].astype(float)])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(both[at]), pa.list_(pa.float64()))], names=["cluster", "s"])

        parts = rows.mapInArrow(run, "cluster long, s array<double>")
        total = np.zeros((len(held), held.shape[1] + 1))
        for r in parts.select("cluster", F.posexplode("s").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x")).collect():  # k x dimensions
            total[r.cluster, r.i] = r.x
        n = total[:, -1:]
        moved = np.where(n > 0, total[:, :-1] / np.maximum(n, 1), held)
        if np.abs(moved - held).max(initial=0) < 1e-12:
            break
        centroids = moved
    return centroids


def kmeans(vectors: DataFrame, key: str, vector: str, k: int, rounds: int = 20) -> DataFrame:
    """(key, v, cluster): unit vectors and their clusters. Null keys and vectors take no part; keys must be distinct and
    vectors as long as each other."""
    from weftline.operators.vectors import unit

    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).filter("key is not null and v is not null")
    rows = written(rows.select("key", unit(F.col("v")).alias("v")))
    seeds = farthest_first(rows, k)
    if not len(seeds):
        return rows.withColumn("cluster", F.lit(0).cast("long"))
    return assigned(rows, lloyd(rows, seeds, rounds))


def kmeans_sql(source: str, key: str, vector: str, k: int, rounds: int = 20) -> str:
    """SQL for the same clusters, as CTEs that end in km(key, cluster); source: a relation whose vectors are DOUBLE[]."""
    far = "list_sum(list_transform(list_zip(u, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"""ku AS (SELECT {key} AS key, CASE WHEN list_dot_product({vector}, {vector}) > 0 THEN list_transform({vector}, lambda x: x / sqrt(list_dot_product({vector}, {vector}))) ELSE {vector} END AS u FROM {source}),
seeds(i, cs) AS (SELECT 1, [arg_min(u, key)] FROM ku UNION ALL
 SELECT i + 1, list_append(cs, u) FROM (SELECT i, any_value(cs) AS cs, arg_max(u, (d, -key)) AS u, max(d) AS d FROM (SELECT i, cs, u, key, list_min(list_transform(cs, lambda c: {far})) AS d FROM seeds, ku) GROUP BY i) WHERE i < {k} AND d > 0),
lloyd(r, cs) AS (SELECT 0, arg_max(cs, i) FROM seeds UNION ALL
 SELECT r + 1, list(c ORDER BY j) FROM (SELECT r, j, coalesce(list(m ORDER BY d) FILTER (m IS NOT NULL), any_value(old)) AS c FROM (
  SELECT g.r, g.j, g.old, g.d, avg(a.u[g.d]) AS m FROM (SELECT r, j, cs[j] AS old, d FROM lloyd, range(1, {k + 1}) AS t(j), range(1, len(cs[1]) + 1) AS s(d) WHERE j <= len(cs)) g
  LEFT JOIN (SELECT u, list_position(ds, list_min(ds)) AS j FROM (SELECT u, list_transform(cs, lambda c: {far}) AS ds FROM lloyd, ku)) a ON a.j = g.j GROUP BY ALL) GROUP BY r, j) WHERE r < {rounds} GROUP BY r),
km AS (SELECT key, list_position(ds, list_min(ds)) - 1 AS cluster FROM (SELECT key, list_transform(cs, lambda c: {far}) AS ds FROM (SELECT arg_max(cs, r) AS cs FROM lloyd), ku))"""
