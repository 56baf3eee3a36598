"""Connected components by alternating large and small stars, in DataFrame rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per component of the given links: each node but the least, with the component's least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        np.minimum.at(new, low[a], new[b])
        np.minimum.at(new, low[b], new[a])
        new = np.minimum(new, new[new])
        if (new == low).all():
            break
        low = new
    keep = low != np.arange(len(nodes))
    return nodes[keep], nodes[low[keep]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a batch replaced by a spanning star of what they connect."""
    for batch in batches:
        if batch.num_rows:
            u, v = spanning(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _least(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Each node's least neighbour, as a table: what then joins it are plain exchanges, of which Spark can split those
    of hubs."""
    return scratch.put(links.groupBy("u").agg(F.min("v").alias("m")))


def _large(links: DataFrame, scratch: Scratch) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, scratch).select("u", F.least("u", "m").alias("m"))
    return scratch.put(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).mapInArrow(_contract, "u long, v long"))


def _small(links: DataFrame, scratch: Scratch) -> DataFrame:
    least = _least(links, scratch)
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).mapInArrow(_contract, "u long, v long").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) long links to (u, v): each linked node that is not its component's least, with that least node.

    Both star steps keep components and end at stars round the least nodes in O(log^2 n) rounds; what a task holds is
    contracted in between. Each step is a table in the shared folder. Nodes with no link do not appear; self-links and repeated links are allowed; no
    links give no rows.
    """
    ordered = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = scratch.put(ordered.mapInArrow(_contract, "u long, v long").distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now
        seen, old = mark, now
        now = scratch.put(_small(_large(now, scratch), scratch))
        scratch.drop(old)
