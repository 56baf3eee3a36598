"""Results that grow shard by shard: partial sums that merge, snapshots that a second run does not double, and metrics that
are observed as rows pass.

A shard's snapshot holds sums and counts, not means, so that merging is addition; it is written over in one stroke, so that a
shard that runs again counts once. Shards without a snapshot are what a run that was stopped has left to do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from weftline.operators.ranking import metrics
from weftline.sources.readers import exists

SHARD = "shard"


def partial(ranks: DataFrame, rank: str, *by: str) -> DataFrame:
    """n and the sum of each metric, a row per value of by."""
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(c).alias(name) for name, c in metrics(F.col(rank)).items()])


def merge(partials: DataFrame, *by: str, digits: int = 6) -> DataFrame:
    """Means from partial sums of any shards, as `ranking.mean_metrics` gives them for all rows at once."""
    names = [c for c in partials.columns if c not in (*by, SHARD, "n")]
    sums = partials.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.sum(c).alias(c) for c in names])
    return sums.select(*by, "n", *[F.coalesce(F.round(F.try_divide(F.col(c), F.col("n")), digits), F.lit(0.0)).alias(c) for c in names])


def snapshot(rows: DataFrame, shard: int, root: str, /, **observed) -> dict:
    """rows as the shard's snapshot under root, in place of an earlier one; the observed aggregates of the rows that were
    written, taken in the same pass."""
    watch = Observation()
    aggs = [c.alias(n) for n, c in observed.items()] or [F.count(F.lit(1)).alias("rows")]
    rows.observe(watch, *aggs).write.mode("overwrite").parquet(f"{root}/{SHARD}={shard}")
    return watch.get


def done_shards(spark: SparkSession, root: str, shards: int) -> list[int]:
    """Shards whose snapshot is whole."""
    return [k for k in range(shards) if exists(spark, f"{root}/{SHARD}={k}")]


def run_shards(rows: DataFrame, shard: str, shards: int, root: str, work: Callable[[DataFrame], DataFrame], report: Callable[[int, dict], None] = lambda k, m: None) -> DataFrame:
    """work(rows of a shard) for each of the shards that has no snapshot yet, and all snapshots read together; report is
    told each shard's observed number of rows as it ends."""
    spark = rows.sparkSession
    ready, schema = set(done_shards(spark, root, shards)), None
    for k in range(shards):
        out = work(rows.filter(F.col(shard) == k))
        schema = out.schema
        if k not in ready:
            report(k, snapshot(out, k, root, rows=F.count(F.lit(1))))
    return spark.read.schema(schema.add(SHARD, IntegerType())).parquet(root)
