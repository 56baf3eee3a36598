"""Places of rows in a global order, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.folds import written


def numbered(rows: DataFrame, *by: str) -> DataFrame:
    """rows with place, from 0 in the order of `by`; ties in all of them have any order.

    Ranges are sorted and written once, so that a row's place in its range is fixed; what meets in one place is a row
    per range.
    """
    dealt = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    starts = F.broadcast(sizes.select("_part", before.alias("_start")))  # a row per range
    met = dealt.join(starts, part == F.col("_part"))
    return met.withColumn("place", F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_start")
