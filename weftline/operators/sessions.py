"""Sessions from completed items, history splits and item marks; every window is partitioned by user, so that one
shuffle on the user serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COMPLETE_PCT = 80.0
HEAD_SHARE = 0.2
SOURCES = 3


def completed(pct: Column) -> Column:
    """A missing share counts as zero."""
    return F.coalesce(pct, F.lit(0.0)) >= COMPLETE_PCT


def head_split(items: DataFrame, user: str = "user_id", order: tuple[str, ...] = ("pos",), share: float = HEAD_SHARE) -> DataFrame:
    """Adds is_init: the first max(1, round(n * share)) items of each user."""
    own = W.partitionBy(user)
    n, place = F.count("*").over(own), F.row_number().over(own.orderBy(*order))
    return items.withColumn("is_init", place <= F.greatest(F.lit(1), F.round(n * share)))


def sessionize(items: DataFrame, user: str = "user_id", pos: str = "pos", pct: str = "watched_pct", date: str = "date") -> DataFrame:
    """Adds session_num (1..n by user).

    An item that is complete while its predecessor did not close a session closes one, with every session holding two
    items at least; what is left over joins the last session, and sessions whose last items share a date are one.
    Closing alternates within a run of complete items, which makes it a matter of the run's parity.
    """
    own = W.partitionBy(user)
    by_pos = own.orderBy(pos)
    rows = items.withColumn("_c", completed(F.col(pct)))
    rows = rows.withColumn("_r", F.row_number().over(by_pos) - F.row_number().over(W.partitionBy(user, "_c").orderBy(pos)))
    run = W.partitionBy(user, "_c", "_r")
    rows = rows.withColumn("_k", F.row_number().over(run.orderBy(pos))).withColumn("_first", F.min(pos).over(run) == F.min(pos).over(own))
    closes = F.col("_c") & (F.col("_k") % 2 == F.when(F.col("_first"), 0).otherwise(1))
    rows = rows.withColumn("_close", closes.cast("int"))
    before = F.coalesce(F.sum("_close").over(by_pos.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_s", F.least(1 + before, F.greatest(F.lit(1), F.sum("_close").over(own))))
    rows = rows.withColumn("_last", F.max_by(date, pos).over(W.partitionBy(user, "_s")))
    rows = rows.withColumn("_start", F.row_number().over(W.partitionBy(user, "_s").orderBy(pos)) == 1)
    previous = F.lag("_last").over(by_pos)
    rows = rows.withColumn("_new", (F.col("_start") & (F.row_number().over(by_pos) == 1) | F.col("_start") & ~F.col("_last").eqNullSafe(previous)).cast("int"))
    return rows.withColumn("session_num", F.sum("_new").over(by_pos).cast("int")).drop("_c", "_r", "_k", "_first", "_close", "_s", "_last", "_start", "_new")


def summarize_sessions(items: DataFrame, user: str = "user_id", pos: str = "pos") -> DataFrame:
    """A row per session; its date and weekday are the last item's."""
    return items.groupBy(user, "session_num").agg(
        F.max_by("date", pos).alias("date"), F.max_by("weekday", pos).alias("weekday"), F.count("*").alias("n_items"),
        F.count_if(completed(F.col("watched_pct"))).alias("n_completed"), F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"),
    )


def mark_items(items: DataFrame, order: Column, user: str = "user_id", pos: str = "pos", sources: int = SOURCES) -> DataFrame:
    """Adds target (the session's last item) and in_session (the target and up to `sources` others, first by order)."""
    own = W.partitionBy(user, "session_num")
    rows = items.withColumn("target", F.col(pos) == F.max(pos).over(own))
    rank = F.row_number().over(W.partitionBy(user, "session_num", "target").orderBy(order, pos))
    return rows.withColumn("in_session", F.col("target") | (rank <= sources))


def nest_by_date(items: DataFrame, value: str, user: str = "user_id", pos: str = "pos") -> DataFrame:
    """A row per user and date with its items' values in order."""
    rows = items.groupBy(user, "date").agg(F.array_sort(F.collect_list(F.struct(pos, value))).alias("x"), F.first("weekday").alias("weekday"))
    return rows.select(user, "date", "weekday", F.col(f"x.{value}").alias("records"))


def eligible_sessions(rows: DataFrame, needed: DataFrame, user: str = "user_id") -> DataFrame:
    """Rows up to the session before the user's last needed one; users without needed sessions drop out."""
    last = needed.filter(F.size("sessions") > 0).select(user, (F.array_max("sessions") - 1).alias("_last"))
    return rows.join(last, user).filter(F.col("session_num") <= F.col("_last")).drop("_last")
