"""Statistics and state along a user's sessions: running moments, trailing frames, lead, lag, cumulative lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import numbers as N


def along(user: str, *order: str) -> W:
    return W.partitionBy(user).orderBy(*order)


def initial_stats(items: DataFrame, user: str, pct: str) -> DataFrame:
    """Mean and population variance to two digits (rounded as Python does), and count; a user with a null share is left
    out. Sums are exact, so that partial ones combine in any order."""
    u = N.units(F.col(pct))
    sums = items.groupBy(user).agg(F.sum(u).alias("_s1"), F.sum(u * u).cast("decimal(38,0)").alias("_s2"), F.count("*").alias("total_count"), F.count(pct).alias("_n"))
    s1, s2, n = F.col("_s1"), F.col("_s2"), F.col("total_count")
    stats = [N.round2(N.mean_of(s1, n)).alias("watched_pct_avg"), N.round2(N.variance_of(s1, s2, n)).alias("watched_pct_var")]
    return sums.filter("_n = total_count").select(user, *stats, "total_count")


def moments(items: DataFrame, user: str, pct: str) -> DataFrame:
    """Exact integer moments in hundredths, from which mean and variance follow without rounding."""
    c = F.round(F.coalesce(F.col(pct), F.lit(0.0)) * 100).cast("long")
    return items.groupBy(user).agg(F.count("*").alias("n"), F.sum(c).alias("s1"), F.sum(c * c).alias("s2"))


def weekday_counts(items: DataFrame, user: str, weekday: str = "weekday") -> DataFrame:
    """Long form of the weekday histogram; empty weekdays do not count."""
    return items.filter(F.coalesce(F.col(weekday), F.lit("")) != "").groupBy(user, weekday).agg(F.count("*").alias("n"))


def weekday_map(items: DataFrame, user: str, weekday: str = "weekday") -> DataFrame:
    own = weekday_counts(items, user, weekday).groupBy(user)
    return own.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(weekday, "n")))).alias("weekday_freq"))


def running_moments(items: DataFrame, user: str, order: tuple[str, ...], pct: str) -> DataFrame:
    c = F.round(F.coalesce(F.col(pct), F.lit(0.0)) * 100).cast("long")
    w = along(user, *order).rowsBetween(W.unboundedPreceding, 0)
    return items.select("*", F.count("*").over(w).alias("run_n"), F.sum(c).over(w).alias("run_s1"), F.sum(c * c).over(w).alias("run_s2"))


def fold_stats(sessions: DataFrame, user: str, step: str, pcts: str) -> DataFrame:
    """Statistics merged session by session, rounded to two digits (as Python does) at each step and carried on rounded.

    sessions: (user, step, pcts array<double>); null shares count as zero, an empty session changes nothing. What is
    gathered of a session is three numbers, in order of its user's steps; the fold over them runs in the JVM.
    """
    share = F.transform(F.coalesce(F.col(pcts), F.array().cast("array<double>")), lambda v: N.units(F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v)))
    zero = F.lit(0).cast("decimal(38,0)")
    s1 = F.aggregate("_u", zero, lambda s, v: (s + v).cast("decimal(38,0)"))
    s2 = F.aggregate("_u", zero, lambda s, v: (s + v * v).cast("decimal(38,0)"))
    m = F.size("_u").cast("long")
    own = sessions.select(user, F.col(step).cast("int").alias("step"), share.alias("_u"))
    own = own.select(user, F.struct("step", m.alias("m"), N.mean_of(s1, m).alias("mu"), N.variance_of(s1, s2, m).alias("own")).alias("_s"))
    steps = own.groupBy(user).agg(F.array_sort(F.collect_list("_s")).alias("_steps"))
    kind = "array<struct<step: int, avg: double, var: double, n: bigint>>"
    start = F.struct(F.lit(0.0).alias("avg"), F.lit(0.0).alias("var"), F.lit(0).cast("long").alias("n"), F.array().cast(kind).alias("out"))

    def merged(a: Column, s: Column) -> Column:
        total = a.n + s.m
        return N.let((a.n * a.avg + s.m * s.mu) / total, lambda mean: F.struct(
            N.round2(mean).alias("avg"),
            N.round2((a.n * (a["var"] + (a.avg - mean) * (a.avg - mean)) + s.m * (s.own + (s.mu - mean) * (s.mu - mean))) / total).alias("var"),
            total.alias("n"),
        ))

    def next_(a: Column, s: Column) -> Column:
        now = F.when(s.m > 0, merged(a, s)).otherwise(F.struct(a.avg.alias("avg"), a["var"].alias("var"), a.n.alias("n")))
        return N.let(now, lambda x: F.struct(x.avg.alias("avg"), x["var"].alias("var"), x.n.alias("n"), F.concat(a.out, F.array(F.struct(s.step.alias("step"), x.avg.alias("avg"), x["var"].alias("var"), x.n.alias("n")))).alias("out")))

    folded = F.aggregate("_steps", start, next_, lambda a: a.out)
    return steps.select(user, F.inline(folded))


def trailing(rows: DataFrame, user: str, order: str, k: int, *aggs: Column) -> DataFrame:
    """Aggregates over the last k rows, the current one included. An agg is given a frame by `framed`."""
    w = along(user, order).rowsBetween(-(k - 1), 0)
    return rows.select("*", *[a.over(w) for a in aggs])


def usage_log(sessions: DataFrame, user: str, step: str, k: int) -> DataFrame:
    """date -> session of the last k sessions; of sessions with one date the last is kept."""
    w = along(user, step).rowsBetween(-(k - 1), 0)
    seen = F.collect_list(F.struct("date", F.col(step).alias("step"))).over(w)
    rows = sessions.select(user, step, F.array_sort(seen).alias("x"))
    last = F.filter("x", lambda e, i: ~F.exists("x", lambda o: (o.date == e.date) & (o.step > e.step)))
    return rows.select(user, step, last.alias("x"))


def lead_target(rows: DataFrame, user: str, order: tuple[str, ...], value: str) -> DataFrame:
    """Adds next_<value>; a user's last row, which has no next, drops out."""
    w = along(user, *order)
    return rows.select("*", F.lead(value).over(w).alias(f"next_{value}"), F.lead(F.lit(1)).over(w).alias("_has")).filter("_has = 1").drop("_has")


def lag_state(rows: DataFrame, user: str, order: tuple[str, ...], value: str, seed: Column) -> DataFrame:
    return rows.withColumn(f"before_{value}", F.coalesce(F.lag(value).over(along(user, *order)), seed))


def cumulative_lists(rows: DataFrame, user: str, order: tuple[str, ...], items: str) -> DataFrame:
    """before: all previous rows' items; after: before and the row's own."""
    w = along(user, *order).rowsBetween(W.unboundedPreceding, -1)
    before = F.flatten(F.collect_list(items).over(w))
    return rows.withColumn("before", before).withColumn("after", F.concat("before", items))


def prefix_delta(rows: DataFrame, user: str, order: tuple[str, ...], after: str) -> DataFrame:
    """What a cumulative list gained over the previous row's, by length."""
    before = F.coalesce(F.size(F.lag(after).over(along(user, *order))), F.lit(0))
    n = F.when(before < 0, 0).otherwise(before)
    return rows.withColumn("gained", F.slice(after, n + 1, F.greatest(F.size(after), F.lit(1))))


def until_first_gap(rows: DataFrame, user: str, order: str, missing: Column) -> DataFrame:
    """Rows before the user's first missing one."""
    gap = F.min(F.when(missing, F.col(order))).over(W.partitionBy(user))
    return rows.withColumn("_gap", gap).filter(F.col("_gap").isNull() | (F.col(order) < F.col("_gap"))).drop("_gap")


def compile_history(initial: DataFrame, log: DataFrame, user: str, step: str, seq: str, state: str) -> DataFrame:
    """Step 0 from initial, later steps from the log (of repeated steps the last), and each user's final state."""
    log = log.groupBy(user, step).agg(F.max_by(state, seq).alias(state))
    steps = initial.select(user, F.lit(0).cast("int").alias(step), state).unionByName(log.select(user, F.col(step).cast("int").alias(step), state))
    final = steps.groupBy(user).agg(F.max_by(state, step).alias(state))
    return steps.select(user, F.col(step).cast("string").alias(step), state).unionByName(final.select(user, F.lit("final").alias(step), state))


def profile(user: DataFrame) -> DataFrame:
    """Demographic columns as the static part of a dialogue persona with an empty dynamic list."""
    style = F.coalesce("comm_style", F.lit("{}")) if isinstance(user.schema["comm_style"].dataType, T.StringType) else F.col("comm_style")
    fixed = F.struct("user_age", "user_gender", "user_occupation", "has_kids", "relationship_status", style.alias("comm_style"))
    kids = F.when(F.coalesce("has_kids", F.lit(False)), 1).otherwise(0)
    return user.select("user_id", F.struct(fixed.alias("static"), F.array().cast("array<string>").alias("dynamic")).alias("persona"), kids.alias("num_kids"))
