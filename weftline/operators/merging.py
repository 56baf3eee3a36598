"""Ordered-source de-duplication, audits, resume and strict joins. Keyed picks are aggregates, not window sorts, so that
they combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.places import numbered


def _pick(rows: DataFrame, keys: list[str], by: list[Column], largest: bool) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    pick = (F.max_by if largest else F.min_by)(F.struct(*rest), F.struct(*by))
    return rows.groupBy(*keys).agg(pick.alias("_x")).select(*[F.col(k) if k in keys else F.col(f"_x.{k}").alias(k) for k in rows.columns])


def last_wins(rows: DataFrame, keys: list[str], rank: str, seq: str) -> DataFrame:
    """Of each key the row of the latest source, and there the latest line."""
    return _pick(rows, keys, [F.col(rank), F.col(seq)], True)


def first_wins(rows: DataFrame, keys: list[str], rank: str, seq: str) -> DataFrame:
    """Of each key the earliest row; rows with an empty or null key drop out."""
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    return _pick(rows, keys, [F.col(rank), F.col(seq)], False)


def rank_aware(rows: DataFrame, keys: list[str], rank: str, seq: str, read: str | None = None) -> DataFrame:
    """Lines are read in the order of `read` (by source and line, unless given). A line replaces its key's earlier one if
    its source ranks no lower than that one's, else it is skipped: the highest rank's latest line stays. Adds `replaced`
    and `skipped`, how often each befell the key."""
    order = [F.col(read)] if read else [F.col(rank), F.col(seq)]
    before = F.max(rank).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("_kept", before.isNull() | (F.col(rank) >= before)).withColumn("_order", F.struct(*order))
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.when(F.col("_kept"), F.struct(*rest)), F.when(F.col("_kept"), F.col("_order")))
    out = marked.groupBy(*keys).agg(best.alias("_x"), (F.count_if("_kept") - 1).alias("replaced"), F.count_if(~F.col("_kept")).alias("skipped"))
    return out.select(*[F.col(k) if k in keys else F.col(f"_x.{k}").alias(k) for k in rows.columns], "replaced", "skipped")


def merge_counters(rows: DataFrame) -> DataFrame:
    """rank_aware's audit: keys added, lines that replaced one, lines skipped."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(F.count("*").alias("added"), total("replaced").alias("replaced"), total("skipped").alias("skipped"))


def latest_state(rows: DataFrame, user: str, step: str, seq: str) -> DataFrame:
    """Of each user the row of the largest step; of ties the first."""
    return _pick(rows, [user], [F.col(step), -F.col(seq)], True)


def replace_or_append(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """base with rows of patch in place of equal keys and patch's other rows added; status says which is which. A key that
    base or patch holds twice is an error."""
    base, patch = require_unique(base, key), require_unique(patch, key)
    cols = [c for c in base.columns if c != key]
    b, p = base.withColumn("_b", F.lit(True)).alias("b"), patch.withColumn("_p", F.lit(True)).alias("p")
    met = b.join(p, F.col(f"b.{key}").eqNullSafe(F.col(f"p.{key}")), "full_outer")
    status = F.when(F.col("_p") & F.col("_b"), "replaced").when(F.col("_p"), "appended").otherwise("kept")
    picked = [F.when(F.col("_p"), F.col(f"p.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in cols]
    return met.select(F.coalesce(f"p.{key}", f"b.{key}").alias(key), *picked, status.alias("status"))


def uniqueness(rows: DataFrame, *keys: str) -> DataFrame:
    """rows, distinct keys and whether they agree."""
    total = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"))
    return total.select("*", (F.col("n_rows") == F.col("n_keys")).alias("is_unique"))


def replace_counters(merged: DataFrame) -> DataFrame:
    """replace_or_append's audit."""
    status = F.col("status")
    return merged.agg(F.count_if(status != "kept").alias("applied"), F.count_if(status == "replaced").alias("replaced"), F.count_if(status == "appended").alias("appended"))


def require_unique(rows: DataFrame, *keys: str) -> DataFrame:
    """rows, with an error at run time if a key occurs twice, null keys among them."""
    own = W.partitionBy(*keys)
    name = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    fail = F.when(F.count("*").over(own) > 1, F.raise_error(F.concat(F.lit("duplicate key: "), name)).cast("boolean")).otherwise(True)
    return rows.withColumn("_one", fail).filter("_one").drop("_one")


def pending_latest_round(failures: DataFrame, round_no: str) -> DataFrame:
    """Failures of the latest retry round; where no round has a number, of all shards."""
    last = failures.agg(F.max(round_no).alias("_last"))
    met = failures.crossJoin(F.broadcast(last))  # one row
    return met.filter(F.col("_last").isNull() | (F.col(round_no) == F.col("_last"))).agg(F.count("*").alias("pending"), F.max("_last").alias("latest_round"))


def strict_join(rows: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """Inner join in which a row without a partner is an error at run time."""
    met = rows.join(other.withColumn("_met", F.lit(True)), on, "left")
    fail = F.when(F.col("_met").isNull(), F.raise_error(F.concat(F.lit("missing key: "), F.col(on).cast("string"))).cast("boolean")).otherwise(True)
    return met.filter(fail).drop("_met")


def by_id_list(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """The rows of listed ids with the list's other columns (its place and split); an id without a row is an error. The
    place restores the list's order where it is written."""
    return strict_join(ids, rows, on)


def previous_session(rows: DataFrame, state: DataFrame, user: str, step: str, how: str = "inner") -> DataFrame:
    """Rows of session n with the state of session n - 1."""
    return rows.join(state.withColumn(step, F.col(step) + 1), [user, step], how)


def with_fallback(rows: DataFrame, updated: DataFrame, extracted: DataFrame, user: str, step: str, value: str, mode: str = "fallback") -> DataFrame:
    """The previous session's updated value, else (mode fallback) its extracted one; else the row drops (skip) or is an
    error (error)."""
    u = updated.select(user, (F.col(step) + 1).alias(step), F.col(value).alias("_u"))
    e = extracted.select(user, (F.col(step) + 1).alias(step), F.col(value).alias("_e"))
    met = rows.join(u, [user, step], "left").join(e, [user, step], "left")
    got = F.coalesce("_u", "_e") if mode == "fallback" else F.col("_u")
    source = F.when(F.col("_u").isNotNull(), "updated").when(F.lit(mode == "fallback") & F.col("_e").isNotNull(), "extracted")
    met = met.withColumn(value, got).withColumn("source", source).drop("_u", "_e")
    if mode == "error":
        return met.withColumn(value, F.when(F.col(value).isNull(), F.raise_error(F.lit("no previous state"))).otherwise(F.col(value)))
    return met.filter(F.col(value).isNotNull())


def resume(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def assigned(rows: DataFrame, shard_of: DataFrame, user: str) -> DataFrame:
    """rows with their user's shard; a user without one is an error."""
    return strict_join(rows, shard_of.select(user, "shard"), user)


def rebuilt_shards(rows: DataFrame, needed: DataFrame, n: int, user: str = "user_id") -> DataFrame:
    """rows under the shards that n of them give: users whose last needed session is over 1, in order, dealt in turn."""
    eligible = needed.filter(F.array_max("sessions") > 1)
    return assigned(rows, shards(eligible.select(user), user, n), user)


def first_match(rows: DataFrame, candidates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Inner join with the first candidate of each key."""
    return rows.join(_pick(candidates, keys, [F.col(o) for o in order], False), keys)


def ordered_lookup(lists: DataFrame, items: DataFrame, key: str, ids: str, item_id: str, value: str) -> DataFrame:
    """Each list of ids to its items' values in order, unknown ids dropped."""
    each = lists.select(key, F.posexplode(ids).alias("_pos", item_id))
    met = each.join(items.select(item_id, value), item_id)
    return met.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", value))).alias("_x")).select(key, F.col(f"_x.{value}").alias("found"))


def shards(users: DataFrame, user: str, n: int) -> DataFrame:
    """Explicit shard numbers by the users' order, modulo n: a global order for exports, else repartition is enough."""
    order = numbered(users.select(user).distinct(), user)
    return order.select(user, F.pmod("place", F.lit(n)).cast("int").alias("shard"))
