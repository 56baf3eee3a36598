"""Candidate windows, back-to-front sliding-window re-ranking, and rank metrics, all as array expressions or
map-combined aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LIST = 50
WINDOW = 20
STRIDE = 10
KS = (1, 5, 10, 20)


def top_candidates(scores: DataFrame, query: str, item: str, score: str, k: int = LIST) -> DataFrame:
    """Each query's k items of highest score (ties: lowest item), in order, with their scores."""
    place = F.row_number().over(W.partitionBy(query).orderBy(F.desc(score), item))  # Spark cuts each task's rows at k before the shuffle
    top = scores.select(query, F.col(item).alias("item"), F.col(score).alias("score"), place.alias("r")).filter(F.col("r") <= k)
    best = top.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("r", "item", "score"))).alias("x"))
    return best.select(query, F.col("x.item").alias("items"), F.col("x.score").alias("scores"))


def candidate_windows(lists: DataFrame, items: str, target: str) -> DataFrame:
    """Four overlapping windows of a 50-list that holds the target; one without it has it in its last place."""
    held = lists.filter(F.array_contains(items, F.col(target)))
    each = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("w"))
    own = F.slice(items, F.col("w") * STRIDE + 1, F.lit(WINDOW))
    return each.withColumn("window", F.when(F.array_contains(own, F.col(target)), own).otherwise(F.concat(F.slice(own, 1, WINDOW - 1), F.array(target))))


def rerank(items: Column, num_steps: int = 4, order: Callable[[Column], Column] | None = None) -> Column:
    """Re-ranks an array of structs (id, score) from back to front.

    Each step sorts a window of 20 (by falling score, stable); its first ten meet the ten before them, its last ten are
    final. The last step's 20 stand first. order sorts one window and may call a model instead.
    """
    steps = max(1, min(num_steps, 4))
    sort = order or stable_by_score
    start = (steps - 1) * STRIDE
    ranked, tail = sort(F.slice(items, start + 1, WINDOW)), F.slice(items, start + WINDOW + 1, LIST)
    for s in range(steps - 1, 0, -1):
        tail = F.concat(F.slice(ranked, STRIDE + 1, STRIDE), tail)
        ranked = sort(F.concat(F.slice(items, (s - 1) * STRIDE + 1, STRIDE), F.slice(ranked, 1, STRIDE)))
    return F.concat(ranked, tail)


def stable_by_score(window: Column) -> Column:
    keyed = F.transform(window, lambda e, i: F.struct((-e.score).alias("neg"), i.alias("slot"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda x: x.e)


def rank_of(items: Column, target: Column) -> Column:
    """1-based place, 51 where absent."""
    at = F.array_position(items, target)
    return F.when(at > 0, at).otherwise(LIST + 1).cast("int")


def metrics(rank: Column, ks: tuple[int, ...] = KS, deepest: int = LIST) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for k in ks:
        out[f"recall_{k}"] = F.when(rank <= k, 1.0).otherwise(0.0)
        out[f"ndcg_{k}"] = F.when(rank <= k, 1.0 / F.log2(rank + 1.0)).otherwise(0.0)
    out[f"mrr_{deepest}"] = F.when(rank <= deepest, 1.0 / rank).otherwise(0.0)
    return out


def mean_metrics(ranks: DataFrame, rank: str, *by: str, digits: int = 6) -> DataFrame:
    """Means over all required samples; missing and absent ones stand at rank 51 and count in the denominator. No samples
    have means of 0."""
    means = [F.coalesce(F.round(F.avg(c), digits), F.lit(0.0)).alias(n) for n, c in metrics(F.col(rank)).items()]
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), *means)


def required(ids: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Every required id with its rank and status; those without a result are FAIL_DATA_MISSING at rank 51."""
    met = ids.join(results, key, "left")
    return met.withColumn("status", F.coalesce("status", F.lit("FAIL_DATA_MISSING"))).withColumn("rank", F.coalesce("rank", F.lit(LIST + 1)))


def ranked(wanted: DataFrame, lists: DataFrame, key: str, target: str, failed: str | None = None) -> DataFrame:
    """Every wanted id with its target's rank and a status: SUCCESS, IGNORED_TARGET_ABSENCE (rank 51), FAIL_LOGIC_ERROR
    where the column `failed` says so, FAIL_DATA_MISSING without a list."""
    met = wanted.join(lists, key, "left")
    bad = F.coalesce(F.col(failed), F.lit(False)) if failed else F.lit(False)
    there = F.array_contains("items", F.col(target))
    status = F.when(F.col("items").isNull(), "FAIL_DATA_MISSING").when(bad, "FAIL_LOGIC_ERROR").when(there, "SUCCESS").otherwise("IGNORED_TARGET_ABSENCE")
    rank = F.when(status == "SUCCESS", rank_of(F.col("items"), F.col(target))).otherwise(LIST + 1).cast("int")
    return met.withColumn("status", status).withColumn("rank", rank)


def status_counts(ranks: DataFrame) -> DataFrame:
    """(status, n, true_fail): the last says whether the status is a failure, which an absent target is not."""
    return ranks.groupBy("status").agg(F.count("*").alias("n")).withColumn("true_fail", F.col("status").startswith("FAIL"))


def rerank_with(lists: DataFrame, key: str, items: str, call, num_steps: int = 4) -> DataFrame:
    """`rerank` by a scorer outside: each step asks call for the scores of a window (prompt: key and items as JSON; answer:
    a JSON array of a score per item), sorts stably by falling score and passes its first ten on. One task per query
    throughout, as steps follow one another; queries are independent."""
    from weftline.operators.folds import call_model

    kind = lists.schema[items].dataType.elementType.simpleString()
    steps = max(1, min(num_steps, 4))
    start = (steps - 1) * STRIDE
    rows = lists.withColumn("_tail", F.slice(items, start + WINDOW + 1, LIST)).withColumn("_window", F.slice(items, start + 1, WINDOW))
    for s in range(steps - 1, -1, -1):
        rows = call_model(rows.withColumn("_prompt", F.to_json(F.struct(F.col(key).alias("key"), F.col("_window").alias("items")))), "_prompt", call)
        scores = F.from_json("response", "array<double>")
        pairs = F.zip_with("_window", scores, lambda i, v: F.struct(i.alias("item"), v.alias("score")))
        sorted_ = F.transform(stable_by_score(pairs), lambda e: e.item).cast(f"array<{kind}>")
        rows = rows.withColumn("_ranked", sorted_).drop("response", "_prompt")
        if s:
            rows = rows.withColumn("_tail", F.concat(F.slice("_ranked", STRIDE + 1, STRIDE), "_tail"))
            rows = rows.withColumn("_window", F.concat(F.slice(items, (s - 1) * STRIDE + 1, STRIDE), F.slice("_ranked", 1, STRIDE)))
    return rows.withColumn(items, F.concat("_ranked", "_tail")).drop("_ranked", "_tail", "_window")


def letter_answers(candidates: DataFrame, answers: DataFrame, key: str, on: list[str], pos: str) -> DataFrame:
    """The letter of each answer's candidate; of candidates that look alike the last letter; no candidate, no row."""
    letters = candidates.groupBy(key, *on).agg(F.max(pos).alias("_pos"))
    return answers.join(letters, [key, *on]).withColumn("letter", F.substring(F.lit("ABCDEFGHIJKLMNOPQRST"), (F.col("_pos") + 1).cast("int"), F.lit(1))).drop("_pos")


def shuffled(order_seed: int, *cols: str) -> Column:
    """A seeded order in place of an unseeded shuffle."""
    return F.xxhash64(F.lit(order_seed), *cols)
