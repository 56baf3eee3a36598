"""Vector measures: diversity of embeddings, judge scores, and the training losses' arithmetic.

Pairwise means have closed forms over unit vectors, so that no pair is ever formed; nearest neighbours are found in
`neighbours`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.numbers import let
from weftline.operators.neighbours import nearest


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    return let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a))  # the norm once, not once an element


def mean_pairwise_distance(vectors: DataFrame, vector: str, digits: int = 6) -> DataFrame:
    """Mean cosine distance over pairs i < j: 1 - (|sum of units|^2 - sum of squares) / (n (n - 1)); a sum per dimension."""
    rows = vectors.filter(F.col(vector).isNotNull()).select(unit(F.col(vector).cast("array<double>")).alias("u"))
    dims = rows.select(F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    total = dims.agg(F.sum(F.col("s") * F.col("s")).alias("a"), F.sum("q").alias("b"), F.max("n").alias("n"))
    n = F.col("n")
    return total.select(n.alias("n"), F.round(1 - (F.col("a") - F.col("b")) / (n * (n - 1)), digits).alias("avg_distance"))


def knn_distance(vectors: DataFrame, k: int, key: str, vector: str, digits: int = 6) -> DataFrame:
    """Mean distance to the k nearest others; no more than k vectors are an error."""
    found = nearest(vectors, k, key, vector)
    n = vectors.filter(F.col(vector).isNotNull()).agg(F.count("*").alias("_n"))
    mean = found.agg(F.count("*").alias("n"), F.round(F.avg("distance"), digits).alias("avg_distance")).crossJoin(n)  # one row each
    fail = F.when(F.col("_n") <= k, F.raise_error(F.concat(F.lit("too few vectors: "), F.col("_n").cast("string"))).cast("boolean")).otherwise(True)
    return mean.filter(fail).drop("_n")


def cluster_entropy(sizes: DataFrame, n: str, clusters: int, digits: int = 6) -> DataFrame:
    """-sum p ln p / ln K over the sizes of clusters; empty ones drop out. Fewer members than clusters are an error."""
    kept = sizes.filter(F.col(n) > 0)
    sums = kept.agg(F.coalesce(F.sum(n), F.lit(0)).alias("t"), F.sum(F.col(n) * F.log(F.col(n).cast("double"))).alias("x"))
    sums = sums.filter(F.when(F.col("t") < clusters, F.raise_error(F.concat(F.lit("too few members: "), F.col("t").cast("string"))).cast("boolean")).otherwise(True))
    return sums.select(F.round((F.log(F.col("t").cast("double")) - F.col("x") / F.col("t")) / F.log(F.lit(float(clusters))), digits).alias("entropy"))


def score_report(scores: DataFrame, digits: int = 6) -> DataFrame:
    """(dataset_type, metric, score) to means by metric and by dataset and metric; scores of 0 are errors."""
    return (
        scores.filter("score > 0").groupingSets([["metric"], ["dataset_type", "metric"]], "metric", "dataset_type")
        .agg(F.count("*").alias("n"), F.round(F.avg("score"), digits).alias("mean_score"))
    )


def masked_mean(tokens: Column, mask: Column, dims: int) -> Column:
    """Mean of token vectors whose mask is 1."""
    kept = F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x.m == 1)

    def total(i: int) -> Column:
        return F.aggregate(kept, F.lit(0.0), lambda s, x: s + x.t[i])

    return F.array(*[total(i) / F.greatest(F.size(kept), F.lit(1)) for i in range(dims)])


def infonce(pairs: DataFrame, batch: str, row: str, query: str, item: str, temperature: float = 0.05, digits: int = 6) -> DataFrame:
    """In-batch contrastive loss; a batch's rows meet only each other, and batches are small by construction."""
    q = pairs.select(batch, F.col(row).alias("qi"), unit(F.col(query)).alias("q"))
    i = pairs.select(batch, F.col(row).alias("ii"), unit(F.col(item)).alias("i"))
    logits = q.join(i, batch).select(batch, "qi", "ii", (dot(F.col("q"), F.col("i")) / temperature).alias("z"))
    rows = logits.groupBy(batch, "qi").agg(F.max("z").alias("m"), F.collect_list("z").alias("zs"), F.max(F.when(F.col("qi") == F.col("ii"), F.col("z"))).alias("own"))
    log_sum = F.col("m") + F.log(F.aggregate(F.transform("zs", lambda z: F.exp(z - F.col("m"))), F.lit(0.0), lambda s, v: s + v))
    return rows.groupBy(batch).agg(F.round(F.avg(log_sum - F.col("own")), digits).alias("loss"))


def cross_entropy(logits: Column, gold: Column) -> Column:
    """log of the sum of exponentials less the gold letter's logit."""
    top = F.array_max(logits)
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda s, v: s + F.exp(v - top))) - F.element_at(logits, gold)


def softplus_rank_loss(logits: Column, gold: Column) -> Column:
    """Mean of softplus(l_i - l_gold) over the other letters."""
    own = F.element_at(logits, gold)
    parts = F.transform(logits, lambda v, i: F.when(i + 1 != gold, F.log1p(F.exp(v - own))).otherwise(0.0))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / (F.size(logits) - 1)


def combined_loss(ce: Column, rank: Column, weight: float = 10.0) -> Column:
    return ce + weight * rank


def padded_length(lengths: DataFrame, column: str, cap: int, multiple: int = 8) -> DataFrame:
    """The longest length, cut to cap and rounded up to a multiple."""
    found = F.least(F.max(column), F.lit(cap))
    return lengths.agg((F.ceil(found / multiple) * multiple).cast("long").alias("padded"))


def label_mask(ids: Column, from_place: Column, ignore: int = -100) -> Column:
    """Ids before the answer are ignored."""
    return F.transform(ids, lambda x, i: F.when(i < from_place, F.lit(ignore).cast("long")).otherwise(x.cast("long")))


def tokens_of(rows: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, place, token, start, end): the pattern's matches, which must make up the whole text, with their offsets."""
    each = rows.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("place", "token"))
    to = F.sum(F.length("token")).over(Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("end", to).withColumn("start", F.col("end") - F.length("token"))


def mask_spans(tokens: DataFrame, spans: DataFrame, key: str, token: str = "id", ignore: int | str = -100) -> DataFrame:
    """tokens (key, place, start, end, ..) with label: the token where it overlaps one of its key's spans (start, end), else
    ignore. A sweep along each text: a token meets a span if, of those that start before its end, one ends behind its
    start."""
    at = tokens.select("*", (F.col("end") - 1).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_to"))
    marks = spans.select(key, F.col("start").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.col("end").cast("long").alias("_to")).filter("_to > _at")
    reach = F.max("_to").over(Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    swept = at.unionByName(marks, allowMissingColumns=True).withColumn("_reach", reach).filter("_kind = 1")
    inside = (F.col("_reach") > F.col("start")) & (F.col("end") > F.col("start"))
    return swept.withColumn("label", F.when(inside, F.col(token)).otherwise(F.lit(ignore))).drop("_at", "_kind", "_to", "_reach")


def fit_right(ids: Column, n: int, pad: int) -> Column:
    """The first n ids, filled up to n."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad).cast("long"), n)), 1, n)


def truncate_left(ids: Column, n: int, place: Column) -> tuple[Column, Column]:
    """The last n ids and the place shifted with them; a place that is cut off is -1."""
    gone = F.greatest(F.size(ids) - n, F.lit(0))
    return F.slice(ids, gone + 1, F.lit(n)), F.when(place >= gone, place - gone).otherwise(-1)


def _find(ids: Column, part: Column) -> Column:
    """First place of part in ids, null where there is none or part is empty: an automaton with a state for each matched
    length, of which each state's row is that of its longest proper border with one more step, and one fold over ids."""
    kind = "array<map<bigint, int>>"
    ids, part = ids.cast("array<bigint>"), part.cast("array<bigint>")
    start = F.struct(F.array().cast(kind).alias("rows"), F.lit(0).alias("border"))

    def state(a: Column, p: Column) -> Column:
        n = F.size(a.rows)
        back = F.when(n > 0, F.try_element_at(a.rows, a.border + 1)).otherwise(F.create_map().cast("map<bigint, int>"))
        row = F.map_concat(F.map_filter(back, lambda k, v: k != p), F.create_map(p, n + 1))
        return F.struct(F.concat(a.rows, F.array(row)).cast(kind).alias("rows"), F.when(n > 0, F.coalesce(F.try_element_at(back, p), F.lit(0))).otherwise(F.lit(0)).alias("border"))

    def step(a: Column, x: Column, rows: Column) -> Column:
        to = F.coalesce(F.try_element_at(F.try_element_at(rows, a.state + 1), x), F.lit(0))
        done = a["at"].isNotNull()
        return F.struct(
            F.when(done, a.state).otherwise(to).alias("state"), (a.i + 1).alias("i"), F.when(done, a["at"]).when(to == F.size(rows), a.i + 1 - to).alias("at")
        )

    def search(rows: Column) -> Column:
        begin = F.struct(F.lit(0).alias("state"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("at"))
        return F.aggregate(ids, begin, lambda a, x: step(a, x, rows), lambda a: a["at"])

    return F.when(F.size(part) > 0, let(F.aggregate(part, start, state, lambda a: a.rows), search))


def find_sequence(ids: Column, part: Column) -> Column:
    """First place (from 0) of part in ids; else of part without its first id, one earlier (tokenizers may split a lead
    differently); -1 where neither is."""
    rest = F.when(F.size(part) >= 2, _find(ids, F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(1)))))
    long_enough = F.size(ids) >= F.size(part)
    near = F.when(rest.isNotNull(), F.greatest(rest - 1, F.lit(0)))
    return F.coalesce(F.when(long_enough, F.coalesce(_find(ids, part), near)), F.lit(-1))


def rank_target(labels: Column, place: Column, candidates: Column) -> Column:
    """(place, id) of the answer's letter among labels: the given place if it is past the first and holds a candidate id,
    else the last candidate's; null where there is none past the first place."""
    given = F.when((place > 0) & (place < F.size(labels)), F.try_element_at(labels, (place + 1).cast("int")))
    all_ = F.filter(F.transform(labels, lambda v, i: F.when(F.array_contains(candidates, v), i).otherwise(-1)), lambda i: i >= 0)
    at = F.when(F.coalesce(F.array_contains(candidates, given), F.lit(False)), place.cast("int")).otherwise(F.try_element_at(all_, F.lit(-1)))
    return F.when(at > 0, F.struct(at.alias("place"), F.element_at(labels, at + 1).alias("id")))
