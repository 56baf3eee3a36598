"""The driver's tables in the roles of histories, dialogues, catalogues and candidate lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def watch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as items of users' histories, in order of time."""
    e = load(spark, sf_dir, "events")
    pos = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(
        "user_id", "event_id", pos.alias("pos"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.date_format("ts", "EEEE").alias("weekday"),
        F.col("value").alias("watched_pct"), F.col("event_type").alias("content_type"),
    )


WATCH = """wl AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
 strftime(ts, '%Y-%m-%d') AS date, dayname(ts) AS weekday, value AS watched_pct, event_type AS content_type FROM events)"""

#: The closed form of the sessioniser over wl.
SESSION = (
    WATCH
    + """, a AS (SELECT *, coalesce(watched_pct, 0) >= 80 AS c FROM wl),
 b AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, c ORDER BY pos) AS isl FROM a),
 d AS (SELECT *, row_number() OVER (PARTITION BY user_id, c, isl ORDER BY pos) AS rp, min(pos) OVER (PARTITION BY user_id, c, isl) AS st FROM b),
 e AS (SELECT *, CASE WHEN c AND (CASE WHEN st = 1 THEN rp % 2 = 0 ELSE rp % 2 = 1 END) THEN 1 ELSE 0 END AS cl FROM d),
 f AS (SELECT *, least(1 + coalesce(sum(cl) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0),
   greatest(1, sum(cl) OVER (PARTITION BY user_id))) AS s1 FROM e),
 g AS (SELECT user_id, s1, max(date) AS last_date FROM f GROUP BY 1, 2),
 h AS (SELECT *, CASE WHEN last_date IS DISTINCT FROM lag(last_date) OVER (PARTITION BY user_id ORDER BY s1) THEN 1 ELSE 0 END AS ch FROM g),
 i AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY user_id ORDER BY s1) AS INTEGER) AS session_num FROM h),
 s AS (SELECT f.user_id, f.event_id, f.pos, f.date, f.weekday, f.watched_pct, f.content_type, i.session_num FROM f JOIN i USING (user_id, s1)),
 sess AS (SELECT user_id, session_num, arg_max(date, pos) AS date, arg_max(weekday, pos) AS weekday, count(*) AS n_items,
   count(*) FILTER (coalesce(watched_pct, 0) >= 80) AS n_completed, min(pos) AS first_pos, max(pos) AS last_pos FROM s GROUP BY 1, 2)"""
)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' parts with an integer score (total quantity) as scored candidates."""
    li = load(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").cast("long").alias("score"))


CANDIDATES = """cand AS (SELECT l_suppkey AS query, l_partkey AS item, CAST(sum(l_quantity) AS BIGINT) AS score FROM lineitem GROUP BY 1, 2),
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS r FROM cand) WHERE r <= 50)"""


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as states along a customer's time."""
    o = load(spark, sf_dir, "orders")
    pos = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.select(F.col("o_custkey").alias("user_id"), pos.alias("step"), "o_orderkey", F.col("o_orderpriority").alias("memory"), F.col("o_orderstatus").alias("status"))


ORDERS = """ol AS (SELECT o_custkey AS user_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step, o_orderkey,
 o_orderpriority AS memory, o_orderstatus AS status FROM orders)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem rows as lines of ordered sources: the key may stand in the base file and in retries."""
    li = load(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("key"), (F.col("l_linenumber") % 3).alias("source_rank"), ((F.col("l_partkey") * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_suppkey")).alias("seq"), F.col("l_suppkey").alias("payload"))


ATTEMPTS = "att AS (SELECT l_orderkey AS key, l_linenumber % 3 AS source_rank, (l_partkey * 10 + l_linenumber) * 100000 + l_suppkey AS seq, l_suppkey AS payload FROM lineitem)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as dialogues of turns; every seventh length stands for a tagged target."""
    c = load(spark, sf_dir, "conversations")
    turn = F.struct("turn", F.col("role").alias("speaker"), "text", (F.length("text") % 7 == 0).alias("is_target"))
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
