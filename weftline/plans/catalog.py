"""The registered queries of the engine's own operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import json as J
from weftline.functions import text as X
from weftline.functions.numbers import UNITS, round2_sql, units_sql
from weftline.operators import clusters, folds, history, lists, merging, progress, ranking, sessions, vectors
from weftline.plans import adapters as A
from weftline.plans import builders
from weftline.plans.adapters import ATTEMPTS, CANDIDATES, ORDERS, SESSION, WATCH, load
from weftline.plans.registry import ORACLES, QUERIES, code, query

__all__ = ["ORACLES", "QUERIES"]

def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessionize(A.watch_log(spark, d))


# --- sessions and splits


@query(f"WITH {SESSION} SELECT user_id, session_num, date, weekday, n_items, n_completed, first_pos, last_pos FROM sess")
def sessionize_completion(spark, d):
    return sessions.summarize_sessions(_sessions(spark, d))


@query(f"""WITH {SESSION}, m AS (SELECT *, pos = max(pos) OVER (PARTITION BY user_id, session_num) AS target FROM s)
SELECT user_id, session_num, event_id, target, target OR row_number() OVER (PARTITION BY user_id, session_num, target ORDER BY (event_id * 7919) % 10007, pos) <= 3 AS in_session FROM m""")
def mark_target_and_sources(spark, d):
    out = sessions.mark_items(_sessions(spark, d), (F.col("event_id") * 7919) % 10007)
    return out.select("user_id", "session_num", "event_id", "target", "in_session")


@query(f"""WITH {SESSION}, m AS (SELECT *, pos = max(pos) OVER (PARTITION BY user_id, session_num) AS target FROM s),
k AS (SELECT *, target OR row_number() OVER (PARTITION BY user_id, session_num, target ORDER BY (event_id * 7919) % 10007, pos) <= 3 AS ins FROM m)
SELECT user_id, session_num, coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY pos) FILTER (ins AND NOT target), '') AS sources,
 min(event_id) FILTER (target) AS target_id FROM k GROUP BY 1, 2""")
def session_sources_and_target(spark, d):
    marked = sessions.mark_items(_sessions(spark, d), (F.col("event_id") * 7919) % 10007)
    watch = F.array_sort(F.collect_list(F.struct("pos", "event_id", "target", "in_session")))
    rows = marked.groupBy("user_id", "session_num").agg(watch.alias("watch"))
    ids = F.transform(lists.sources(F.col("watch")), lambda r: r.event_id.cast("string"))
    return rows.select("user_id", "session_num", F.array_join(ids, ",").alias("sources"), lists.last_target(F.col("watch")).event_id.alias("target_id"))


@query(f"WITH {WATCH} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY date, pos) <= greatest(1, round(count(*) OVER (PARTITION BY user_id) * 0.2)) AS is_init FROM wl")
def head_split_20pct(spark, d):
    return sessions.head_split(A.watch_log(spark, d), order=("date", "pos")).select("user_id", "event_id", "is_init")


@query(f"WITH {WATCH} SELECT user_id, date, any_value(weekday) AS weekday, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY pos) AS records FROM wl GROUP BY 1, 2")
def nest_items_by_date(spark, d):
    out = sessions.nest_by_date(A.watch_log(spark, d), "event_id")
    return out.withColumn("records", F.array_join(F.col("records").cast("array<string>"), ","))


@query(f"""WITH {SESSION}, need AS (SELECT c_custkey AS user_id, c_custkey % 6 AS last FROM customer WHERE c_custkey % 6 > 0)
SELECT sess.user_id, session_num, n_items FROM sess JOIN need USING (user_id) WHERE session_num <= last - 1""")
def eligible_sessions(spark, d):
    need = load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.expr("case when c_custkey % 6 > 0 then sequence(1, cast(c_custkey % 6 as int)) else cast(array() as array<int>) end").alias("sessions"))
    return sessions.eligible_sessions(sessions.summarize_sessions(_sessions(spark, d)), need).select("user_id", "session_num", "n_items")


# --- statistics and state


@query(f"WITH {WATCH}, c AS (SELECT user_id, CAST(round(coalesce(watched_pct, 0) * 100) AS BIGINT) AS c FROM wl) SELECT user_id, count(*) AS n, CAST(sum(c) AS BIGINT) AS s1, CAST(sum(c * c) AS BIGINT) AS s2 FROM c GROUP BY 1")
def user_stats_initial(spark, d):
    return history.moments(A.watch_log(spark, d), "user_id", "watched_pct")


@query(f"WITH {WATCH} SELECT user_id, weekday, count(*) AS n FROM wl GROUP BY 1, 2")
def user_weekday_histogram(spark, d):
    return history.weekday_counts(A.watch_log(spark, d), "user_id")


@query(f"""WITH {WATCH}, n AS (SELECT user_id, weekday, count(*) AS n FROM wl GROUP BY 1, 2)
SELECT user_id, string_agg(weekday || '=' || n, ',' ORDER BY weekday) AS weekday_freq FROM n GROUP BY 1""")
def user_weekday_map(spark, d):
    out = history.weekday_map(A.watch_log(spark, d), "user_id")
    return out.select("user_id", F.array_join(F.transform(F.map_entries("weekday_freq"), lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ",").alias("weekday_freq"))


@query(f"""WITH {WATCH}, c AS (SELECT *, CAST(round(coalesce(watched_pct, 0) * 100) AS BIGINT) AS c FROM wl)
SELECT user_id, event_id, count(*) OVER w AS run_n, CAST(sum(c) OVER w AS BIGINT) AS run_s1, CAST(sum(c * c) OVER w AS BIGINT) AS run_s2 FROM c
WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING)""")
def user_stats_cumulative(spark, d):
    return history.running_moments(A.watch_log(spark, d), "user_id", ("pos",), "watched_pct").select("user_id", "event_id", "run_n", "run_s1", "run_s2")


_JOINED = "(n * mean + m * mu) / (n + m)"


@query(f"""WITH RECURSIVE {SESSION}, sh AS (SELECT user_id, session_num, {units_sql("coalesce(watched_pct, 0)")} AS c FROM s),
x AS (SELECT user_id, session_num AS step, count(*) AS m, sum(c)::DOUBLE / (count(*) * {UNITS}e0) AS mu, (count(*) * sum(c * c) - sum(c) * sum(c))::DOUBLE / (count(*)::DOUBLE * count(*) * {UNITS * UNITS}e0) AS own FROM sh GROUP BY 1, 2),
st(user_id, step, mean, v, n) AS (SELECT DISTINCT user_id, 0, 0e0, 0e0, CAST(0 AS BIGINT) FROM x UNION ALL
 SELECT user_id, step, {round2_sql("j")}, {round2_sql("w")}, n + m FROM (SELECT *, (n * (v + (mean - j) * (mean - j)) + m * (own + (mu - j) * (mu - j))) / (n + m) AS w FROM (
  SELECT x.user_id, x.step, st.mean, st.v, st.n, x.m, x.mu, x.own, {_JOINED} AS j FROM st JOIN x ON x.user_id = st.user_id AND x.step = st.step + 1)))
SELECT user_id, step, mean AS avg, v AS var, n FROM st WHERE step > 0""")
def user_stats_fold_exact(spark, d):
    rows = _sessions(spark, d).groupBy("user_id", "session_num").agg(F.array_sort(F.collect_list(F.struct("pos", "watched_pct"))).alias("x"))
    return history.fold_stats(rows.select("user_id", "session_num", F.col("x.watched_pct").alias("pcts")), "user_id", "session_num", "pcts")


@query(f"""WITH {SESSION} SELECT user_id, session_num, CAST(sum(n_items) OVER w AS BIGINT) AS items, count(*) OVER w AS n_sessions,
 string_agg(CAST(last_pos AS VARCHAR), ',') OVER w AS ends FROM sess WINDOW w AS (PARTITION BY user_id ORDER BY session_num ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def trailing_session_window(spark, d):
    rows = sessions.summarize_sessions(_sessions(spark, d))
    out = history.trailing(rows, "user_id", "session_num", 3, F.sum("n_items"), F.count("*"), F.collect_list(F.col("last_pos").cast("string")))
    return out.toDF(*rows.columns, "items", "n_sessions", "e").select("user_id", "session_num", "items", "n_sessions", F.array_join("e", ",").alias("ends"))


@query(f"""WITH {SESSION}, w AS (SELECT a.user_id, a.session_num, b.date, max(b.session_num) AS step FROM sess a JOIN sess b
 ON a.user_id = b.user_id AND b.session_num BETWEEN a.session_num - 2 AND a.session_num GROUP BY 1, 2, 3)
SELECT user_id, session_num, string_agg(date || ':' || step, ',' ORDER BY date) AS log FROM w GROUP BY 1, 2""")
def usage_log_by_date(spark, d):
    out = history.usage_log(sessions.summarize_sessions(_sessions(spark, d)), "user_id", "session_num", 3)
    return out.select("user_id", "session_num", F.array_join(F.transform("x", lambda e: F.concat_ws(":", e.date, e.step.cast("string"))), ",").alias("log"))


@query(f"WITH {ORDERS}, n AS (SELECT user_id, step, memory, lead(memory) OVER w AS next_memory, lead(1) OVER w AS h FROM ol WINDOW w AS (PARTITION BY user_id ORDER BY step)) SELECT user_id, step, memory, next_memory FROM n WHERE h = 1")
def lead_memory_target(spark, d):
    return history.lead_target(A.orders_log(spark, d), "user_id", ("step",), "memory").select("user_id", "step", "memory", "next_memory")


@query(f"WITH {ORDERS} SELECT user_id, step, coalesce(lag(memory) OVER (PARTITION BY user_id ORDER BY step), 'seed') AS before_memory FROM ol")
def lag_state(spark, d):
    return history.lag_state(A.orders_log(spark, d), "user_id", ("step",), "memory", F.lit("seed")).select("user_id", "step", "before_memory")


@query(f"""WITH {ORDERS} SELECT user_id, step, coalesce(string_agg(memory, ',') OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
 string_agg(memory, ',') OVER (PARTITION BY user_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS after FROM ol""")
def cumulative_concat(spark, d):
    out = history.cumulative_lists(A.orders_log(spark, d).withColumn("own", F.array("memory")), "user_id", ("step",), "own")
    return out.select("user_id", "step", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


@query(f"WITH {ORDERS} SELECT user_id, step, memory AS gained FROM ol")
def prefix_delta(spark, d):
    rows = history.cumulative_lists(A.orders_log(spark, d).withColumn("own", F.array("memory")), "user_id", ("step",), "own")
    return history.prefix_delta(rows.drop("before"), "user_id", ("step",), "after").select("user_id", "step", F.array_join("gained", ",").alias("gained"))


@query(f"WITH {ORDERS}, g AS (SELECT *, min(step) FILTER (status = 'P') OVER (PARTITION BY user_id) AS gap FROM ol) SELECT user_id, step, status FROM g WHERE gap IS NULL OR step < gap")
def resume_first_gap(spark, d):
    return history.until_first_gap(A.orders_log(spark, d), "user_id", "step", F.col("status") == "P").select("user_id", "step", "status")


@query(f"""WITH {ORDERS}, l AS (SELECT user_id, CAST(step AS VARCHAR) AS step, memory FROM ol UNION ALL SELECT c_custkey, '0', 'none' FROM customer),
z AS (SELECT user_id, arg_max(memory, CAST(step AS INTEGER)) AS memory FROM l GROUP BY 1)
SELECT user_id, step, memory FROM l UNION ALL SELECT user_id, 'final', memory FROM z""")
def history_compile(spark, d):
    initial = load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("none").alias("memory"))
    log = A.orders_log(spark, d).withColumn("seq", F.col("o_orderkey"))
    return history.compile_history(initial, log, "user_id", "step", "seq", "memory")


# --- ordered sources, audits, joins


@query(f"WITH {ATTEMPTS} SELECT key, source_rank, seq, payload FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source_rank DESC, seq DESC) AS r FROM att) WHERE r = 1")
def dedupe_last_wins(spark, d):
    return merging.last_wins(A.attempts(spark, d), ["key"], "source_rank", "seq")


@query(f"WITH {ATTEMPTS} SELECT key, source_rank, seq, payload FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source_rank, seq) AS r FROM att) WHERE r = 1")
def dedupe_first_wins(spark, d):
    return merging.first_wins(A.attempts(spark, d), ["key"], "source_rank", "seq")


_READ = f"""WITH {ATTEMPTS}, k AS (SELECT *, source_rank >= coalesce(max(source_rank) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS kept FROM att),
w AS (SELECT key, arg_max(source_rank, seq) FILTER (kept) AS source_rank, max(seq) FILTER (kept) AS seq, arg_max(payload, seq) FILTER (kept) AS payload, count(*) FILTER (kept) - 1 AS replaced, count(*) FILTER (NOT kept) AS skipped FROM k GROUP BY 1)"""


@query(_READ + " SELECT * FROM w")
def dedupe_rank_aware(spark, d):
    return merging.rank_aware(A.attempts(spark, d), ["key"], "source_rank", "seq", read="seq")


@query(_READ + " SELECT count(*) AS added, CAST(sum(replaced) AS BIGINT) AS replaced, CAST(sum(skipped) AS BIGINT) AS skipped FROM w")
def merge_counters(spark, d):
    return merging.merge_counters(merging.rank_aware(A.attempts(spark, d), ["key"], "source_rank", "seq", read="seq"))


@query(f"WITH {ORDERS} SELECT user_id, step, o_orderkey, memory, status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step DESC, o_orderkey) AS r FROM ol) WHERE r = 1")
def latest_state(spark, d):
    return merging.latest_state(A.orders_log(spark, d), "user_id", "step", "o_orderkey")


@query("""WITH b AS (SELECT p_partkey AS key, p_size AS v FROM part WHERE p_partkey % 3 < 2), p AS (SELECT p_partkey AS key, -p_size AS v FROM part WHERE p_partkey % 3 > 0)
SELECT coalesce(p.key, b.key) AS key, CASE WHEN p.key IS NOT NULL THEN p.v ELSE b.v END AS v,
 CASE WHEN p.key IS NOT NULL AND b.key IS NOT NULL THEN 'replaced' WHEN p.key IS NOT NULL THEN 'appended' ELSE 'kept' END AS status FROM b FULL JOIN p ON b.key = p.key""")
def merge_replace_or_append(spark, d):
    part = load(spark, d, "part")
    base = part.filter("p_partkey % 3 < 2").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("v"))
    patch = part.filter("p_partkey % 3 > 0").select(F.col("p_partkey").alias("key"), (-F.col("p_size")).alias("v"))
    return merging.replace_or_append(base, patch, "key")


@query("""WITH b AS (SELECT p_partkey AS key FROM part WHERE p_size < 30), p AS (SELECT p_partkey AS key FROM part WHERE p_size > 20)
SELECT (SELECT count(*) FROM p) AS applied, (SELECT count(*) FROM p JOIN b USING (key)) AS replaced, (SELECT count(*) FROM p ANTI JOIN b USING (key)) AS appended""")
def replace_counters(spark, d):
    part = load(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("v"))
    return merging.replace_counters(merging.replace_or_append(part.filter("v < 30"), part.filter("v > 20"), "key"))


@query("""WITH u AS (SELECT o_custkey AS user_id, row_number() OVER (ORDER BY o_custkey) - 1 AS i FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1))
SELECT o_orderkey, CAST(i % 4 AS INTEGER) AS shard FROM orders JOIN u ON user_id = o_custkey""")
def rebuild_shards(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    n = o.groupBy("user_id").agg(F.count("*").cast("int").alias("n")).filter("n > 1")
    needed = n.select("user_id", F.sequence(F.lit(1), "n").alias("sessions"))
    return merging.rebuilt_shards(o.join(n.select("user_id"), "user_id", "left_semi"), needed, 4).select("o_orderkey", "shard")


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders")
def keyed_duplicate_guard(spark, d):
    rows = merging.require_unique(load(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return rows.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))


@query("SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_keys, count(*) = count(DISTINCT l_orderkey) AS is_unique FROM lineitem")
def uniqueness_audit(spark, d):
    return merging.uniqueness(load(spark, d, "lineitem"), "l_orderkey")


@query("WITH f AS (SELECT l_orderkey, l_linenumber AS round FROM lineitem WHERE l_returnflag = 'R') SELECT count(*) AS pending, (SELECT max(round) FROM f) AS latest_round FROM f WHERE round = (SELECT max(round) FROM f)")
def pending_latest_round(spark, d):
    f = load(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", F.col("l_linenumber").alias("round"))
    return merging.pending_latest_round(f, "round")


@query("SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS n_users, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY 1")
def batch_status_counts(spark, d):
    return load(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_users"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'test' WHEN c_custkey % 10 = 1 THEN 'valid' ELSE 'train' END AS split, count(o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def split_by_ids(spark, d):
    ids = load(spark, d, "customer").select(F.col("c_custkey"), F.expr("case when c_custkey % 10 = 0 then 'test' when c_custkey % 10 = 1 then 'valid' else 'train' end").alias("split"))
    counts = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))
    return merging.strict_join(counts, ids, "c_custkey").select("c_custkey", "split", "n")


@query(f"WITH {ORDERS} SELECT c_custkey AS user_id, coalesce(memory, '{{}}') AS memory FROM customer LEFT JOIN ol ON user_id = c_custkey AND step = 1")
def left_join_history(spark, d):
    first = A.orders_log(spark, d).filter("step = 1").select("user_id", "memory")
    return load(spark, d, "customer").select(F.col("c_custkey").alias("user_id")).join(first, "user_id", "left").select("user_id", F.coalesce("memory", F.lit("{}")).alias("memory"))


@query(f"WITH {ORDERS} SELECT a.user_id, a.step, a.o_orderkey, b.memory AS previous FROM ol a JOIN ol b ON a.user_id = b.user_id AND b.step = a.step - 1")
def offset_join_prev_session(spark, d):
    o = A.orders_log(spark, d)
    return merging.previous_session(o.select("user_id", "step", "o_orderkey"), o.select("user_id", "step", F.col("memory").alias("previous")), "user_id", "step")


@query(f"""WITH {ORDERS}, u AS (SELECT * FROM ol WHERE status = 'F'), e AS (SELECT * FROM ol WHERE memory <> '5-LOW')
SELECT a.user_id, a.step, coalesce(u.memory, e.memory) AS memory, CASE WHEN u.memory IS NOT NULL THEN 'updated' ELSE 'extracted' END AS source
FROM ol a LEFT JOIN u ON a.user_id = u.user_id AND u.step = a.step - 1 LEFT JOIN e ON a.user_id = e.user_id AND e.step = a.step - 1 WHERE coalesce(u.memory, e.memory) IS NOT NULL""")
def fallback_join(spark, d):
    o = A.orders_log(spark, d)
    out = merging.with_fallback(o.select("user_id", "step"), o.filter("status = 'F'"), o.filter("memory <> '5-LOW'"), "user_id", "step", "memory")
    return out.select("user_id", "step", "memory", "source")


@query(f"""WITH {ORDERS}, x AS (SELECT * FROM ol WHERE step > 1)
SELECT 'prev' AS variant, x.user_id, x.step, b.memory FROM x JOIN ol b ON x.user_id = b.user_id AND b.step = x.step - 1 UNION ALL
SELECT 'session1', x.user_id, x.step, b.memory FROM x JOIN ol b ON x.user_id = b.user_id AND b.step = 1 UNION ALL
SELECT 'initial', x.user_id, x.step, b.memory || '+' || x.memory FROM x JOIN ol b ON x.user_id = b.user_id AND b.step = 1""")
def evaluation_variants(spark, d):
    o = A.orders_log(spark, d)
    rows, state = o.filter("step > 1"), o.select("user_id", "step", F.col("memory").alias("m"))
    first = state.filter("step = 1").select("user_id", "m")
    prev = merging.previous_session(rows, state, "user_id", "step").select(F.lit("prev").alias("variant"), "user_id", "step", F.col("m").alias("memory"))
    one = rows.join(first, "user_id")
    return prev.unionByName(one.select(F.lit("session1").alias("variant"), "user_id", "step", F.col("m").alias("memory"))).unionByName(
        one.select(F.lit("initial").alias("variant"), "user_id", "step", F.concat_ws("+", "m", "memory").alias("memory"))
    )


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_baseline(spark, d):
    ids = load(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").select("c_custkey").join(ids, "c_custkey", "left_semi")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_resume(spark, d):
    done = load(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return merging.resume(load(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")


@query("WITH u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS r FROM (SELECT DISTINCT user_id FROM events)) SELECT user_id, CAST((r - 1) % 4 AS INTEGER) AS shard FROM u")
def shard_assignment(spark, d):
    return merging.shards(load(spark, d, "events"), "user_id", 4)


@query("""SELECT o.o_orderkey, l.l_partkey AS part FROM orders o JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) l ON l_orderkey = o_orderkey AND r = 1""")
def first_match_join(spark, d):
    li = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_partkey").alias("part"))
    return merging.first_match(load(spark, d, "orders").select("o_orderkey"), li, ["o_orderkey"], ["l_linenumber", "part"]).select("o_orderkey", "part")


@query("""SELECT l_orderkey AS key, string_agg(p_brand, ',' ORDER BY l_linenumber, l_partkey) AS found FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size < 30 GROUP BY 1""")
def ordered_item_lookup(spark, d):
    li = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    out = merging.ordered_lookup(li.select("key", F.col("x.l_partkey").alias("ids")), load(spark, d, "part").filter("p_size < 30"), "key", "ids", "p_partkey", "p_brand")
    return out.select("key", F.array_join("found", ",").alias("found"))


# --- ranking


@query(f"WITH {CANDIDATES} SELECT query, string_agg(CAST(item AS VARCHAR), ',' ORDER BY r) AS items FROM top GROUP BY 1")
def candidates_top50(spark, d):
    out = ranking.top_candidates(A.candidates(spark, d), "query", "item", "score")
    return out.select("query", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


_WINDOWS = f"""WITH {CANDIDATES}, t AS (SELECT query, max(item) AS target FROM top GROUP BY 1), w AS (SELECT top.*, target, k FROM top JOIN t USING (query), range(4) AS g(k) WHERE r > 10 * k AND r <= 10 * k + 20),
h AS (SELECT query, k, target, max(CASE WHEN item = target THEN 1 ELSE 0 END) AS has FROM w GROUP BY 1, 2, 3)
SELECT query, k AS w, string_agg(CAST(CASE WHEN has = 0 AND r = 10 * k + 20 THEN target ELSE item END AS VARCHAR), ',' ORDER BY r) AS items FROM w JOIN h USING (query, k, target) GROUP BY 1, 2"""


@query(_WINDOWS)
def candidate_windows(spark, d):
    top = ranking.top_candidates(A.candidates(spark, d), "query", "item", "score")
    out = ranking.candidate_windows(top.withColumn("target", F.array_max("items")), "items", "target")
    return out.select("query", F.col("w").cast("long").alias("w"), F.array_join(F.col("window").cast("array<string>"), ",").alias("items"))


_STEP = "{a} AS (SELECT query, item, s, row_number() OVER (PARTITION BY query ORDER BY s DESC, slot) AS rk FROM (SELECT query, item, s, r - {lo} - 1 AS slot FROM base WHERE r > {lo} AND r <= {hi} {prev}))"
_RERANK = f"WITH {CANDIDATES}, n AS (SELECT query FROM top GROUP BY 1 HAVING count(*) = 50), base AS (SELECT top.query, item, r, (item * 7919) % 1009 AS s FROM top JOIN n USING (query)), " + ", ".join(
    _STEP.format(a=f"r{k}", lo=30 - 10 * k, hi=(50 if k == 0 else 40 - 10 * k), prev="" if k == 0 else f"UNION ALL SELECT query, item, s, 9 + rk FROM r{k - 1} WHERE rk <= 10") for k in range(4)
) + """, fin AS (SELECT query, item, rk AS rank FROM r3 UNION ALL SELECT query, item, rk + 10 FROM r2 WHERE rk > 10 UNION ALL SELECT query, item, rk + 20 FROM r1 WHERE rk > 10 UNION ALL SELECT query, item, rk + 30 FROM r0 WHERE rk > 10)"""


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    top = ranking.top_candidates(A.candidates(spark, d), "query", "item", "score").filter(F.size("items") == 50)
    scored = F.transform("items", lambda i: F.struct(i.alias("item"), ((i * 7919) % 1009).alias("score")))
    return top.select("query", ranking.rerank(scored).alias("x")).select("query", F.col("x.item").alias("items"))


@query(_RERANK + " SELECT query, item, rank FROM fin")
def rerank_sliding_window(spark, d):
    return _reranked(spark, d).select("query", F.posexplode("items").alias("p", "item")).select("query", "item", (F.col("p") + 1).cast("long").alias("rank"))


_RANKS = _RERANK + """, want AS (SELECT s_suppkey AS query, s_nationkey % 5 AS session_idx, s_suppkey * 37 % 200 + 1 AS target FROM supplier),
rk AS (SELECT w.query, session_idx, coalesce(f.rank, 51) AS rank FROM want w LEFT JOIN fin f ON f.query = w.query AND f.item = w.target)"""
_MEANS = "count(*) AS n, " + ", ".join(
    f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS recall_{k}, round(avg(CASE WHEN rank <= {k} THEN 1.0 / log2(rank + 1.0) ELSE 0.0 END::DOUBLE), 6) AS ndcg_{k}" for k in (1, 5, 10, 20)
) + ", round(avg(CASE WHEN rank <= 50 THEN 1.0::DOUBLE / rank ELSE 0.0 END), 6) AS mrr_50"


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    want = load(spark, d, "supplier").select(F.col("s_suppkey").alias("query"), (F.col("s_nationkey") % 5).alias("session_idx"), (F.col("s_suppkey") * 37 % 200 + 1).alias("target"))
    return ranking.ranked(want, _reranked(spark, d), "query", "target").select("query", "session_idx", "rank", "status")


@query(_RANKS + f" SELECT {_MEANS} FROM rk")
def rank_metrics_global(spark, d):
    return ranking.mean_metrics(_ranks(spark, d), "rank")


@query(_RANKS + f" SELECT {_MEANS} FROM rk")
def rank_metrics_merged(spark, d):
    """Four workers' partial sums, of which one ran twice and two only after a restart."""
    ranks, at = folds.written(_ranks(spark, d).withColumn("part", F.col("query") % 4)), folds.shared(spark)
    work = lambda rows: progress.partial(rows, "rank")
    for k in (0, 2, 0):
        progress.snapshot(work(ranks.filter(F.col("part") == k)), k, at)
    return progress.merge(progress.run_shards(ranks, "part", 4, at, work))


@query(_RANKS + " SELECT CAST(query % 3 AS INTEGER) AS shard, count(*) AS n, CAST(sum(rank) AS BIGINT) AS rank_sum, count(*) FILTER (rank = 51) AS n_other FROM rk GROUP BY 1")
def rank_progress(spark, d):
    """What is observed of each shard while its snapshot is written."""
    ranks, at = folds.written(_ranks(spark, d)), folds.shared(spark)
    seen = [
        (k, *progress.snapshot(ranks.filter(F.col("query") % 3 == k), k, at, n=F.count(F.lit(1)), s=F.sum(F.col("rank").cast("long")), o=F.count_if(F.col("rank") == 51)).values())
        for k in range(3)
    ]
    return spark.createDataFrame(seen, "shard int, n long, rank_sum long, n_other long")


@query(_RANKS + f" SELECT session_idx, {_MEANS} FROM rk GROUP BY 1")
def rank_metrics_by_session(spark, d):
    return ranking.mean_metrics(_ranks(spark, d), "rank", "session_idx")


@query(_RANKS + """, st AS (SELECT CASE WHEN rank <= 50 THEN 'SUCCESS' WHEN query IN (SELECT query FROM fin) THEN 'IGNORED_TARGET_ABSENCE' ELSE 'FAIL_DATA_MISSING' END AS status FROM rk)
SELECT status, count(*) AS n, status LIKE 'FAIL%' AS true_fail FROM st GROUP BY 1""")
def rank_status_counts(spark, d):
    return ranking.status_counts(_ranks(spark, d))


@query("""WITH w AS (SELECT s_suppkey AS id, s_nationkey % 5 AS session_idx FROM supplier), r AS (SELECT p_partkey AS id, CAST(p_size AS INTEGER) AS rank FROM part WHERE p_size <= 40),
m AS (SELECT w.*, coalesce(rank, 51) AS rank FROM w LEFT JOIN r USING (id)) SELECT session_idx, """ + _MEANS + " FROM m GROUP BY 1")
def rerank_report_by_session(spark, d):
    wanted = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5).alias("session_idx"))
    ranks = load(spark, d, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("rank"), F.lit("SUCCESS").alias("status"))
    return builders.rerank_report(wanted, ranks)[1]


@query(_RERANK + " SELECT query, item, rank FROM fin")
def rerank_with_scorer(spark, d):
    top = ranking.top_candidates(A.candidates(spark, d), "query", "item", "score").filter(F.size("items") == 50)
    out = ranking.rerank_with(top.select("query", "items"), "query", "items", _window_scores)
    return out.select("query", F.posexplode("items").alias("p", "item")).select("query", "item", (F.col("p") + 1).cast("long").alias("rank"))


def _window_scores(prompts: list[str], attempt: int = 0) -> list[str]:
    """A stand-in for a scorer: a score for each item of a window."""
    import json

    return [json.dumps([i * 7919 % 1009 for i in json.loads(p)["items"]]) for p in prompts]


@query("""WITH c AS (SELECT l_orderkey AS key, p_brand, p_size % 3 AS g, l_linenumber - 1 AS pos FROM lineitem JOIN part ON p_partkey = l_partkey),
m AS (SELECT key, p_brand, g, max(pos) AS pos FROM c GROUP BY 1, 2, 3)
SELECT m.key, m.p_brand, m.g, substr('ABCDEFGHIJKLMNOPQRST', CAST(m.pos + 1 AS INTEGER), 1) AS letter FROM m JOIN c ON c.key = m.key AND c.p_brand = m.p_brand AND c.g = m.g AND c.pos = 0""")
def answer_letter_lookup(spark, d):
    c = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    c = c.select(F.col("l_orderkey").alias("key"), "p_brand", (F.col("p_size") % 3).alias("g"), (F.col("l_linenumber") - 1).alias("pos"))
    return ranking.letter_answers(c, c.filter("pos = 0").select("key", "p_brand", "g"), "key", ["p_brand", "g"], "pos").select("key", "p_brand", "g", "letter")


# --- dialogues and lists


@query("""WITH f AS (SELECT conv_id, min(turn) FILTER (length(text) % 7 = 0) AS t FROM conversations GROUP BY 1)
SELECT f.conv_id, coalesce(string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (turn < t), '') || CASE WHEN count(*) FILTER (turn < t) > 0 THEN chr(10) ELSE chr(10) END AS dialogue FROM f JOIN conversations c ON c.conv_id = f.conv_id GROUP BY 1""")
def dialogue_prefix_before_target(spark, d):
    out = A.turns(spark, d)
    return out.select("conv_id", lists.flatten_turns(lists.before_target(F.col("turns")), keep_empty=True).alias("dialogue"))


@query("SELECT conv_id, coalesce(string_agg(role || ': ' || trim(text, ' '), chr(10) ORDER BY turn, text) FILTER (coalesce(role, '') <> '' AND length(trim(coalesce(text, ''), ' ')) > 0), '') AS dialogue FROM conversations GROUP BY 1")
def dialogue_flatten(spark, d):
    return A.turns(spark, d).select("conv_id", lists.flatten_turns(F.col("turns")).alias("dialogue"))


_PARTS = "p AS (SELECT l_orderkey AS key, l_linenumber AS i, l_suppkey % 7 AS x FROM lineitem)"


def _two_lists(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("i"), (F.col("l_suppkey") % 7).alias("x"), "l_partkey")
    own = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("i", "x")))), lambda e: e.x)
    return li.groupBy("key").agg(own(F.col("i") > 2).alias("a"), own(F.col("i") <= 2).alias("b"))


@query(f"""WITH {_PARTS} SELECT o_orderkey AS key, coalesce((SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY i, x) FROM p WHERE p.key = o_orderkey AND i > 2 AND x NOT IN (SELECT x FROM p q WHERE q.key = o_orderkey AND i <= 2)), '') AS rest
FROM orders WHERE o_orderkey IN (SELECT key FROM p)""")
def list_except_keep_dups(spark, d):
    return _two_lists(spark, d).select("key", F.array_join(lists.except_keeping(F.col("a"), F.col("b")).cast("array<string>"), ",").alias("rest"))


@query(f"""WITH {_PARTS}, f AS (SELECT key, x, min(i) AS i FROM p GROUP BY 1, 2) SELECT key, string_agg(CAST(x AS VARCHAR), ',' ORDER BY CASE WHEN i <= 2 THEN 0 ELSE 1 END, i, x) AS united FROM f GROUP BY 1""")
def list_union_ordered(spark, d):
    return _two_lists(spark, d).select("key", F.array_join(lists.union_in_order(F.col("b"), F.col("a")).cast("array<string>"), ",").alias("united"))


@query(f"""WITH {_PARTS} SELECT a.key, string_agg(a.i || '/' || a.x, ',' ORDER BY a.i, a.x) AS rest FROM p a WHERE a.i > 2 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.key = a.key AND b.i <= 2 AND b.x = a.x) GROUP BY 1""")
def list_except_by_key(spark, d):
    li = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("i"), (F.col("l_suppkey") % 7).alias("x"))
    own = lambda c: F.array_sort(F.collect_list(F.when(c, F.struct("i", "x"))))
    two = li.groupBy("key").agg(own(F.col("i") > 2).alias("a"), own(F.col("i") <= 2).alias("b"))
    rest = F.transform(lists.except_by(F.col("a"), F.col("b"), "x"), lambda e: F.concat_ws("/", e.i.cast("string"), e.x.cast("string")))
    return two.select("key", F.array_join(rest, ",").alias("rest")).filter("rest <> ''")


@query("SELECT 'a' AS tag, c_custkey AS id FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'b', s_suppkey FROM supplier WHERE s_acctbal > 0")
def union_tagged(spark, d):
    a = load(spark, d, "customer").filter("c_acctbal > 0").select(F.lit("a").alias("tag"), F.col("c_custkey").alias("id"))
    return a.unionByName(load(spark, d, "supplier").filter("s_acctbal > 0").select(F.lit("b").alias("tag"), F.col("s_suppkey").alias("id")))


@query("SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect_keys(spark, d):
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id")).intersect(load(spark, d, "orders").select(F.col("o_custkey").alias("id")))


@query("""WITH l AS (SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text, count(*) AS n FROM conversations GROUP BY 1),
a AS (SELECT conv_id, count(*) FILTER (role <> 'assistant') AS others FROM conversations GROUP BY 1)
SELECT l.conv_id, CASE WHEN role = 'assistant' THEN n - 1 ELSE others END AS n_left, CASE WHEN role = 'assistant' THEN text ELSE '' END AS gold FROM l JOIN a USING (conv_id)""")
def split_gold_response(spark, d):
    messages = F.transform("turns", lambda t: F.struct(t.speaker.alias("role"), t.text.alias("content")))
    rest, gold = lists.split_gold(F.col("m"))
    return A.turns(spark, d).select("conv_id", messages.alias("m")).select("conv_id", F.size(rest).cast("long").alias("n_left"), gold.alias("gold"))


@query("""SELECT conv_id, string_agg(text, '|' ORDER BY turn, role) FILTER (rn > 2) AS tail FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS rn FROM conversations) GROUP BY 1""")
def drop_initial_items(spark, d):
    out = A.turns(spark, d).select("conv_id", lists.drop_first(F.transform("turns", lambda t: t.text), 2).alias("x"))
    return out.select("conv_id", F.when(F.size("x") > 0, F.array_join("x", "|")).alias("tail"))


# --- vectors, judges, losses


@query("""WITH e AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT i, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
x AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS k FROM u), s AS (SELECT k, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM x GROUP BY 1)
SELECT max(n) AS n, round(1 - (sum(s * s) - sum(q)) / (max(n) * (max(n) - 1)), 6) AS avg_distance FROM s""")
def pairwise_cosine_distance(spark, d):
    return vectors.mean_pairwise_distance(A.vectors(spark, d), "v")


@query("""WITH e AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.i, b.i AS j, round(1 - list_cosine_similarity(a.v, b.v), 9) AS dist FROM e a JOIN e b ON a.i <> b.i),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rk FROM p) SELECT i AS query, rk AS rank, j AS neighbour FROM r WHERE rk <= 10""")
def knn_neighbours(spark, d):
    return vectors.nearest(A.vectors(spark, d), 10, "vec_id", "v").select("query", F.col("rank").cast("long").alias("rank"), "neighbour")


@query("""WITH e AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.i, b.i AS j, round(1 - list_cosine_similarity(a.v, b.v), 9) AS dist FROM e a JOIN e b ON a.i <> b.i),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rk FROM p) SELECT count(*) AS n, round(avg(dist), 6) AS avg_distance FROM r WHERE rk <= 10""")
def knn_avg_distance(spark, d):
    return vectors.knn_distance(A.vectors(spark, d), 10, "vec_id", "v")


@query("WITH s AS (SELECT count(*) AS n FROM embeddings GROUP BY label), t AS (SELECT sum(n) AS t FROM s) SELECT round(-sum(n / t * ln(n / t)) / ln(10), 6) AS entropy FROM s, t")
def cluster_entropy(spark, d):
    return vectors.cluster_entropy(A.vectors(spark, d).groupBy("label").agg(F.count("*").alias("n")), "n", 10)


_KMEANS = "WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL), " + clusters.kmeans_sql("e", "vec_id", "v", 10)


@query(_KMEANS + " SELECT key AS vec_id, cluster FROM km")
def kmeans_clusters(spark, d):
    return clusters.kmeans(A.vectors(spark, d), "vec_id", "v", 10).select(F.col("key").alias("vec_id"), "cluster")


@query(_KMEANS + ", z AS (SELECT count(*) AS n FROM km GROUP BY cluster), t AS (SELECT sum(n) AS t FROM z) SELECT round(-sum(n / t * ln(n / t)) / ln(10), 6) AS entropy FROM z, t")
def kmeans_entropy(spark, d):
    found = clusters.kmeans(A.vectors(spark, d), "vec_id", "v", 10)
    return vectors.cluster_entropy(found.groupBy("cluster").agg(F.count("*").alias("n")), "n", 10)


_SCORES = """sc AS (SELECT lang AS dataset_type, 'quality' AS metric, quality + 1 AS score FROM labels JOIN documents USING (doc_id) UNION ALL SELECT lang, 'toxicity', toxic * 3 FROM labels JOIN documents USING (doc_id))"""


@query(f"WITH {_SCORES} SELECT metric, dataset_type, count(*) AS n, round(avg(score), 6) AS mean_score FROM sc WHERE score > 0 GROUP BY GROUPING SETS ((metric), (dataset_type, metric))")
def judge_scores_grouping_sets(spark, d):
    met = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", F.col("lang").alias("dataset_type")), "doc_id")
    a = met.select("dataset_type", F.lit("quality").alias("metric"), (F.col("quality") + 1).alias("score"))
    return vectors.score_report(a.unionByName(met.select("dataset_type", F.lit("toxicity").alias("metric"), (F.col("toxic") * 3).alias("score"))))


_LOSS = """e AS (SELECT vec_id // 8 AS batch, vec_id % 8 AS r, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
z AS (SELECT a.batch, a.r AS qi, b.r AS ii, list_cosine_similarity(a.v, list_reverse(b.v)) / 0.05 AS z FROM e a JOIN e b ON a.batch = b.batch),
l AS (SELECT batch, qi, ln(sum(exp(z))) - max(CASE WHEN qi = ii THEN z END) AS l FROM z GROUP BY 1, 2)"""


@query(f"WITH {_LOSS} SELECT batch, round(avg(l), 6) AS loss FROM l GROUP BY 1")
def infonce_loss(spark, d):
    e = A.vectors(spark, d).select(F.floor(F.col("vec_id") / 8).cast("long").alias("batch"), (F.col("vec_id") % 8).alias("r"), "v", F.reverse("v").alias("i"))
    return vectors.infonce(e, "batch", "r", "v", "i")


@query("SELECT lang, CAST(ceil(least(max(n_chars), 13507) / 8.0) * 8 AS BIGINT) AS padded FROM documents GROUP BY 1")
def padded_lengths(spark, d):
    rows = load(spark, d, "documents")
    found = F.least(F.max("n_chars"), F.lit(13507))
    return rows.groupBy("lang").agg((F.ceil(found / 8) * 8).cast("long").alias("padded"))


@query("SELECT vec_id, string_agg(CAST(CASE WHEN k < 5 THEN -100 ELSE CAST(round(x * 100) AS BIGINT) END AS VARCHAR), ',' ORDER BY k) AS labels FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings) GROUP BY 1")
def label_masking(spark, d):
    ids = F.transform("v", lambda x: F.round(x * 100).cast("long"))
    return A.vectors(spark, d).select("vec_id", F.array_join(vectors.label_mask(ids, F.lit(5)).cast("array<string>"), ",").alias("labels"))


# --- scalar functions and JSON


@query("""SELECT p_partkey, CASE WHEN lower(trim(p_type)) IN ('', 'nan', 'none', 'null') THEN NULL ELSE trim(p_type) END AS item_type, CAST(p_size AS DOUBLE) AS size,
 CASE WHEN p_size % 3 = 0 THEN true WHEN p_size % 3 = 1 THEN false END AS for_kids FROM part""")
def normalize_catalog(spark, d):
    said = F.when(F.col("p_size") % 3 == 0, " Yes ").when(F.col("p_size") % 3 == 1, "f").otherwise("maybe")
    return load(spark, d, "part").select("p_partkey", X.clean(F.col("p_type")).alias("item_type"), X.to_double(F.col("p_size").cast("string")).alias("size"), X.to_boolean(said).alias("for_kids"))


@query("SELECT p_partkey, CASE WHEN p_size % 10 IN (0, 1, 2, 3, 4) THEN p_name ELSE p_brand END AS title FROM part")
def title_preference(spark, d):
    # Lists with and without an English-speaking country.
    lists_ = ["France, USA ", "Great Britain", "new zealand,India", "Ireland", "UK", "US", "United States", "United Kingdom, France", " NaN ", "France,Usability"]
    countries = F.element_at(F.array(*map(F.lit, lists_)), (F.col("p_size") % 10 + 1).cast("int"))
    return load(spark, d, "part").select("p_partkey", X.preferred_title(F.col("p_brand"), F.col("p_name"), countries).alias("title"))


@query("SELECT doc_id, array_to_string(list_transform(string_split(text, ',')[1:5], lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), ', ') AS keywords FROM documents WHERE text <> ''")
def top5_keywords(spark, d):
    return load(spark, d, "documents").filter("text <> ''").select("doc_id", X.first_keywords(F.col("text")).alias("keywords"))


@query("SELECT o_orderkey, o_orderpriority || '_' || o_custkey AS key, o_orderpriority AS usr, CAST(o_custkey AS VARCHAR) AS session FROM orders")
def id_split_right(spark, d):
    rows = load(spark, d, "orders").select("o_orderkey", X.session_key(F.col("o_orderpriority"), F.col("o_custkey")).alias("key"))
    return rows.select("o_orderkey", "key", X.key_user(F.col("key")).alias("usr"), X.key_session(F.col("key")).alias("session"))


@query(f"WITH {WATCH} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN date WHEN event_id % 3 = 1 THEN weekday ELSE date || ', ' || weekday END AS day FROM wl")
def day_string(spark, d):
    w = A.watch_log(spark, d)
    return w.select("event_id", X.day_of(F.when(F.col("event_id") % 3 != 1, F.col("date")), F.when(F.col("event_id") % 3 != 0, F.col("weekday"))).alias("day"))


@query("SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations")
def strip_role_prefix(spark, d):
    c = load(spark, d, "conversations")
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" Assistant : "), F.col("text"))).otherwise(F.concat(F.lit("agent:"), F.col("text")))
    return c.select("conv_id", "turn", X.without_role(said).alias("text"))


@query("SELECT p_partkey, CASE WHEN p_size % 26 < 20 THEN chr(CAST(65 + p_size % 26 AS INTEGER)) END AS letter, CASE WHEN p_size % 26 < 20 THEN 26 END AS place FROM part")
def parse_answer_tag(spark, d):
    said = F.concat(F.lit(" <think>x</think> <Answer> "), F.lower(F.char(65 + F.col("p_size") % 26)), F.lit("</answer> rest <answer>A</answer>"))
    at = X.tagged_answer_at(said)
    return load(spark, d, "part").select("p_partkey", at.letter.alias("letter"), at.place.alias("place"))


# What stands before and after a letter in an answer, and the letter that is read if that one is not allowed.
_SAID = [
    ("**Answer**: ", " so", None), ("final: (", ")", None), ("Option ", "", None), ("The answer: [", "]", None), ("answer is ", ".", None), ("B or a: Index - ", "", "A"),
    ("answer: Q</THINK>Answer: B, no. Final answer ", " or C?", "B"), ("C, I think, d ", "e", "D"),
]


def _said_sql() -> tuple[str, str]:
    """SQL for the letter read in each form and its place in the text."""
    letter, place = [], []
    for i, (lead, tail, other) in enumerate(_SAID):
        own = "chr(CAST(65 + p_size % 20 AS INTEGER))" if i != 7 else "'D'"
        letter.append(f"WHEN {i} THEN {own}")
        place.append(f"WHEN {i} THEN {len(lead) if i != 7 else lead.index('d ')}")
    return f"CASE p_partkey % {len(_SAID)} {' '.join(letter)} END", f"CASE p_partkey % {len(_SAID)} {' '.join(place)} END"


@query(f"SELECT p_partkey, {_said_sql()[0]} AS letter, CAST({_said_sql()[1]} AS INTEGER) AS place FROM part")
def parse_plain_answer(spark, d):
    form = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in _SAID]), (F.col("p_partkey") % len(_SAID) + 1).cast("int"))
    at = X.plain_answer_at(F.concat(form(0), F.char(65 + F.col("p_size") % 20), form(1)))
    return load(spark, d, "part").select("p_partkey", at.letter.alias("letter"), at.place.alias("place"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '<b>' || p_name END AS answer, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS think FROM part")
def answer_blocks(spark, d):
    whole = F.concat(F.lit("<think> "), F.col("p_brand"), F.lit("</think>\n<Answer>"), F.col("p_name"), F.lit(" </ANSWER> rest"))
    got = X.answer_blocks(F.when(F.col("p_size") % 2 == 0, whole).otherwise(F.concat(F.lit(" <b>"), F.col("p_name"), F.lit("\n"))))
    return load(spark, d, "part").select("p_partkey", got.answer.alias("answer"), got.think.alias("think"))


@query("""SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) || '<|im_start|>assistant' || chr(10) AS prompt,
 string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || text || '<|eot_id|>', '' ORDER BY turn, role, text) AS other FROM conversations GROUP BY 1""")
def chat_template(spark, d):
    messages = F.transform("turns", lambda t: F.struct(t.speaker.alias("role"), t.text.alias("content")))
    rows = A.turns(spark, d).select("conv_id", messages.alias("m"))
    return rows.select("conv_id", X.chat_text(F.col("m"), "qwen2.5", True).alias("prompt"), X.chat_text(F.col("m"), "llama").alias("other"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'qwen2.5' WHEN 1 THEN 'qwen3' WHEN 2 THEN 'qwen' ELSE 'llama' END AS family, CASE WHEN p_size % 4 < 3 THEN p_size END AS step FROM part""")
def model_names(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ["Qwen2.5-7B", "QWEN3", "my-Qwen", "Llama-3"])), (F.col("p_size") % 4 + 1).cast("int"))
    name = F.concat(kind, F.when(F.col("p_size") % 4 < 3, F.concat(F.lit("_step-"), F.col("p_size").cast("string"))).otherwise(F.lit("_step-x")))
    return load(spark, d, "part").select("p_partkey", X.model_family(name).alias("family"), X.number_after(name, "step").alias("step"))


@query("SELECT c_custkey, 'User ' || c_name || ' of ' || c_mktsegment || ' {' || c_nationkey || '}' AS prompt FROM customer")
def template_render(spark, d):
    made = X.render("User [[$Name$]] of [[$Segment$]] ", {"Name": F.col("c_name"), "Segment": F.col("c_mktsegment")})
    return load(spark, d, "customer").select("c_custkey", F.concat(made, X.fill("{{{n}}}", {"n": F.col("c_nationkey")})).alias("prompt"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'OBJECT' AS kind FROM events")
def json_props(spark, d):
    v = F.try_parse_json("props")
    return load(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), J.kind_of(v).alias("kind"))


_FINE = '"positive_preference":{"content_material":"a","production_context":"b"},"negative_preference":{"content_material":"a","production_context":"b"},"usage_patterns":{"temporal_patterns":"a","immersion_style":"b"},'
# Extractions, and the errors in them.
_EXTRACTED = [
    ("behavior", "{" + _FINE + '"decision_drivers":{"selection_priority":"a","motivations":"m"}}', []),
    ("behavior", "{" + _FINE + '"decision_drivers":{"selection_priority":"a","motivations":3}}', ["behavior.decision_drivers.motivations: not a string"]),
    ("behavior", '{"usage_patterns":[]}', [f"behavior.{x}: not an object" for x in ("positive_preference", "negative_preference", "usage_patterns", "decision_drivers")]),
    ("behavior", "[1]", ["behavior: not an object"]),
    ("behavior", "{", ["behavior: not JSON"]),
    ("dialogue", '{"dialogue_persona":["x",1],"memory":{"episodic_memory":[],"recommendation_outcomes":[{"item":"i","reaction":"Accept","reason":"r"}]}}', ["dialogue.dialogue_persona[1]: not a string"]),
    ("dialogue", '{"dialogue_persona":[],"memory":{"episodic_memory":"e","recommendation_outcomes":[7,{"item":"i","reason":"r"}]}}',
     ["dialogue.memory.episodic_memory: not a list", "dialogue.memory.recommendation_outcomes[0]: not an object", "dialogue.memory.recommendation_outcomes[1].reaction: not a string"]),
    ("dialogue", '{"dialogue_persona":{}}', ["dialogue.dialogue_persona: not a list", "dialogue.memory: not an object"]),
]


def _case(column: str, values: list[str]) -> str:
    """SQL for the value of a list that a number modulo its length names."""
    quoted = [v.replace("'", "''") for v in values]
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(quoted)) + " END"


def _pick(column: str, values: list[str]):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(column) % len(values) + 1).cast("int"))


@query(f"SELECT event_id, {_case('event_id', [chr(59).join(e) for _, _, e in _EXTRACTED])} AS errors FROM events")
def json_validate_errors(spark, d):
    body, kind = _pick("event_id", [b for _, b, _ in _EXTRACTED]), _pick("event_id", [k for k, _, _ in _EXTRACTED])
    errors = F.when(kind == "behavior", J.validate_behavior(body)).otherwise(J.validate_dialogue(body))
    return load(spark, d, "events").select("event_id", F.array_join(errors, ";").alias("errors"))


# Updated states under alias names, and the errors in them.
_BEHAVIOR = "{" + _FINE + '"decision_drivers":{"selection_priority":"a","motivations":"m"}}'
_UPDATED = [
    ('{"behavior_persona":' + _BEHAVIOR + ',"dialogue_persona":["x"],"memory":{"session_events":["e"],"recommendation_history":[]}}', ""),
    ('{"updated_memory":{"updated_behavior_persona":' + _BEHAVIOR + ',"updated_dialogue_persona":["x"],"memory":{"episodic_memory":["e"],"recommendation_outcomes":[]}}}', ""),
    ('{"behavioral_persona":' + _BEHAVIOR + ',"dialogue_persona":["x"],"updated_session_events":[2],"updated_recommendation_history":[]}', "updated.memory.session_events[0]: not a string"),
    ("nothing", "updated: not JSON"),
]


@query(f"SELECT event_id, {_case('event_id', [e for _, e in _UPDATED])} AS errors FROM events")
def json_validate_updated(spark, d):
    return load(spark, d, "events").select("event_id", F.array_join(J.validate_updated(_pick("event_id", [b for b, _ in _UPDATED])), ";").alias("errors"))


# Answers of models, and what mending makes of them.
_BROKEN = [
    (' {"a": 1} ', '{"a": 1}'), ('"{\\"a\\":1} "', '{"a":1}'), ('{"a": "é"} and so on', '{"a":"é"}'), ("no json", "no json"), ("[1, 2] tail", "[1, 2] tail"),
    ('{"memory":{"episodic_memory":["a"} , "updated_recommendation_history": [{"item":"i"}]}} done', '{"memory":{"episodic_memory":["a"],"updated_recommendation_history":[{"item":"i"}]}}'),
    ('{"episodic_memory":["a"},"updated_recommendation_history":[7]}}', '{"episodic_memory":["a"},"updated_recommendation_history":[7]}}'),
    ('{"memory":{"episodic_memory":["a"},"updated_recommendation_history":[{"item":"i"}]}', '{"memory":{"episodic_memory":["a"],"updated_recommendation_history":[{"item":"i"}]}}'),
    ('{"a":{"b":[{"c":1}]}', '{"a":{"b":[{"c":1}]}}'),
]


@query(f"SELECT event_id, {_case('event_id', [e for _, e in _BROKEN])} AS body FROM events")
def json_repair(spark, d):
    return load(spark, d, "events").select("event_id", J.repaired(_pick("event_id", [b for b, _ in _BROKEN])).alias("body"))


@query("SELECT event_id, json_extract_string(props, '$.k') || ' ' || event_type || ' x' AS body FROM events")
def nested_values_text(spark, d):
    nested = F.concat(F.lit('{"a":['), F.col("props"), F.lit(',null],"b":{"c":"'), F.col("event_type"), F.lit('","d":["x"]}}'))
    return load(spark, d, "events").select("event_id", J.values_text(nested).alias("body"))


# --- calls, retries, folds


@query(f"SELECT c_mktsegment, count(*) AS n, {code("'segment ' || c_mktsegment")} % 1000 AS code FROM customer GROUP BY 1")
def prompt_cache(spark, d):
    """Two runs over one cache: the second calls for nothing that the first has asked."""
    path = folds.shared(spark)
    rows = load(spark, d, "customer").select("c_mktsegment", F.concat(F.lit("segment "), F.col("c_mktsegment")).alias("prompt"))
    folds.persistent_calls(rows.filter("c_mktsegment < 'F'"), "prompt", path, folds.offline)
    out = folds.persistent_calls(rows, "prompt", path, lambda p, k: [x if "segment A" not in q else "asked twice" for q, x in zip(p, folds.offline(p, k))])
    return out.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.max(F.get_json_object("response", "$.code").cast("long")).alias("code"))


@query(f"SELECT {code('s_name')} % 1000 % 3 + 1 AS attempts, true AS is_valid, count(*) AS n FROM supplier GROUP BY 1")
def retry_until_valid(spark, d):
    rows = load(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("prompt"))
    out = folds.retry_until_valid(rows, "prompt", folds.offline, lambda r: F.get_json_object(r, "$.code").cast("int") % 3 == F.get_json_object(r, "$.attempt").cast("int"))
    return out.groupBy(F.col("attempts").cast("long").alias("attempts"), "is_valid").agg(F.count("*").alias("n"))


@query(f"WITH {SESSION} SELECT user_id, session_num, CAST(sum(n_items) OVER (PARTITION BY user_id ORDER BY session_num) AS BIGINT) AS state FROM sess")
def fold_user_state(spark, d):
    rows = folds.written(sessions.summarize_sessions(_sessions(spark, d)).select("user_id", "session_num", "n_items"))
    seed = rows.filter("session_num = 1").select("user_id", F.col("n_items").alias("state"))
    return folds.fold_sessions(rows, seed, "user_id", "session_num", "n_items", lambda s, v: s + v)


_TOLD = "CASE WHEN e = [] THEN 'initial | ' || item ELSE 'next | ' || item || ' | ' || to_json(e) || ' | ' || e[-1] END"
_PROPOSED = """'{"text": "' || replace(substr(told, 1, 40), '"', chr(92) || '"') || '", "code": ' || """ + code("told") + """ % 1000 || ', "attempt": 0}'"""


@query(f"""WITH RECURSIVE {SESSION}, it AS (SELECT user_id, session_num, date AS item, row_number() OVER (PARTITION BY user_id ORDER BY session_num) AS n FROM sess),
ch(user_id, session_num, n, e) AS (SELECT user_id, CAST(0 AS INTEGER), CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM it WHERE n = 1 UNION ALL
 SELECT user_id, session_num, n, list_append(e, CASE WHEN c % 5 > 0 THEN 'event ' || c ELSE 'No event selected.' END) FROM (
  SELECT *, {code("'select | ' || told || ' | ' || " + _PROPOSED)} AS c FROM (SELECT it.user_id, it.session_num, it.n, ch.e, {_TOLD} AS told FROM ch JOIN it ON it.user_id = ch.user_id AND it.n = ch.n + 1)))
SELECT user_id, session_num, e[-1] AS event FROM ch WHERE n > 0""")
def event_chain(spark, d):
    rows = folds.written(sessions.summarize_sessions(_sessions(spark, d)).select("user_id", "session_num", F.col("date").alias("item")))
    return folds.chain_events(rows, "user_id", "session_num", "item", folds.offline, folds.offline_choice)


@query(f"WITH {WATCH}, c AS (SELECT user_id, CAST(round(coalesce(watched_pct, 0) * 100) AS BIGINT) AS c FROM wl) SELECT user_id, count(*) AS n, CAST(sum(c) AS BIGINT) AS s1, CAST(sum(c * c) AS BIGINT) AS s2 FROM c GROUP BY 1")
def stream_session_state(spark, d):
    import uuid

    from weftline.streaming import sessions as S

    name = f"moments_{uuid.uuid4().hex}"
    S.run_once(S.running_moments(S.event_stream(spark, f"{d}/events.parquet*")), name, "update", folds.shared(spark))
    return spark.table(name).groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("s1", "n").alias("s1"), F.max_by("s2", "n").alias("s2"))


# --- composite builders


@query(f"""WITH {SESSION}, x AS (SELECT a.user_id, a.session_num, b.event_id, b.pos FROM sess a JOIN s b ON a.user_id = b.user_id AND b.session_num BETWEEN a.session_num - 2 AND a.session_num)
SELECT user_id, session_num, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY pos) AS log FROM x GROUP BY 1, 2""")
def build_behavior_windows(spark, d):
    out = builders.behavior_windows(_sessions(spark, d))
    return out.select("user_id", "session_num", F.array_join(F.col("log").cast("array<string>"), ",").alias("log"))


@query(f"""WITH {ORDERS}, x AS (SELECT * FROM ol WHERE status <> 'P')
SELECT user_id, step, coalesce(lag(memory) OVER w, 'seed') AS b0, memory AS b2, coalesce(string_agg(status, ',') OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS o0,
 string_agg(status, ',') OVER (PARTITION BY user_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS o2, step - coalesce(lag(step) OVER w, 0) AS n_new FROM x WINDOW w AS (PARTITION BY user_id ORDER BY step)""")
def build_nine_components(spark, d):
    o = A.orders_log(spark, d)
    w = history.along("user_id", "step").rowsBetween(W.unboundedPreceding, 0)
    states = o.select("user_id", "step", F.col("memory").alias("after_behavior"), F.collect_list("memory").over(w).alias("events"), F.array("status").alias("outcomes"))
    extracted = o.filter("status <> 'P'").select("user_id", "step", F.lit("x").alias("current_behavior"))
    out = builders.nine_components(states, extracted, F.lit("seed"))
    return out.select(
        "user_id", "step", F.col("behavior.before_update").alias("b0"), F.col("behavior.after_update").alias("b2"), F.array_join("outcomes.before_update", ",").alias("o0"),
        F.array_join("outcomes.after_update", ",").alias("o2"), F.size("events.current_extraction").cast("long").alias("n_new"),
    )


@query("SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_partkey AS item_number, p_brand AS title, CAST(p_size AS DOUBLE) AS release_year, p_size % 2 = 0 AS for_kids, p_type AS actors FROM part")
def build_item_catalogue(spark, d):
    p = load(spark, d, "part")
    none = F.lit(" NaN ")
    rows = p.select(
        F.col("p_partkey").cast("string").alias("item_id"), F.col("p_type").alias("content_type"), F.lit("none").alias("title"), F.col("p_brand").alias("title_orig"),
        F.col("p_size").cast("string").alias("release_year"), none.alias("genres"), F.lit("UK").alias("countries"), F.when(F.col("p_size") % 2 == 0, "T").otherwise("0").alias("for_kids"),
        none.alias("age_rating"), none.alias("description"), none.alias("keywords"), none.alias("actors"), F.col("p_type").alias("actors_translated"), none.alias("directors"), none.alias("directors_translated"),
    )
    return builders.item_catalogue(rows).select("item_id", "item_number", "title", "release_year", "for_kids", "actors")


@query(f"""WITH {ORDERS}, n AS (SELECT *, lead(memory) OVER (PARTITION BY user_id ORDER BY step) AS nxt FROM ol)
SELECT CASE WHEN user_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, user_id || '_' || step AS id, memory || chr(10) || status AS prompt, nxt AS answer FROM n WHERE nxt IS NOT NULL""")
def build_update_samples(spark, d):
    crs = A.orders_log(spark, d).withColumnRenamed("step", "session_num")
    split = load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 10 == 0, "test").otherwise("train").alias("split"))
    out = builders.update_samples(crs, split, "system", "memory", "status")
    return out.select("split", "id", F.col("messages")[1].content.alias("prompt"), F.col("messages")[2].content.alias("answer"))


@query(f"""WITH {ORDERS}, c AS (SELECT user_id, step, list(memory) OVER (PARTITION BY user_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS ev FROM ol),
n AS (SELECT *, lead(ev) OVER (PARTITION BY user_id ORDER BY step) AS nx FROM c)
SELECT user_id || '_' || step AS id, '{{"episodic_memory":[' || CASE WHEN list_contains(ev, nx[-1]) THEN '' ELSE '"' || nx[-1] || '"' END || '],"recommendation_outcomes":[]}}' AS answer FROM n WHERE nx IS NOT NULL""")
def build_dialogue_samples(spark, d):
    w = history.along("user_id", "step").rowsBetween(W.unboundedPreceding, 0)
    o = A.orders_log(spark, d)
    crs = o.select(
        "user_id", F.col("step").alias("session_num"), F.lit("2024-01-01").alias("date"), F.lit("Monday").alias("weekday"), F.array(F.struct(F.lit("u").alias("speaker"), F.col("status").alias("text"))).alias("turns"),
        F.collect_list("memory").over(w).alias("events"), F.expr("cast(array() as array<struct<item: string, reaction: string>>)").alias("outcomes"),
    )
    split = load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("train").alias("split"))
    out = builders.dialogue_samples(crs, split, "system")
    return out.select("id", F.col("messages")[2].content.alias("answer"))


_SAMPLES = f"""WITH {CANDIDATES}, n AS (SELECT query FROM top GROUP BY 1 HAVING count(*) = 50), t AS (SELECT query, item AS target FROM top JOIN n USING (query) WHERE r = 25),
w AS (SELECT top.query, k, CASE WHEN r = 10 * k + 20 AND NOT (25 > 10 * k AND 25 <= 10 * k + 20) THEN target ELSE item END AS item, target FROM top JOIN t USING (query), range(4) AS g(k) WHERE r > 10 * k AND r <= 10 * k + 20),
o AS (SELECT w.*, p_name, p_brand, row_number() OVER (PARTITION BY w.query, k ORDER BY (item * 7919 + k) % 10007, item) - 1 AS pos FROM w JOIN part ON p_partkey = item),
l AS (SELECT o.query, k, max(pos) AS pos FROM o JOIN part q ON q.p_partkey = target AND q.p_name = o.p_name AND q.p_brand = o.p_brand GROUP BY 1, 2),
m AS (SELECT query, k, string_agg(p_name, chr(10) ORDER BY pos) AS movies FROM o GROUP BY 1, 2)"""


@query(_SAMPLES + """ SELECT query || '_1_w' || (k + 1) AS id, substr('ABCDEFGHIJKLMNOPQRST', CAST(pos + 1 AS INTEGER), 1) AS letter,
 s_name || chr(10) || 'user: ' || s_name || chr(10) || chr(10) || movies AS whole, 'user: ' || s_name || chr(10) || chr(10) || movies AS plain FROM l JOIN m USING (query, k) JOIN supplier ON s_suppkey = query""")
def build_ranking_samples(spark, d):
    top = ranking.top_candidates(A.candidates(spark, d), "query", "item", "score").filter(F.size("items") == 50)
    candidates = top.select(F.col("query").alias("user_id"), F.lit(1).alias("session_num"), F.lit(0).alias("seq"), F.element_at("items", 25).alias("target_id"), F.col("items").alias("top50"))
    turn = lambda hit: F.struct(F.lit("user").alias("speaker"), F.col("s_name").alias("text"), F.lit(hit).alias("is_target"))
    crs = load(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), F.lit(7).alias("session_num"), F.array(turn(False), turn(True)).alias("turns"), F.array(F.lit("first"), F.col("s_name")).alias("persona"))
    items = load(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("genres"))
    order = (F.col("item_id") * 7919 + F.col("w")) % 10007
    whole = builders.ranking_samples(crs, candidates, items, skip=1, order=order).select("id", F.col("messages")[2].content.alias("letter"), F.col("messages")[1].content.alias("whole"))
    plain = builders.ranking_samples(crs, candidates, items, order=order, parts=("dialogue", "movies")).select("id", F.col("messages")[1].content.alias("plain"))
    return whole.join(plain, "id")


_GOLD = """l AS (SELECT conv_id AS id, arg_max(role, turn) AS role, arg_max(text, turn) AS text, max(turn) AS last FROM conversations GROUP BY 1),
k AS (SELECT conv_id, turn, c.role, c.text FROM conversations c JOIN l ON id = conv_id WHERE CASE WHEN l.role = 'assistant' THEN turn < last ELSE c.role <> 'assistant' END)"""


@query(f"""WITH {_GOLD} SELECT id, CASE WHEN l.role = 'assistant' THEN l.text ELSE '' END AS gold,
 {code("coalesce((SELECT to_json(list(json_object('role', k.role, 'content', k.text) ORDER BY turn)) FROM k WHERE conv_id = id), '[]')")} % 1000 AS code FROM l WHERE role <> 'system'""")
def build_responses(spark, d):
    messages = F.transform("turns", lambda t: F.struct(t.speaker.alias("role"), t.text.alias("content")))
    samples = A.turns(spark, d).select(F.col("conv_id").alias("id"), messages.alias("messages"))
    done = samples.filter(F.element_at("messages", -1).role == "system").select("id")
    return builders.responses(samples, done, folds.offline).select("id", "gold", F.get_json_object("response", "$.code").cast("long").alias("code"))


from weftline.plans import catalog_models, catalog_runs, catalog_tables  # noqa: E402, F401  (they register further queries)
