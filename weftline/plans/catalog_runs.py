"""Queries of whole runs: events, dialogues, persona histories and the diversity report, from their real inputs to the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import clusters, folds, personas, sessions
from weftline.plans import adapters as A
from weftline.plans import builders
from weftline.plans.adapters import SESSION, load
from weftline.plans.catalog import _PROPOSED, _TOLD
from weftline.plans.catalog_models import _dialogues, _flat, _memories, _merged
from weftline.plans.registry import ORACLES, code, digest, query

#: Prompts of events: profiles of some users, dates, target items and up to three others, of which some have no title.
_PROMPTS = """tk AS (SELECT *, event_id % 300 AS item_id, pos = max(pos) OVER (PARTITION BY user_id, session_num) AS t FROM s),
tm AS (SELECT tk.*, row_number() OVER (PARTITION BY user_id, session_num, t ORDER BY event_id, pos) AS r, coalesce(p_name, CAST(item_id AS VARCHAR)) AS title FROM tk LEFT JOIN part ON p_partkey = item_id),
pr AS (SELECT user_id, session_num, coalesce('age ' || (20 + any_value(c_nationkey)) || ' ' || any_value(c_mktsegment), '{}') || ' | ' || arg_max(date, pos) || ', ' || arg_max(weekday, pos) || ' | ' || max(title) FILTER (t)
  || ' | ' || coalesce(string_agg(title, ', ' ORDER BY pos) FILTER (NOT t AND r <= 3), '') AS item FROM tm LEFT JOIN customer ON c_custkey = user_id AND c_nationkey % 2 = 0 GROUP BY 1, 2)"""
_EVENTS = f"""{_PROMPTS}, ie AS (SELECT user_id, session_num, item, row_number() OVER (PARTITION BY user_id ORDER BY session_num) AS n FROM pr),
ch(user_id, session_num, n, e) AS (SELECT user_id, CAST(0 AS INTEGER), CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM ie WHERE n = 1 UNION ALL
 SELECT user_id, session_num, n, list_append(e, CASE WHEN c % 5 > 0 THEN 'event ' || c ELSE 'No event selected.' END) FROM (
  SELECT *, {code("'select | ' || told || ' | ' || " + _PROPOSED)} AS c FROM (SELECT ie.user_id, ie.session_num, ie.n, ch.e, {_TOLD} AS told FROM ch JOIN ie ON ie.user_id = ch.user_id AND ie.n = ch.n + 1))),
ev AS (SELECT user_id, session_num, e[-1] AS event FROM ch WHERE n > 0)"""


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    items = sessions.mark_items(sessions.sessionize(A.watch_log(spark, d)), F.col("event_id")).withColumn("item_id", F.col("event_id") % 300)
    told = F.concat(F.lit("age "), (F.col("c_nationkey") + 20).cast("string"), F.lit(" "), F.col("c_mktsegment"))
    profiles = load(spark, d, "customer").filter("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), told.alias("profile"))
    titles = load(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))
    return folds.written(items), profiles, titles


@query(f"WITH {SESSION}, {_PROMPTS} SELECT user_id, session_num, item AS prompt FROM pr")
def event_prompts(spark, d):
    return builders.event_prompts(*_inputs(spark, d))


@query(f"WITH RECURSIVE {SESSION}, {_EVENTS} SELECT user_id, session_num, event FROM ev")
def event_run(spark, d):
    return builders.event_run(*_inputs(spark, d), folds.offline, folds.offline_choice)


_DATES = "it AS (SELECT user_id, session_num, date AS told, row_number() OVER (PARTITION BY user_id ORDER BY session_num) AS n FROM sess)"
_TOLD_ALL = f"""{_EVENTS}, hi AS (SELECT a.user_id, a.session_num, string_agg(CAST(b.event_id AS VARCHAR), ',' ORDER BY b.pos) AS log FROM sess a JOIN s b ON a.user_id = b.user_id AND b.session_num BETWEEN a.session_num - 3 AND a.session_num - 1 GROUP BY 1, 2),
it AS (SELECT pr.user_id, pr.session_num, coalesce(log, '[]') || ' | ' || event || ' | ' || item AS told, row_number() OVER (PARTITION BY pr.user_id ORDER BY pr.session_num) AS n
 FROM pr JOIN ev USING (user_id, session_num) LEFT JOIN hi USING (user_id, session_num))"""


@query(ORACLES["dialogue_fold"].replace(_DATES, _TOLD_ALL))
def dialogue_run(spark, d):
    items, profiles, titles = _inputs(spark, d)
    prompts = folds.written(builders.event_prompts(items, profiles, titles))
    events = folds.chain_events(prompts, "user_id", "session_num", "prompt", folds.offline, folds.offline_choice)
    seed = prompts.select("user_id").distinct().withColumn("persona", F.lit('["seed"]'))
    out = builders.dialogue_run(builders.behavior_windows(items), events, prompts, seed, _dialogues, _memories, _merged)
    return out.withColumn("episodes", F.to_json("episodes"))


def _asked(field: str, name: str, *parts: str) -> str:
    return digest(field, f"'{name} | ' || " + " || ' | ' || ".join(parts))


_FIELDS = {"temporal_patterns": "temporal", "immersion_style": "immersion"}


@query(f"""WITH RECURSIVE {SESSION}, it AS (SELECT user_id, session_num, {", ".join(f"{_asked(f, n, chr(39) + 'S' + chr(39) + ' || n_items', chr(39) + 'U' + chr(39) + ' || date')} AS x_{n}" for f, n in _FIELDS.items())}, row_number() OVER (PARTITION BY user_id ORDER BY session_num) AS n FROM sess),
ph(user_id, session_num, n, temporal_patterns, immersion_style) AS (SELECT user_id, CAST(0 AS INTEGER), CAST(0 AS BIGINT), 'stemporal_patterns:' || user_id, 'simmersion_style:' || user_id FROM it WHERE n = 1 UNION ALL
 SELECT it.user_id, it.session_num, it.n, {", ".join(_asked(f, n, f, f"x_{n}") for f, n in _FIELDS.items())} FROM ph JOIN it ON it.user_id = ph.user_id AND it.n = ph.n + 1)
SELECT user_id, session_num, temporal_patterns, immersion_style, CASE WHEN n = 0 THEN 'seed' ELSE 'updated' END AS source FROM ph""")
def persona_history(spark, d):
    """Extract from each session's logs, update session by session, seed and updates in one history."""
    rows = folds.written(sessions.summarize_sessions(sessions.sessionize(A.watch_log(spark, d))))
    part = lambda lead, c: F.concat(F.lit(lead), F.col(c).cast("string"))
    logs = rows.select(
        "user_id", "session_num", part("S", "n_items").alias("stats"), part("L", "weekday").alias("limited"), part("C", "date").alias("content_log"), part("P", "date").alias("production_log"),
        part("X", "date").alias("union_log"), part("U", "date").alias("usage_log"),
    )
    seed = rows.select("user_id").distinct().select("user_id", _flat("s", F.col("user_id").cast("string")).alias("persona"))
    out = builders.persona_history(logs, personas.OFFLINE, seed)
    return out.select("user_id", "session_num", "persona.usage_patterns.*", "source")


@query(f"""WITH RECURSIVE pt AS (SELECT c_custkey AS id, c_name || ' ' || c_mktsegment || ' ' || c_nationkey AS text FROM customer),
pv AS (SELECT id, list_transform(range(1, 17), lambda i: CAST(instr('0123456789abcdef', substr(md5(text), CAST(i AS INTEGER), 1)) - 1 AS DOUBLE)) AS v FROM pt), {clusters.kmeans_sql("pv", "id", "v", 10)},
pd AS (SELECT a.key AS q, b.key AS o, round(1 - list_dot_product(a.u, b.u), 9) AS d FROM ku a JOIN ku b ON a.key <> b.key), z AS (SELECT count(*) AS n FROM km GROUP BY cluster), t AS (SELECT sum(n) AS t FROM z)
SELECT (SELECT count(*) FROM pv) AS n, (SELECT round(avg(d), 6) FROM pd) AS pairwise, (SELECT round(avg(d), 6) FROM (SELECT d, row_number() OVER (PARTITION BY q ORDER BY d, o) AS r FROM pd) WHERE r <= 5) AS knn,
 (SELECT round(-sum(n / t * ln(n / t)) / ln(10), 6) FROM z, t) AS entropy""")
def diversity_report(spark, d):
    c = load(spark, d, "customer")
    body = F.to_json(F.struct(F.struct(F.col("c_name").alias("a"), F.array("c_mktsegment").alias("b")).alias("x"), F.struct(F.col("c_nationkey").alias("c")).alias("y")))
    return builders.diversity_report(c.select("c_custkey", body.alias("persona")), "c_custkey", "persona")
