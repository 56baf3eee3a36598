"""Item projections, personas from model answers, judges, embeddings: what stands round the calls to models.

Calls of one row follow one another in one task, without a shuffle between them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import folds

# The keys of an item that the content, production and union logs show.
CONTENT = ("watched_pct", "content_type", "title", "genres", "description", "keywords")
PRODUCTION = ("watched_pct", "content_type", "title", "release_year", "countries", "actors", "directors")
UNION = (*CONTENT, *PRODUCTION[3:])
# A persona's sections with the fields of the answers that fill them.
SECTIONS = {
    "positive_preference": {"content_material": "positive_content_material", "production_context": "positive_production_context"},
    "negative_preference": {"content_material": "negative_content_material", "production_context": "negative_production_context"},
    "usage_patterns": {"temporal_patterns": "temporal_patterns", "immersion_style": "immersion_style"},
    "decision_drivers": {"selection_priority": "selection_priority", "motivations": "behavioral_motivation"},
}
#: The stand-in for a model that fills all of them.
OFFLINE = folds.offline_fields(*[f for s in SECTIONS.values() for f in s.values()])


def project(items: Column, names: tuple[str, ...], have: list[str]) -> Column:
    """Array of structs cut to some keys; keys that items do not have are null."""
    return F.transform(items, lambda r: F.struct(*[(r[n] if n in have else F.lit(None).cast("string")).alias(n) for n in names]))


def without(items: Column, *names: str) -> Column:
    """Array of structs without some keys."""
    return F.transform(items, lambda r: r.dropFields(*names))


def limited_stats(stats: Column) -> Column:
    """Mean and variance alone, 0 where they are missing."""
    zero = lambda n: F.coalesce(stats[n], F.lit(0.0)).alias(n)
    return F.struct(zero("watched_pct_avg"), zero("watched_pct_var"))


def usage_log(sessions: DataFrame, user: str, step: str, k: int) -> DataFrame:
    """date -> (day, watched_pct of its items) over the last k sessions; of sessions with one date the last is kept.

    sessions: (user, step, date, weekday, pcts array<double>)."""
    from weftline.operators.history import along

    seen = F.collect_list(F.struct("date", F.col(step).alias("step"), F.col("weekday").alias("day"), F.col("pcts").alias("watched_pct"))).over(along(user, step).rowsBetween(-(k - 1), 0))
    rows = sessions.select(user, step, F.array_sort(seen).alias("x"))
    last = F.filter("x", lambda e: ~F.exists("x", lambda o: (o.date == e.date) & (o.step > e.step)))
    return rows.select(user, step, F.map_from_entries(F.transform(last, lambda e: F.struct(e.date, F.struct(e.day.alias("day"), e.watched_pct.alias("watched_pct"))))).alias("log"))


def assemble(answers: Callable[[str], Column], stats: Column | None = None) -> Column:
    """The nested persona of flat answers, which answers(field) gives."""
    parts = [F.struct(*[answers(f).alias(n) for n, f in fields.items()]).alias(s) for s, fields in SECTIONS.items()]
    return F.struct(*([stats.alias("historical_stats")] if stats is not None else []), *parts)


def override(template: Column, behavior: Column, dialogue: Column, initial: Column | None = None) -> Column:
    """A template row's struct with two personas replaced, the dialogue one behind an initial list."""
    lines = F.concat(F.coalesce(initial, F.array().cast("array<string>")), dialogue) if initial is not None else dialogue
    return template.withField("behavioral_persona", behavior).withField("dialogue_persona", lines)


def sections_of(updated: Column) -> Column:
    """behavior_persona and dialogue_persona of an updated memory in JSON; other types than object and list are errors."""
    v = F.try_parse_json(updated)
    kind = lambda p, want: F.when(F.schema_of_variant(F.try_variant_get(v, p, "variant")).startswith(want), True)
    fail = F.raise_error(F.concat(F.lit("no personas in "), F.coalesce(updated, F.lit("null"))))
    ok = F.coalesce(kind("$.behavior_persona", "OBJECT") & kind("$.dialogue_persona", "ARRAY"), F.lit(False))
    return F.when(ok, F.struct(F.get_json_object(updated, "$.behavior_persona").alias("behavior_persona"), F.from_json(F.get_json_object(updated, "$.dialogue_persona"), "array<string>").alias("dialogue_persona"))).otherwise(fail)


def _ask(rows: DataFrame, call: folds.Caller, asked: dict[str, list[Column | str]]) -> DataFrame:
    """rows with the answers to prompts of a name and parts, as columns _name; calls that do not see each other's answers
    share a pass."""
    prompts = {f"_ask_{name}": F.concat_ws(" | ", F.lit(name), *parts) for name, parts in asked.items()}
    return folds.call_models(rows.withColumns(prompts), {f"_ask_{name}": f"_{name}" for name in asked}, call).drop(*prompts)


def _field(name: str, field: str) -> Column:
    return F.get_json_object(f"_{name}", f"$.{field}")


#: Which call's answer holds a field.
_HOLDS = {
    "positive_content_material": "content", "negative_content_material": "content", "positive_production_context": "production", "negative_production_context": "production",
    "temporal_patterns": "temporal", "immersion_style": "immersion", "selection_priority": "priority", "behavioral_motivation": "motives",
}


def _persona(rows: DataFrame, stats: str) -> DataFrame:
    out = assemble(lambda f: _field(_HOLDS[f], f), F.col(stats))
    return rows.withColumn("persona", out).drop(*{f"_{n}" for n in _HOLDS.values()})


def extract(rows: DataFrame, call: folds.Caller) -> DataFrame:
    """Adds persona by six calls a row, the last two of which see what the first two told of preferences.

    rows: stats, limited, content_log, production_log, union_log, usage_log, texts of prompts."""
    usage = ["stats", "usage_log"]
    rows = _ask(rows, call, {"content": ["limited", "content_log"], "production": ["limited", "production_log"], "temporal": usage, "immersion": usage})
    seen = [F.concat_ws(" ", "_content", "_production"), "limited", "union_log"]
    return _persona(_ask(rows, call, {"priority": seen, "motives": seen}), "stats")


def update(rows: DataFrame, call: folds.Caller) -> DataFrame:
    """(.., current, extracted) personas to their update by six calls a row, the last two of which see the updated
    preferences; the statistics are the extraction's."""

    def both(section: str, *fields: str) -> list[Column]:
        return [F.col(p)[section][f] for p in ("current", "extracted") for f in fields]

    pos, neg = "positive_preference", "negative_preference"
    pair = lambda f: [F.col(p)[s][f] for p in ("current", "extracted") for s in (pos, neg)]
    usage = lambda f: both("usage_patterns", f)
    rows = _ask(
        rows, call,
        {"content": pair("content_material"), "production": pair("production_context"), "temporal": usage("temporal_patterns"), "immersion": usage("immersion_style")},
    )
    seen = [F.concat_ws(" ", _field("content", f"{s}_content_material"), _field("production", f"{s}_production_context")) for s in ("positive", "negative")]
    drivers = lambda f: [*both("decision_drivers", f), *seen]
    rows = _ask(rows, call, {"priority": drivers("selection_priority"), "motives": drivers("motivations")})
    return _persona(rows.withColumn("_stats", F.col("extracted.historical_stats")), "_stats").drop("_stats")


def fold(extracted: DataFrame, seed: DataFrame, user: str, step: str, call: folds.Caller) -> DataFrame:
    """Phase two: each user's persona updated session by session from a seed, a table per wave. extracted: (user, step,
    persona), seed: (user, persona). Returns (user, step, persona); a session that is missing is passed over."""
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy(user).orderBy(step))
    ranked = folds.by_wave(extracted.select(user, step, F.col("persona").alias("extracted"), turn.alias("_n")), "_n")
    now, waves, n = seed.select(user, F.col("persona").alias("current")), folds.Waves(extracted.sparkSession), 0
    for n in range(1, folds.longest(ranked, "_n") + 1):
        rows = ranked.filter(F.col("_n") == n).drop("_n").join(now, user)
        now = waves.put(n, update(rows, call).select(user, step, "persona")).select(user, F.col("persona").alias("current"))
    return waves.all() if n else seed.select(user, F.lit(0).alias(step), "persona").filter("false")


def judge(personas: DataFrame, metrics: dict[str, str], call: folds.Caller) -> DataFrame:
    """(user_id, dataset_type, persona) to a row per metric with score and reasoning; an answer that is no JSON with a
    score has score 0."""
    each = personas.select("*", F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(v)) for k, v in sorted(metrics.items())]))).alias("metric", "_ask"))
    asked = each.withColumn("prompt", F.concat(F.col("_ask"), F.lit("\n\n[Behavioral Persona Input]\n"), F.col("persona")))
    out = folds.call_model(asked, "prompt", call)
    score = F.coalesce(F.get_json_object("response", "$.score").try_cast("int"), F.lit(0))
    return out.select("user_id", "dataset_type", "metric", score.alias("score"), F.get_json_object("response", "$.reasoning").alias("reasoning"))


def offline_scores(prompts: list[str], attempt: int = 0) -> list[str]:
    """Scores from 1 to 5, and now and then no JSON."""
    codes = [folds.code_of(p) for p in prompts]
    return [f'{{"score": {c % 5 + 1}, "reasoning": "r"}}' if c % 7 else "unavailable" for c in codes]


def offline_vectors(texts: list[str]) -> list[list[float]]:
    """A digest's sixteen leading digits as a vector."""
    return [[float(int(c, 16)) for c in hashlib.md5(t.encode()).hexdigest()[:16]] for t in texts]


def embed(rows: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]] = offline_vectors, out: str = "embedding") -> DataFrame:
    """Adds the unit vector of each text by a model of vectors; null texts are empty ones, a zero vector stays zero."""
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(model([t or "" for t in b.column(at).to_pylist()]), np.float64)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(x), pa.list_(pa.float64()))], names=[*b.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, {out} array<double>")


def nonempty_texts(rows: DataFrame, text: str) -> DataFrame:
    """rows whose flattened text is not blank; none left is an error."""
    kept = rows.filter(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0)
    if kept.isEmpty():
        raise ValueError("no text is left")
    return kept


def first_users(rows: DataFrame, user: str, n: int) -> DataFrame:
    """Rows of the first n users in order, a limit for trials."""
    return rows.join(rows.select(user).distinct().orderBy(user).limit(n), user, "left_semi")
