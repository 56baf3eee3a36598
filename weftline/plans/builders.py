"""Composite builders: the data sets that the operators are put together for. Each takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import json as J
from weftline.functions import text as X
from weftline.operators import clusters, folds, history, lists, merging, personas, ranking, sessions, vectors


def split_histories(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Histories' heads and rests, both nested by date."""
    marked = sessions.head_split(items, order=("date", "pos"))
    nest = lambda rows: sessions.nest_by_date(rows, "event_id")
    return nest(marked.filter("is_init")), nest(marked.filter("not is_init"))


def behavior_windows(items: DataFrame, personas: DataFrame | None = None, k: int = 3) -> DataFrame:
    """Per session: the items of its last k sessions (item fields only), and its persona, '{}' where there is none.

    items: (user_id, session_num, pos, event_id, ...); personas: (user_id, session_num, persona).
    """
    own = items.groupBy("user_id", "session_num").agg(F.array_sort(F.collect_list(F.struct("pos", "event_id"))).alias("x"))
    frame = W.partitionBy("user_id").orderBy("session_num").rowsBetween(-(k - 1), 0)
    out = own.select("user_id", "session_num", F.flatten(F.collect_list("x.event_id").over(frame)).alias("log"))
    if personas is None:
        return out
    return out.join(personas, ["user_id", "session_num"], "left").withColumn("persona", F.coalesce("persona", F.lit("{}")))


def nine_components(states: DataFrame, extracted: DataFrame, seed: Column) -> DataFrame:
    """Before, current and after of behaviour, events and outcomes for sessions that stand on both sides.

    states: (user_id, step, after_behavior, events array cumulative, outcomes array); extracted: (user_id, step,
    current_behavior). Sessions without an extraction drop out and do not become a 'before'.
    """
    rows = states.join(extracted, ["user_id", "step"])
    rows = history.lag_state(rows, "user_id", ("step",), "after_behavior", seed)
    rows = history.prefix_delta(rows.withColumnRenamed("events", "after_events"), "user_id", ("step",), "after_events")
    frame = history.along("user_id", "step")
    rows = rows.withColumn("before_events", F.coalesce(F.lag("after_events").over(frame), F.array().cast("array<string>")))
    rows = history.cumulative_lists(rows, "user_id", ("step",), "outcomes")
    return rows.select(
        "user_id", "step",
        F.struct(F.col("before_after_behavior").alias("before_update"), F.col("current_behavior").alias("current_extraction"), F.col("after_behavior").alias("after_update")).alias("behavior"),
        F.struct(F.col("before_events").alias("before_update"), F.col("gained").alias("current_extraction"), F.col("after_events").alias("after_update")).alias("events"),
        F.struct(F.col("before").alias("before_update"), F.col("outcomes").alias("current_extraction"), F.col("after").alias("after_update")).alias("outcomes"),
    )


def item_catalogue(rows: DataFrame) -> DataFrame:
    """The catalogue's typed form from a CSV's texts; rows without an id drop out, and columns that are not there are null.
    Numeric ids lose their decimals."""
    raw = lambda n: F.col(n) if n in rows.columns else F.lit(None).cast("string")
    c = lambda n: X.clean(raw(n)).alias(n)
    key = X.clean(F.col("item_id"))
    number = F.when(key.rlike(r"^(?:[0-9]+[.]?[0-9]*|[.][0-9]+)$"), key.cast("double").cast("long"))
    # Columns that may hold actors and directors, in this order.
    actors, directors = ("actors_transliterated", "actors_translated", "actors"), ("directors_translated", "directors_transliterated", "directors", "transliterated")
    return rows.filter(key.isNotNull()).select(
        F.coalesce(number.cast("string"), key).alias("item_id"), number.alias("item_number"), c("content_type"),
        X.preferred_title(raw("title"), raw("title_orig"), raw("countries")).alias("title"), X.to_double(raw("release_year")).alias("release_year"),
        c("genres"), c("countries"), X.to_boolean(raw("for_kids")).alias("for_kids"), X.to_double(raw("age_rating")).alias("age_rating"),
        c("description"), c("keywords"), X.first_value(*map(raw, actors)).alias("actors"), X.first_value(*map(raw, directors)).alias("directors"),
    )


def item_profile(items: DataFrame) -> DataFrame:
    """Item texts for prompts: 'Unknown' for what is missing, five keywords at most."""
    u = lambda n: F.coalesce(F.col(n), F.lit("Unknown"))
    return items.select("item_id", F.to_json(F.struct("title", u("genres").alias("genres"), X.first_keywords(F.col("keywords")).alias("keywords"), u("directors").alias("directors"))).alias("profile"))


def extraction_samples(sessions_: DataFrame, split: DataFrame, system: str, user: str, fields: dict[str, Column], answer: Column) -> DataFrame:
    """Chat samples per split: sessions with an answer, messages from templates, ids 'user_session'."""
    rows = merging.strict_join(sessions_, split, "user_id").filter(answer.isNotNull() & (answer != "") & (answer != "{}"))
    messages = lists.chat(F.lit(system), X.fill(user, fields), answer)
    return rows.select("split", X.session_key(F.col("user_id"), F.col("session_num")).alias("id"), messages.alias("messages"))


def dialogue_samples(crs: DataFrame, split: DataFrame, system: str) -> DataFrame:
    """Dialogue extraction samples: the answer is what the next session's memory adds to this one's.

    crs: (user_id, session_num, date, weekday, turns, events array<string>, outcomes array<struct<item,..>>). A user's
    last session has no next and drops out.
    """
    rows = history.lead_target(crs, "user_id", ("session_num",), "events")
    nxt = history.lead_target(crs.select("user_id", "session_num", "outcomes"), "user_id", ("session_num",), "outcomes")
    rows = rows.join(nxt.select("user_id", "session_num", "next_outcomes"), ["user_id", "session_num"])
    answer = F.to_json(F.struct(
        lists.except_keeping(F.col("next_events"), F.col("events")).alias("episodic_memory"), lists.except_by(F.col("next_outcomes"), F.col("outcomes"), "item").alias("recommendation_outcomes")
    ))
    fields = {"day": X.day_of(F.col("date"), F.col("weekday")), "dialogue": lists.flatten_turns(F.col("turns"))}
    return extraction_samples(rows.withColumn("_answer", answer), split, system, "{day}\n{dialogue}", fields, F.col("_answer"))


def update_samples(crs: DataFrame, split: DataFrame, system: str, state: str, extracted: str) -> DataFrame:
    """State update samples: the next session's state is the answer to this one's state and extraction."""
    rows = history.lead_target(crs, "user_id", ("session_num",), state)
    return extraction_samples(rows, split, system, "{old}\n{new}", {"old": F.col(state), "new": F.col(extracted)}, F.col(f"next_{state}"))


def ranking_samples(
    crs: DataFrame, candidates: DataFrame, items: DataFrame, seed: int = 0, skip: int = 0, order: Column | None = None, parts: tuple[str, ...] = ("persona", "dialogue", "movies")
) -> DataFrame:
    """Listwise samples: four windows per session, candidates in a seeded order (or in `order`, of item_id and w), the
    target's letter as the answer. parts: what the prompt holds; ablations leave some out. skip: persona lines left out.

    crs: (user_id, session_num, turns with is_target, persona array<string>); candidates: (user_id, session_num, seq,
    target_id, top50); items: (item_id, title, genres). Sessions count by their place, the first candidate list wins,
    targets outside their list drop out, and of look-alike candidates the last letter is the answer.
    """
    place = F.row_number().over(history.along("user_id", "session_num"))
    rows = crs.withColumn("session_num", place)
    rows = merging.first_match(rows, candidates, ["user_id", "session_num"], ["seq"])
    shown = rows.select(
        "user_id", "session_num", "target_id", "top50", lists.flatten_turns(lists.before_target(F.col("turns")), keep_empty=True).alias("dialogue"),
        lists.drop_first(F.col("persona"), skip).alias("persona"),
    )
    each = ranking.candidate_windows(shown, "top50", "target_id").drop("top50")
    each = each.withColumn("id", F.concat_ws("_", "user_id", "session_num", F.concat(F.lit("w"), (F.col("w") + 1).cast("string"))))
    cand = each.select("id", "w", F.explode("window").alias("item_id")).join(items, "item_id")
    drawn = ranking.shuffled(seed, "id", "item_id") if order is None else order
    cand = cand.withColumn("pos", F.row_number().over(W.partitionBy("id").orderBy(drawn, "item_id")) - 1).filter(F.col("pos") < ranking.WINDOW)
    answers = each.select("id", F.col("target_id").alias("item_id")).join(items, "item_id").select("id", "title", "genres")
    letters = ranking.letter_answers(cand, answers, "id", ["title", "genres"], "pos")
    listed = cand.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "title"))).alias("x")).select("id", F.array_join("x.title", "\n").alias("movies"))
    out = each.join(listed, "id").join(letters.select("id", "letter"), "id")
    user = X.fill("\n".join(f"{{{p}}}" for p in parts), {"persona": F.array_join("persona", "\n"), "dialogue": F.col("dialogue"), "movies": F.col("movies")})
    return out.select("id", lists.chat(F.lit("rank"), user, F.col("letter")).alias("messages"))


def extraction_run(rows: DataFrame, needed: DataFrame, done: DataFrame, call: folds.Caller, valid, attempts: int = 3) -> DataFrame:
    """Eligible sessions not yet done, called with retries; is_valid parts rows for the sink and the quarantine."""
    work = merging.resume(sessions.eligible_sessions(rows, needed), done, "id")
    return folds.retry_until_valid(work, "prompt", call, valid, attempts)


def merge_extractions(rows: DataFrame, failures: DataFrame, allow_pending: bool = False) -> DataFrame:
    """Base and retries, last wins by id, in order of user, session, id; pending failures of the latest round are an
    error unless allowed."""
    pending = merging.pending_latest_round(failures, "round").first().pending
    if pending and not allow_pending:
        raise ValueError(f"{pending} failures are still pending")
    return merging.last_wins(rows, ["id"], "source_rank", "seq").orderBy("user_id", "session_num", "id")


def update_run(extracted: DataFrame, users: DataFrame, update) -> DataFrame:
    """The fold of states over users with more than one needed session, from the first session's extraction."""
    own = extracted.join(users.filter(F.array_max("sessions") > 1).select("user_id"), "user_id", "left_semi")
    seed = own.filter("session_num = 1").select("user_id", F.col("value").alias("state"))
    return folds.fold_sessions(own, seed, "user_id", "session_num", "value", update)


def responses(samples: DataFrame, done: DataFrame, call: folds.Caller) -> DataFrame:
    """Generated and gold responses of samples not yet done: (id, messages) to (id, gold, response)."""
    rest, gold = lists.split_gold(F.col("messages"))
    work = merging.resume(samples, done, "id").select("id", gold.alias("gold"), F.to_json(rest).alias("prompt"))
    out = folds.call_model(work, "prompt", call)
    return out.select("id", "gold", X.without_role(F.col("response")).alias("response"))


def rerank_report(wanted: DataFrame, ranks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Global and per-session means and status counts over all wanted ids."""
    met = ranking.required(wanted, ranks, "id")
    return ranking.mean_metrics(met, "rank"), ranking.mean_metrics(met, "rank", "session_idx"), met.groupBy("status").agg(F.count("*").alias("n"))


def event_prompts(items: DataFrame, profiles: DataFrame, titles: DataFrame) -> DataFrame:
    """(user_id, session_num, prompt): what the event of a session is made from: the user's profile ('{}' without one), the
    session's date and weekday, its target item and the other items of the session.

    items: (user_id, session_num, pos, date, weekday, item_id, target, in_session); profiles: (user_id, profile text);
    titles: (item_id, title), unknown ones shown by their ids.
    """
    named = items.join(titles, "item_id", "left").withColumn("title", F.coalesce("title", F.col("item_id").cast("string")))
    item = F.struct("pos", "title", "target", "in_session")
    shown = named.groupBy("user_id", "session_num").agg(F.array_sort(F.collect_list(item)).alias("watch"), F.max_by("date", "pos").alias("date"), F.max_by("weekday", "pos").alias("weekday"))
    rows = shown.join(profiles, "user_id", "left")
    others = F.array_join(F.transform(lists.sources(F.col("watch")), lambda r: r.title), ", ")
    target = F.coalesce(lists.last_target(F.col("watch")).title, F.lit(""))
    return rows.select("user_id", "session_num", F.concat_ws(" | ", F.coalesce("profile", F.lit("{}")), X.day_of(F.col("date"), F.col("weekday")), target, others).alias("prompt"))


def event_run(items: DataFrame, profiles: DataFrame, titles: DataFrame, generate: folds.Caller, select: folds.Caller) -> DataFrame:
    """(user_id, session_num, event): every user's chain of events over those prompts."""
    return folds.chain_events(event_prompts(items, profiles, titles), "user_id", "session_num", "prompt", generate, select)


def dialogue_prompts(windows: DataFrame, events: DataFrame, prompts: DataFrame) -> DataFrame:
    """(user_id, session_num, prompt): what a dialogue is made from: the behaviour of the sessions before (J04: history of
    session s - 1; none for the first), the session's event (J05: none where none was made) and its items."""
    history = windows.select("user_id", (F.col("session_num") + 1).alias("session_num"), F.array_join(F.col("log").cast("array<string>"), ",").alias("history"))
    keys = ["user_id", "session_num"]
    rows = prompts.join(history, keys, "left").join(events.select(*keys, "event"), keys, "left")
    return rows.select(*keys, F.concat_ws(" | ", F.coalesce("history", F.lit("[]")), F.coalesce("event", F.lit(folds.NO_EVENT)), "prompt").alias("prompt"))


def dialogue_run(windows: DataFrame, events: DataFrame, prompts: DataFrame, seed: DataFrame, *calls: folds.Caller) -> DataFrame:
    """Every user's dialogues over those prompts, with the persona and the memory that the ones before left."""
    return folds.fold_dialogues(dialogue_prompts(windows, events, prompts), seed, "user_id", "session_num", *calls)


def diversity_report(personas_: DataFrame, key: str, body: str, k: int = 5, clusters_: int = 10, model=personas.offline_vectors) -> DataFrame:
    """One row: n, the mean pairwise cosine distance, the mean distance to the k nearest and the entropy of clusters of what
    nested personas (JSON texts) say; blank ones are left out, and none left is an error."""
    texts = personas_.select(key, J.values_text(F.col(body)).alias("text"))
    rows = folds.written(personas.embed(personas.nonempty_texts(texts, "text"), "text", model).select(key, "embedding"))
    found = clusters.kmeans(rows, key, "embedding", clusters_)
    pairwise = vectors.mean_pairwise_distance(rows, "embedding").withColumnRenamed("avg_distance", "pairwise")
    knn = vectors.knn_distance(rows, k, key, "embedding").select(F.col("avg_distance").alias("knn"))
    entropy = vectors.cluster_entropy(found.groupBy("cluster").agg(F.count("*").alias("n")), "n", clusters_)
    return pairwise.crossJoin(knn).crossJoin(entropy)  # one row each


def persona_history(rows: DataFrame, call: folds.Caller, seed: DataFrame, user: str = "user_id", step: str = "session_num") -> DataFrame:
    """(user, step, persona, source): the seed at step 0, then each session's update, for which the session's persona is
    first extracted from its logs; rows: (user, step) and the texts that `personas.extract` takes."""
    extracted = folds.written(personas.extract(rows, call).select(user, step, "persona"))
    updated = personas.fold(extracted, seed, user, step, call)
    first = seed.select(user, F.lit(0).cast(extracted.schema[step].dataType).alias(step), "persona", F.lit("seed").alias("source"))
    return first.unionByName(updated.select(user, step, "persona", F.lit("updated").alias("source")))
