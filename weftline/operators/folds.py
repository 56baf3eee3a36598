"""Calls to outside models and the folds, retries and resumes around them.

A caller is a plain function from a list of prompts (and the attempt's number) to a list of texts. It runs on the
executors, a batch at a time; `offline` and its kin are deterministic stand-ins, made of MD5 so that SQL can follow them.
Results are written before they are used again, so that no call is made twice. Tables of folds lie in the shared folder
and go when the driver ends.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import tempfile
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.numbers import let

Caller = Callable[[list[str], int], list[str]]
#: The event of a session whose selecting call names none.
NO_EVENT = "No event selected."
#: Prompts of a call at most.
CALL_ROWS = 1000


def code_of(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:7], 16)


def offline(prompts: list[str], attempt: int = 0) -> list[str]:
    """Deterministic JSON for each prompt."""
    return [json.dumps({"text": p[:40], "code": code_of(p) % 1000, "attempt": attempt}) for p in prompts]


def offline_choice(prompts: list[str], attempt: int = 0) -> list[str]:
    """Deterministic selections for each prompt; some name no event."""
    codes = [code_of(p) for p in prompts]
    return [json.dumps({"refined_event": f"event {c}"} if c % 5 else {}) for c in codes]


def offline_fields(*names: str) -> Caller:
    """A caller whose answers hold these fields, eight digits of a digest each."""
    return lambda prompts, attempt=0: [json.dumps({n: hashlib.md5(f"{n}|{p}".encode()).hexdigest()[:8] for n in names}) for p in prompts]


@dataclass(frozen=True)
class Limits:
    """How calls run: in_flight at once on the whole cluster, so many of them in one task; tries of a call that fails, the
    pauses between them, and the longest answer that is taken."""

    in_flight: int = 64
    per_task: int = 8
    tries: int = 6
    first: float = 1.0
    longest: float = 60.0
    most_chars: int = 1 << 20

    @property
    def tasks(self) -> int:
        return max(1, self.in_flight // self.per_task)


#: What a call that never succeeds, or whose answer is too long, comes to.
NOTHING = "{}"


def one_call(call: Caller, prompt: str, attempt: int, limits: Limits, sleep=time.sleep) -> tuple[str, int]:
    """A call's answer and the tries it took. Pauses double and are cut short by a share that the prompt's digest sets, so
    that callers that fail together do not come back together."""
    for k in range(limits.tries):
        try:
            out = call([prompt], attempt)[0]
            return (out if len(out) <= limits.most_chars else NOTHING), k + 1
        except Exception:
            if k + 1 < limits.tries:
                jitter = code_of(f"{k}|{prompt}") / 16**7 / 2
                sleep(min(limits.longest, limits.first * 2**k) * (1 - jitter))
    return NOTHING, limits.tries


def with_backoff(call: Caller, attempts: int = 6, first: float = 1.0, longest: float = 60.0, sleep=time.sleep) -> Caller:
    """Repeats a failing call after growing pauses; in the end NOTHING. A batch that fails is called prompt by prompt."""
    limits = Limits(tries=attempts, first=first, longest=longest)
    return lambda prompts, attempt=0: [one_call(call, p, attempt, limits, sleep)[0] for p in prompts]


def call_model(rows: DataFrame, prompt: str, call: Caller, attempt: int = 0) -> DataFrame:
    """Adds response to every row, a batch a call; a batch that fails goes prompt by prompt, with pauses, and a prompt that
    fails for good comes to NOTHING."""
    return call_models(rows, {prompt: "response"}, call, attempt)


def call_models(rows: DataFrame, prompts: dict[str, str], call: Caller, attempt: int = 0) -> DataFrame:
    """call_model for several columns of prompts, each with its response's name, in one pass: every pass is a Python worker
    beside the others of its task. A call holds CALL_ROWS prompts at most."""
    at = {rows.columns.index(p): name for p, name in prompts.items()}
    again = with_backoff(call)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, CALL_ROWS):
                b = batch.slice(lo, CALL_ROWS)
                out = []
                for i in at:
                    asked = [p or "" for p in b.column(i).to_pylist()]
                    try:
                        out.append(pa.array(call(asked, attempt), pa.string()))
                    except Exception:
                        out.append(pa.array(again(asked, attempt), pa.string()))
                yield pa.RecordBatch.from_arrays([*b.columns, *out], names=[*b.schema.names, *at.values()])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, schema + "".join(f", `{name}` string" for name in at.values()))


def pooled_calls(rows: DataFrame, prompt: str, call: Caller, limits: Limits = Limits(), attempt: int = 0) -> DataFrame:
    """Adds response and tries to every row, each prompt a call of its own, limits.in_flight at once.

    The stage has limits.tasks tasks, each with a pool of limits.per_task threads: the bound holds however many executors
    there are. Answers keep their rows' order within a task; a task holds a batch of prompts.
    """
    at = rows.columns.index(prompt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(limits.per_task) as pool:
            for b in batches:
                got = list(pool.map(lambda p: one_call(call, p or "", attempt, limits), b.column(at).to_pylist()))
                text, tries = pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32())
                yield pa.RecordBatch.from_arrays([*b.columns, text, tries], names=[*b.schema.names, "response", "tries"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(limits.tasks).mapInArrow(run, schema + ", response string, tries int")


def flaky(call: Caller, fails: Callable[[str], int]) -> Caller:
    """A stand-in that fails so many times a prompt before it answers; retries of a prompt are one task's."""
    seen: Counter = Counter()

    def run(prompts: list[str], attempt: int = 0) -> list[str]:
        for p in prompts:
            seen[p] += 1
            if seen[p] <= fails(p):
                raise ConnectionError("try again")
        return call(prompts, attempt)

    return run


def shared(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Only a local session may do without that setting."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at}/weftline-folds/{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended first
        pass


def written(rows: DataFrame) -> DataFrame:
    """rows as a table in the shared folder."""
    path = shared(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def cached_calls(rows: DataFrame, prompt: str, cache: DataFrame | None, call: Caller) -> tuple[DataFrame, DataFrame]:
    """rows with response, each distinct prompt called once at most, and the grown cache (digest, response)."""
    keyed = rows.withColumn("digest", F.sha2(F.col(prompt), 256))
    asked = keyed.groupBy("digest").agg(F.first(prompt).alias("prompt"))
    if cache is not None:
        asked = asked.join(cache, "digest", "left_anti")
    new = written(call_model(asked, "prompt", call).select("digest", "response"))
    grown = new if cache is None else cache.select("digest", "response").unionByName(new)
    return keyed.join(grown, "digest", "left").drop("digest"), grown


def persistent_calls(rows: DataFrame, prompt: str, path: str, call: Caller) -> DataFrame:
    """cached_calls over a cache that lies at path from run to run; what is new is appended to it."""
    from weftline.sources.readers import exists

    spark = rows.sparkSession
    schema = "digest string, response string"
    cache = spark.read.schema(schema).parquet(path) if exists(spark, path) else None
    out, grown = cached_calls(rows, prompt, cache, call)
    new = grown if cache is None else grown.join(cache.select("digest"), "digest", "left_anti")
    written(new).write.mode("append").parquet(path)
    return out


def retry_until_valid(rows: DataFrame, prompt: str, call: Caller, valid: Callable[[Column], Column], attempts: int = 3) -> DataFrame:
    """Adds response, attempts used and is_valid; only rows still invalid are called again. Attempt 0 is greedy, later
    ones may sample. Each round is a table, so that the lineage stays short."""
    left, done = rows, None
    for k in range(attempts):
        got = written(call_model(left, prompt, call, k).withColumn("is_valid", F.coalesce(valid(F.col("response")), F.lit(False))).withColumn("attempts", F.lit(k + 1)))
        out = got if k + 1 == attempts else got.filter("is_valid")
        done = out if done is None else done.unionByName(out)
        left = got.filter("not is_valid").select(*rows.columns)
        if k + 1 < attempts and left.isEmpty():
            break
    return done


def longest(sessions: DataFrame, step: str) -> int:
    """The greatest step of all sessions; 0 where there are none."""
    return sessions.agg(F.max(step)).first()[0] or 0


def fold_sessions(sessions: DataFrame, seed: DataFrame, user: str, step: str, value: str, update: Callable[[Column, Column], Column], last: int | None = None) -> DataFrame:
    """Per-user state along sessions by a column expression: state n needs state n - 1 and a row of session n, so that a
    gap ends the user; of repeated sessions the first by value counts.

    sessions: (user, step, value); seed: (user, state) at step 1. One shuffle: a user's values are sorted and folded in
    the JVM, up to the last session or to step `last` where it is given.
    """
    kind = seed.schema["state"].dataType.simpleString()
    later = sessions.filter(F.col(step) > 1) if last is None else sessions.filter(F.col(step).between(2, last))
    own = later.groupBy(user).agg(F.array_sort(F.collect_list(F.struct(F.col(step).cast("int").alias("step"), F.col(value).alias("value")))).alias("_rows"))
    met = seed.select(user, "state").join(own, user, "left").withColumn("_rows", F.coalesce("_rows", F.array().cast(own.schema["_rows"].dataType)))
    row = lambda n, s: F.struct(n.cast("int").alias("step"), s.cast(kind).alias("state"))
    start = F.struct(F.col("state").alias("state"), F.array(row(F.lit(1), F.col("state"))).alias("out"))

    def next_(a: Column, r: Column) -> Column:
        grown = let(update(a.state, r.value).cast(kind), lambda s: F.struct(s.alias("state"), F.concat(a.out, F.array(row(r.step, s))).alias("out")))
        return F.when(r.step == F.size(a.out) + 1, grown).otherwise(a)

    folded = met.select(user, F.aggregate("_rows", start, next_, lambda a: a.out).alias("_out"))
    return folded.select(user, F.inline("_out")).withColumnRenamed("step", step)


class Waves:
    """What the waves of a fold write: a table with a folder a wave, of which a wave reads the one before and the end all."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.schema = spark, shared(spark), None

    def put(self, n: int, rows: DataFrame) -> DataFrame:
        path = f"{self.root}/_wave={n}"
        rows.write.parquet(path)
        self.schema = rows.schema
        return self.spark.read.schema(rows.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.root).select(*self.schema.names)


def by_wave(rows: DataFrame, wave: str) -> DataFrame:
    """rows as a table with a folder for each value of wave, so that a wave's filter reads its own rows alone."""
    path = shared(rows.sparkSession)
    rows.repartition(wave, F.pmod(F.xxhash64(*rows.columns), F.lit(16))).write.partitionBy(wave).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def update_states(
    extracted: DataFrame, seed: DataFrame, user: str, step: str, value: str, prompt: Callable[[Column, Column], Column], call: Caller,
    valid: Callable[[Column], Column], parse: Callable[[Column], Column], attempts: int = 2, fallback: Callable[[Column, Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """States by a model's updates, session after session, and the failures.

    State n takes state n - 1, session n's extraction and a call for both, tried until its answer is valid. A session
    whose answers all fail freezes its user, or, with a fallback, has the fallback's state. extracted: (user, step,
    value); seed: (user, state) at step 1. Returns (user, step, state, source) and (user, step, attempts, response).
    """
    spark, steps = extracted.sparkSession, longest(extracted, step)
    extracted = by_wave(extracted.select(user, step, value), step)
    made, lost = Waves(spark), Waves(spark)
    state = made.put(1, seed.select(user, F.lit(1).alias(step), "state", F.lit("seed").alias("source")))
    lost.put(1, state.filter("false").select(user, step, F.lit(0).alias("attempts"), F.lit("").alias("response")))
    for n in range(2, steps + 1):
        rows = extracted.filter(F.col(step) == n).select(user, F.col(value).alias("_v"))
        asked = state.select(user, "state").join(rows, user).withColumn("prompt", prompt(F.col("state"), F.col("_v")))
        tried = retry_until_valid(written(asked), "prompt", call, valid, attempts)
        good = tried.filter("is_valid").select(user, F.lit(n).alias(step), parse(F.col("response")).alias("state"), F.lit("updated").alias("source"))
        bad = tried.filter("not is_valid")
        if fallback is not None:
            good = good.unionByName(bad.select(user, F.lit(n).alias(step), fallback(F.col("state"), F.col("_v")).alias("state"), F.lit("fallback").alias("source")))
        lost.put(n, bad.select(user, F.lit(n).alias(step), "attempts", "response"))
        state = made.put(n, good)
        if state.isEmpty():
            break
    return made.all(), lost.all()


def until_done(work: DataFrame, run: Callable[[DataFrame, int], tuple[DataFrame, DataFrame]], rounds: int = 2, allow_pending: bool = False) -> DataFrame:
    """A run over work and up to `rounds` retries of what failed: run(rows, round) gives done rows and failed ones, the
    latter as rows to run again. Failures that are left are an error unless allowed."""
    done, left = run(work, 0)
    for k in range(1, rounds + 1):
        if left.isEmpty():
            break
        more, left = run(left, k)
        done = done.unionByName(more)
    if not allow_pending and (n := left.count()):
        raise ValueError(f"{n} rows are still pending")
    return done


def fold_dialogues(sessions: DataFrame, seed: DataFrame, user: str, step: str, generate: Caller, extract: Caller, update: Caller) -> DataFrame:
    """Dialogues of users' sessions, each with the state that the sessions before left.

    sessions: (user, step, prompt), the session's part of the prompt; seed: (user, persona), a JSON list. The state is
    the persona, the list of episodes and the last session's outcomes, of which accepted ones are shown. A session takes
    three calls: the dialogue, what it tells of persona and memory, and the persona brought up to date (which stays as it
    was where the answer names none). A user whose generating call gives no JSON object drops out with all sessions.
    Returns (user, step, persona, extracted, updated, episodes, strategy, dialogue).
    """
    turn = F.row_number().over(Window.partitionBy(user).orderBy(step))
    ranked = by_wave(sessions.join(seed.select(user), user, "left_semi").select(user, step, "prompt", turn.alias("_n")), "_n")
    waves = Waves(sessions.sparkSession)
    empty = F.array().cast("array<string>")
    state = written(seed.select(user, "persona", empty.alias("episodes"), F.lit("[]").alias("outcomes")))
    lost = None
    field = lambda path: F.get_json_object("response", path)
    outcome = "array<struct<item: string, reaction: string, reason: string>>"
    for n in range(1, longest(ranked, "_n") + 1):
        rows = ranked.filter(F.col("_n") == n).drop("_n").withColumnRenamed("prompt", "_told").join(state, user)
        accepted = F.to_json(F.filter(F.from_json("outcomes", outcome), lambda o: o.reaction == "Accept"))
        asked = rows.withColumn("prompt", F.concat_ws(" | ", "_told", "persona", F.to_json("episodes"), accepted))
        made = call_model(asked, "prompt", generate)
        is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("response")).startswith("OBJECT"), F.lit(False))
        made = written(made.withColumn("_ok", is_object).withColumn("dialogue", field("$.Dialogue")).withColumn("strategy", F.coalesce(field("$['Dialogue Design Strategy']"), F.lit(""))).drop("response", "prompt"))
        gone = made.filter("not _ok").select(user)
        lost = gone if lost is None else lost.unionByName(gone)
        told = call_model(made.filter("_ok").withColumn("prompt", F.concat_ws(" | ", F.lit("extract"), F.coalesce("dialogue", F.lit("[]")))), "prompt", extract)
        told = told.withColumn("extracted", F.coalesce(field("$.dialogue_persona"), F.lit("[]"))).withColumn("_event", field("$.memory.session_event"))
        told = told.withColumn("_outcomes", F.coalesce(field("$.memory.recommendation_outcomes"), F.lit("[]"))).drop("response", "prompt")
        kept = call_model(told.withColumn("prompt", F.concat_ws(" | ", F.lit("update"), "persona", "extracted")), "prompt", update)
        kept = written(kept.withColumn("updated", F.coalesce(field("$.updated_dialogue_persona"), "persona")).drop("response", "prompt"))
        waves.put(n, kept.select(user, step, "persona", "extracted", "updated", "episodes", "strategy", "dialogue"))
        grown = F.when(F.coalesce(F.col("_event"), F.lit("")) != "", F.concat("episodes", F.array("_event"))).otherwise(F.col("episodes"))
        # a user without a session in this wave has none in later ones either
        state = kept.select(user, F.col("updated").alias("persona"), grown.alias("episodes"), F.col("_outcomes").alias("outcomes"))
    if lost is None:
        raise ValueError("no sessions")
    return waves.all().join(lost.distinct(), user, "left_anti")


def chain_events(sessions: DataFrame, user: str, step: str, item: str, generate: Caller, select: Caller) -> DataFrame:
    """Waves of event texts, wave n for the n-th session of every user that has one.

    Each session takes two calls: the first proposes candidates, the second selects among them; its refined_event, or
    NO_EVENT where it gives none, is the event. From the second wave on both prompts hold the user's events so far and
    the last one. Each call's answers are a table.
    """
    turn = F.row_number().over(Window.partitionBy(user).orderBy(step))
    ranked = by_wave(sessions.select(user, step, F.col(item).cast("string").alias("_item"), turn.alias("_n")), "_n")
    waves, previous = Waves(sessions.sparkSession), None
    for n in range(1, longest(ranked, "_n") + 1):
        rows = ranked.filter(F.col("_n") == n)
        if previous is None:
            asked = rows.withColumn("events", F.array().cast("array<string>"))
            told = F.concat_ws(" | ", F.lit("initial"), "_item")
        else:
            asked = rows.join(previous, user)
            told = F.concat_ws(" | ", F.lit("next"), "_item", F.to_json("events"), F.element_at("events", -1))
        proposed = written(call_model(asked.withColumn("_told", told), "_told", generate).withColumnRenamed("response", "_candidates"))
        choice = proposed.withColumn("prompt", F.concat_ws(" | ", F.lit("select"), "_told", "_candidates"))
        event = F.coalesce(F.get_json_object("response", "$.refined_event"), F.lit(NO_EVENT))
        chosen = call_model(choice, "prompt", select).withColumn("event", event)
        previous = waves.put(n, chosen.select(user, step, "event", F.concat("events", F.array("event")).alias("events"))).select(user, "events")
    return ranked.select(user, step, F.col("_item").alias("event")).limit(0) if previous is None else waves.all().select(user, step, "event")


def resume_state(log: DataFrame, user: str, step: str) -> DataFrame:
    """Each user's last done step and state from an append-only log."""
    return log.groupBy(user).agg(F.max_by("state", step).alias("state"), F.max(step).alias(step))
