"""Per-user folds of model-made states as a stream: state lives in Spark's state store, so that a run goes on where the last
one stopped and each extraction is read once.

Sessions may come in any order and over many triggers: what is early waits in the user's map of later sessions until the
one before it is done. A user's work is their own task's; users are spread by the state store's partitions.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftline.operators.folds import Caller

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SESSIONS = "user_id long, step int, value string"
STATES = "user_id long, step int, state string, source string, attempts int"


class SessionFold(StatefulProcessor):
    """State 1 is session 1's value, or the log's last state where the run starts from a log; state n takes state n - 1,
    session n's value and a call for both, tried until its answer is valid.

    A session whose answers all fail freezes its user, or, with a fallback, has the fallback's state. Sessions that the
    state has passed, and repeats of a session that waits, are left out.
    """

    def __init__(self, prompt: Callable[[str, str], str], call: Caller, valid: Callable[[str, int], bool], parse: Callable[[str], str], attempts: int = 2, fallback: Callable[[str, str], str] | None = None) -> None:
        self.prompt, self.call, self.valid, self.parse, self.attempts, self.fallback = prompt, call, valid, parse, attempts, fallback

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "step int, state string, frozen boolean")
        self.later = handle.getMapState("later", "step int", "value string")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.now.update((initialState.step, initialState.state, False))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        user = key[0]
        if self.now.exists():
            step, state, frozen = self.now.get()
        else:
            step, state, frozen = 0, None, False
        for r in rows:
            if r.step is not None and r.step > step and not frozen and not self.later.containsKey((r.step,)):
                self.later.updateValue((r.step,), (r.value,))
        while not frozen and self.later.containsKey((step + 1,)):
            value = self.later.getValue((step + 1,))[0]
            self.later.removeKey((step + 1,))
            made, source, tried = self._next(step, state, value)
            frozen = source == "failed"
            yield Row(user_id=user, step=step + 1, state=made, source=source, attempts=tried)
            if not frozen:
                step, state = step + 1, made
        if frozen:
            self.later.clear()
        self.now.update((step, state, frozen))

    def _next(self, step: int, state: str | None, value: str | None) -> tuple[str | None, str, int]:
        if not step:
            return value, "seed", 0
        prompt, answer = self.prompt(state, value), ""
        for k in range(self.attempts):
            answer = self.call([prompt], k)[0]
            if self.valid(answer, k):
                return self.parse(answer), "updated", k + 1
        if self.fallback is not None:
            return self.fallback(state, value), "fallback", self.attempts
        return answer, "failed", self.attempts

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession):
    """The session with the state store that this kind of state needs."""
    held = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if held is None else spark.conf.set(_PROVIDER, held)


def fold_stream(sessions: DataFrame, fold: SessionFold, log: DataFrame | None = None) -> DataFrame:
    """A stream of (user_id, step, value) to one of STATES; log: (user_id, step, state), a row per user with their last."""
    start = None if log is None else log.select("user_id", "step", "state").groupBy("user_id")
    return sessions.select("user_id", "step", "value").groupBy("user_id").transformWithState(fold, STATES, "append", "none", start)


def run_fold(spark: SparkSession, extractions: str, root: str, fold: SessionFold, log: DataFrame | None = None, files_per_trigger: int = 4) -> DataFrame:
    """The states of all sessions in the Parquet files under extractions that no run under root has seen, beside those that
    earlier runs made. A trigger that ran half goes again from its checkpoint and writes over its own folder."""
    rows = spark.readStream.schema(SESSIONS).option("maxFilesPerTrigger", files_per_trigger).parquet(extractions)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/states/_batch={number}")

    with rocks(spark):
        out = fold_stream(rows, fold, log).writeStream.foreachBatch(put).outputMode("append")
        out.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(STATES + ", _batch long").parquet(f"{root}/states").drop("_batch")


def last_states(states: DataFrame) -> DataFrame:
    """Each user's last state, to start another run from; frozen users have their last good one."""
    good = states.filter("source <> 'failed'")
    return good.groupBy("user_id").agg(F.max("step").alias("step"), F.max_by("state", "step").alias("state"))


def field(name: str) -> Callable[[str], object]:
    """A JSON answer's field."""
    return lambda answer: json.loads(answer).get(name)
