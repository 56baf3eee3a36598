"""Streamed folds: order, gaps, frozen users, restarts."""

import random
import sys

import pytest
from pyspark import cloudpickle

from weftline.streaming import state_fold as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not see this file

SESSIONS = [(u, n, f"v{u}{n}") for u in range(6) for n in range(1, 5)] + [(7, 2, "no first"), (8, 1, "a"), (8, 3, "behind a gap"), (9, 1, None)]


def call(prompts, attempt):
    return [f"{p}/{attempt}" for p in prompts]


def fold(fallback=None):
    """User 2's third session fails for good, user 3's second takes a second attempt."""
    valid = lambda a, k: not a.startswith("v21>v22>v23") and not (a.startswith("v31>v32") and k == 0)
    return S.SessionFold(lambda s, v: f"{s.split('/')[0]}>{v}", call, valid, lambda a: a, 2, fallback)


def literal(sessions, fallback=None):
    f, out = fold(fallback), []
    for u in sorted({s[0] for s in sessions}):
        own, n, state = {s[1]: s[2] for s in sessions if s[0] == u}, 1, None
        while n in own:
            state, source, tried = f._next(n - 1, state, own[n])
            out.append((u, n, state, source, tried))
            if source == "failed":
                break
            n += 1
    return sorted(out, key=repr)


def put(spark, rows, path):
    spark.createDataFrame(rows, S.SESSIONS).repartition(2).write.mode("append").parquet(path)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("user_id", "step", "state", "source", "attempts").collect()), key=repr)


@pytest.mark.parametrize("fallback", [None, lambda s, v: f"{s}+{v}"])
def test_two_runs_give_the_same_as_one(spark, tmp_path, fallback):
    rows = SESSIONS[:]
    random.Random(4).shuffle(rows)
    at = str(tmp_path)
    put(spark, rows[:13], f"{at}/in")
    S.run_fold(spark, f"{at}/in", f"{at}/run", fold(fallback), files_per_trigger=1)
    put(spark, rows[13:] + rows[:3], f"{at}/in")  # some come again
    out = S.run_fold(spark, f"{at}/in", f"{at}/run", fold(fallback))
    assert rows_of(out) == literal(SESSIONS, fallback)
    again = S.run_fold(spark, f"{at}/in", f"{at}/run", fold(fallback))  # nothing new
    assert rows_of(again) == literal(SESSIONS, fallback)


def test_a_failed_trigger_goes_again(spark, tmp_path):
    at, flag = str(tmp_path), tmp_path / "broken"
    flag.write_text("")

    def breaks(prompts, attempt):
        if flag.exists() and any("v53" in p for p in prompts):
            raise RuntimeError("the model is away")
        return call(prompts, attempt)

    put(spark, SESSIONS, f"{at}/in")
    f = fold()
    f.call = breaks
    with pytest.raises(Exception, match="model is away"):
        S.run_fold(spark, f"{at}/in", f"{at}/run", f)
    flag.unlink()
    assert rows_of(S.run_fold(spark, f"{at}/in", f"{at}/run", f)) == literal(SESSIONS)


def test_from_a_log(spark, tmp_path):
    at = str(tmp_path)
    put(spark, [s for s in SESSIONS if s[1] <= 2], f"{at}/first")
    one = S.run_fold(spark, f"{at}/first", f"{at}/one", fold())
    put(spark, [s for s in SESSIONS if s[1] > 2], f"{at}/later")
    two = S.run_fold(spark, f"{at}/later", f"{at}/two", fold(), S.last_states(one))
    assert rows_of(one.unionByName(two)) == literal(SESSIONS)
