"""The commit log and the keyed store."""

import threading

import pytest
from pyspark.sql import functions as F

from weftline.sources.store import KeyStore
from weftline.sources.versions import Conflict, Versions


def numbers(spark, *n):
    return spark.createDataFrame([(i,) for i in n], "n int").coalesce(1)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_snapshots_and_appends(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "t"))
    assert v.snapshot("n int").count() == 0
    assert [v.commit(numbers(spark, 1, 2)), v.commit(numbers(spark, 3), append=True), v.commit(numbers(spark, 9))] == [1, 2, 3]
    assert [rows_of(v.snapshot("n int", k)) for k in (1, 2, 3)] == [[(1,), (2,)], [(1,), (2,), (3,)], [(9,)]]
    with pytest.raises(ValueError, match="no version 7"):
        v.snapshot("n int", 7)


def test_two_writers_at_once(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "t"))
    folders, seen, gate = [v.stage(numbers(spark, k)) for k in range(6)], [], threading.Barrier(6)

    def write(folder):
        own = Versions(spark, str(tmp_path / "t"))
        gate.wait()
        seen.append(own.publish(folder, append=True))

    threads = [threading.Thread(target=write, args=(f,)) for f in folders]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(seen) == v.list() == [1, 2, 3, 4, 5, 6]
    assert rows_of(v.snapshot("n int")) == [(k,) for k in range(6)]


def test_lost_race_and_crash(spark, tmp_path, monkeypatch):
    v = Versions(spark, str(tmp_path / "t"))
    v.commit(numbers(spark, 1))
    with pytest.raises(Conflict):
        v.commit(numbers(spark, 2), base=0)
    # another writer takes the version between the read of the log and the claim
    claim, other = v._claim, Versions(spark, str(tmp_path / "t"))

    def late(entry):
        monkeypatch.setattr(v, "_claim", claim)
        other.commit(numbers(spark, 5), append=True)
        return claim(entry)

    monkeypatch.setattr(v, "_claim", late)
    assert v.commit(numbers(spark, 6), append=True) == 3
    assert rows_of(v.snapshot("n int")) == [(1,), (5,), (6,)]
    # a writer that ends before its claim
    monkeypatch.setattr(v, "_claim", lambda entry: (_ for _ in ()).throw(RuntimeError("gone")))
    with pytest.raises(RuntimeError):
        v.commit(numbers(spark, 7))
    monkeypatch.setattr(v, "_claim", claim)
    assert v.list() == [1, 2, 3] and rows_of(v.snapshot("n int")) == [(1,), (5,), (6,)]
    assert len(v.vacuum(keep=1)) == 2  # what was refused, and what was left staged
    assert v.list() == [3] and rows_of(v.snapshot("n int")) == [(1,), (5,), (6,)]
    assert v.commit(numbers(spark, 8)) == 4


SCHEMA = "user long, step int, state string, extra double"


def put(spark, store, rows):
    store.put(spark.createDataFrame([(*r, None) for r in rows], SCHEMA))


def made(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path / "s"), SCHEMA, "user", "step", 4)
    put(spark, store, [(u, n, f"{u}.{n}") for u in range(20) for n in range(1, 4)])
    put(spark, store, [(u, 4, f"{u}.4") for u in range(0, 20, 2)])
    put(spark, store, [(u, 2, f"{u}.2 again") for u in range(0, 20, 5)] + [(None, 1, "no key")])
    want = {(u, n): f"{u}.{n}" for u in range(20) for n in range(1, 4)} | {(u, 4): f"{u}.4" for u in range(0, 20, 2)} | {(u, 2): f"{u}.2 again" for u in range(0, 20, 5)} | {(None, 1): "no key"}
    return store, want


def steps_of(df):
    return {(r.user, r.step): r.state for r in df.collect()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_store(spark, tmp_path):
    store, want = made(spark, tmp_path)
    last = {u: max((n, s) for (v, n), s in want.items() if v == u) for u in {u for u, _ in want}}
    again = KeyStore(spark, str(tmp_path / "s"), SCHEMA, "user", "step", 4)  # another session's view
    for s in (store, again):
        assert steps_of(s.steps()) == want
        assert {r.user: (r.step, r.state) for r in s.latest().collect()} == last
        assert {r.user: (r.step, r.state) for r in s.lookup(4, 5, 77).collect()} == {u: last[u] for u in (4, 5)}
    old = store.folder
    store.compact()
    assert store.folder != old and store.rows().count() == len(want) and steps_of(store.steps()) == want
    put(spark, store, [(3, 9, "later")])
    assert steps_of(store.lookup(3)) == {(3, 9): "later"}
    store.compact(steps=False)
    assert {r.user: (r.step, r.state) for r in store.rows().collect()} == last | {3: (9, "later")}


def test_store_reads_without_exchange(spark, tmp_path):
    store, want = made(spark, tmp_path)
    other = KeyStore(spark, str(tmp_path / "o"), SCHEMA, "user", "step", 4)
    put(spark, other, [(u, n, f"now {u}.{n}") for u in range(0, 20, 3) for n in range(1, 5)])
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = store.beside(other)
        for df in (store.latest(), store.steps(), met):
            assert "Exchange" not in plan(df)
        got = {(r.key, r.step): (r.before.state, r.now.state) for r in met.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert got == {(u, n): (want[u, n - 1], f"now {u}.{n}") for u in range(0, 20, 3) for n in range(2, 5)}
    assert "SelectedBucketsCount: 1 out of 4" in plan(store.lookup(7))


def test_crash_in_compaction(spark, tmp_path, monkeypatch):
    store, want = made(spark, tmp_path)
    monkeypatch.setattr(store.log, "_claim", lambda entry: (_ for _ in ()).throw(RuntimeError("gone")))
    with pytest.raises(RuntimeError):
        store.compact()
    assert steps_of(KeyStore(spark, str(tmp_path / "s"), SCHEMA, "user", "step", 4).steps()) == want
    assert store.rows().filter(F.col("_run") > 3).count() == 0
