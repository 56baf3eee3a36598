"""k-means, pooled calls, malformed lines, sub-sequence search."""

import random
import sys
import threading
import time

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from weftline.operators import clusters, folds, vectors
from weftline.sources import readers as R

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not see this file


def literal_kmeans(v, k, rounds):
    v = np.array([x / np.linalg.norm(x) if np.linalg.norm(x) else x for x in v])
    c = [v[0]]
    while len(c) < k:
        far = ((v[:, None] - np.array(c)[None]) ** 2).sum(2).min(1)
        if far.max() <= 0:
            break
        c.append(v[int(far.argmax())])
    c = np.array(c)
    for _ in range(rounds):
        own = ((v[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([v[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
    return ((v[:, None] - c[None]) ** 2).sum(2).argmin(1).tolist()


@pytest.mark.parametrize("parts", [1, 5])
def test_kmeans_is_the_same_in_any_order(spark, parts):
    r = np.random.default_rng(4)
    v = np.repeat(r.normal(size=(4, 6)), 30, 0) + 0.2 * r.normal(size=(120, 6))
    v[7] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    random.Random(parts).shuffle(rows)
    df = spark.createDataFrame([*rows, (None, [1.0] * 6), (500, None)], "id long, e array<double>").repartition(parts)
    got = {x.key: x.cluster for x in clusters.kmeans(df, "id", "e", 5, 8).collect()}
    assert [got[i] for i in range(120)] == literal_kmeans(v, 5, 8) and len(got) == 120


def test_kmeans_of_few(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0])], "id long, e array<double>")
    assert {x.key: x.cluster for x in clusters.kmeans(df, "id", "e", 5).collect()} == {1: 0, 2: 0, 3: 1}
    assert clusters.kmeans(df.limit(0), "id", "e", 5).count() == 0


def test_sub_sequences(spark):
    r = random.Random(2)
    rows = []
    for _ in range(300):
        ids = [r.randint(0, r.choice([1, 2, 5])) for _ in range(r.randint(0, 40))]
        rows.append((ids, [r.randint(0, 1) for _ in range(r.randint(0, 6))] if r.random() < 0.5 else ids[5 : 5 + r.randint(1, 9)]))
    rows += [([1, 1, 1, 1, 2], [1, 1, 2]), ([0, 1, 0, 1, 0, 0, 1, 0, 1, 1], [0, 1, 0, 1, 1]), ([], [1]), ([1], [])]

    def literal(ids, part):
        return next((i for i in range(len(ids) - len(part) + 1) if part and ids[i : i + len(part)] == part), None)

    df = spark.createDataFrame(rows, "ids array<long>, part array<long>")
    got = df.select("ids", "part", vectors._find(F.col("ids"), F.col("part")).alias("at")).collect()
    assert [g["at"] for g in got] == [literal(g.ids, g.part) for g in got]


def test_sub_sequence_in_a_long_row(spark):
    """Repetitive ids, on which every place but the last fails late."""
    n, m = 20_000, 300
    df = spark.createDataFrame([([0] * n + [1], [0] * m + [1])], "ids array<long>, part array<long>")
    start = time.time()
    assert df.select(vectors._find(F.col("ids"), F.col("part")).alias("at")).first()["at"] == n - m
    assert time.time() - start < 30


def answer(prompts, attempt=0):
    return [f"<{p}>" for p in prompts]


def test_pooled_calls(spark):
    """Tries, answers that are too long, and calls that never succeed; the bound is tasks times threads."""
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(60)] + [(60, "x" * 500), (61, None)], "id int, prompt string")
    limits = folds.Limits(in_flight=6, per_task=3, tries=3, first=0.001, most_chars=100)
    calls = folds.flaky(answer, lambda p: int(p[1:]) % 5 if p[1:].isdigit() else 0)
    out = folds.pooled_calls(rows, "prompt", calls, limits)
    assert out.rdd.getNumPartitions() == limits.tasks == 2
    got = {r.id: (r.response, r.tries) for r in out.collect()}
    want = {i: (f"<p{i}>", i % 5 + 1) if i % 5 < 3 else ("{}", 3) for i in range(60)}
    assert got == want | {60: ("{}", 1), 61: ("<>", 1)}


def test_calls_in_flight_are_bounded():
    now = peak = 0
    lock = threading.Lock()

    def slow(prompts, attempt=0):
        nonlocal now, peak
        with lock:
            now += 1
            peak = max(peak, now)
        time.sleep(0.02)
        with lock:
            now -= 1
        return prompts

    from concurrent.futures import ThreadPoolExecutor

    limits = folds.Limits(in_flight=4, per_task=4)
    with ThreadPoolExecutor(limits.per_task) as pool:
        assert [x for x, _ in pool.map(lambda p: folds.one_call(slow, p, 0, limits), map(str, range(40)))] == list(map(str, range(40)))
    assert 1 < peak <= 4


def test_pauses_grow_and_differ():
    def fails(prompts, attempt=0):
        raise ConnectionError

    pauses = {p: [] for p in ("a", "b")}
    for p, held in pauses.items():
        assert folds.one_call(fails, p, 0, folds.Limits(tries=8, first=1.0, longest=20.0), held.append) == ("{}", 8)
    for held in pauses.values():
        assert len(held) == 7 and all(min(20, 2**k) / 2 <= x <= min(20, 2**k) for k, x in enumerate(held))
    assert pauses["a"] != pauses["b"]


def test_call_model_comes_to_nothing_by_default(spark, monkeypatch):
    def some(prompts, attempt=0):
        if any("bad" in p for p in prompts):
            raise ConnectionError
        return prompts

    quick = folds.with_backoff
    monkeypatch.setattr(folds, "with_backoff", lambda call: quick(call, 2, 0.001))
    rows = spark.createDataFrame([("ok",), ("bad",), ("fine",)], "p string").coalesce(1)
    assert [r.response for r in folds.call_model(rows, "p", some).collect()] == ["ok", "{}", "fine"]


def test_malformed_lines_have_places(spark, tmp_path):
    lines = [f'{{"k": {i}, "v": "{"x" * (i % 50)}"}}' for i in range(4000)]
    bad = {17: '{"k": 1', 2999: "no json", 4000: '{"k": "x"'}
    for n, text in bad.items():
        lines[n - 1] = text
    lines[100] = "   "
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n')
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        paths = [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")]
        got = R.malformed(spark, paths, "k long, v string").collect()
        assert {(r.path.rsplit("/", 1)[1], r.line, r.text) for r in got} == {("a.jsonl", n, t) for n, t in bad.items()}
        with pytest.raises(ValueError, match=r"a\.jsonl:17: malformed line"):
            R.jsonl_checked(spark, paths, "k long, v string")
        good = R.jsonl_checked(spark, paths[1], "k long, v string")
        assert sorted(r.k for r in good.collect()) == [1, 2]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_partials_merge_once_a_shard(spark, tmp_path):
    from weftline.operators import progress, ranking

    r = random.Random(6)
    rows = [(i, i % 3, r.randint(1, 51), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, part int, rank int, session_idx int")
    root, told = str(tmp_path / "s"), {}
    work = lambda x: progress.partial(x, "rank", "session_idx")
    assert progress.snapshot(work(df.filter("part = 1")), 1, root, groups=F.count(F.lit(1))) == {"groups": 2}
    progress.snapshot(work(df.filter("part = 1")), 1, root)
    out = progress.run_shards(df, "part", 3, root, work, lambda k, m: told.update({k: m["rows"]}))
    assert told == {0: 2, 2: 2} and progress.done_shards(spark, root, 3) == [0, 1, 2]
    got = {x.session_idx: x for x in progress.merge(out, "session_idx").collect()}
    for want in ranking.mean_metrics(df, "rank", "session_idx").collect():
        assert {c: got[want.session_idx][c] for c in want.__fields__} == pytest.approx(want.asDict(), abs=2e-6)
    total = progress.merge(out).first()
    assert total.n == 200
    assert progress.merge(out.filter("false")).first().n == 0


def test_pending_failures_stop_a_merge(spark):
    from weftline.plans import builders

    rows = spark.createDataFrame([("a", 1, 1, 0, 1, "x"), ("a", 1, 1, 1, 0, "y")], "id string, user_id int, session_num int, source_rank int, seq int, v string")
    failures = spark.createDataFrame([(0,), (2,)], "round int")
    with pytest.raises(ValueError, match="1 failures are still pending"):
        builders.merge_extractions(rows, failures)
    assert [r.v for r in builders.merge_extractions(rows, failures, allow_pending=True).collect()] == ["y"]
    assert [r.v for r in builders.merge_extractions(rows, failures.filter("round > 5")).collect()] == ["y"]


def test_spans_of_tokens_per_character(spark):
    r = random.Random(8)
    tokens, spans, want = [], [], {}
    for key in range(40):
        n, at = r.randint(0, 60), 0
        own = sorted(r.sample(range(n + 1), min(n + 1, r.choice([0, 2, 4, 6]))))
        mine = list(zip(own[::2], own[1::2]))
        inside = {c for a, b in mine for c in range(a, b)}
        spans += [(key, a, b) for a, b in mine]
        place = 0
        while at < n:
            to = at + r.choice([0, 1, 1, 2, 5])
            tokens.append((key, place, 100 + place, at, to))
            want[key, place] = 100 + place if inside & set(range(at, to)) else -100
            at, place = to, place + 1
    t = spark.createDataFrame(tokens, "key int, place int, id long, start long, end long")
    s = spark.createDataFrame(spans, "key int, start int, end int")
    assert {(x.key, x.place): x.label for x in vectors.mask_spans(t, s, "key").collect()} == want
    assert {x.label for x in vectors.mask_spans(t, s.limit(0), "key").collect()} == {-100}


def test_chat_spans_hold_the_messages(spark):
    from weftline.functions import text as X

    said = [("system", "be é"), ("assistant", "first 🙂"), ("user", ""), ("assistant", ""), ("assistant", "last")]
    df = spark.createDataFrame([(said,), ([],)], "m array<struct<role: string, content: string>>")
    for family in ("qwen2.5", "llama"):
        got, none = df.select(X.chat_text(F.col("m"), family).alias("t"), X.chat_spans(F.col("m"), family=family).alias("s")).collect()
        assert [got.t[x.start : x.end] for x in got.s] == ["first 🙂", "", "last"] and none.s == []


def test_extraction_merge_orders_lines_as_its_sql(spark, tmp_path):
    """Part keys from 100,000 on outweigh a later source; lines without a place are passed over."""
    import oracle

    from weftline.plans.catalog import ORACLES, QUERIES

    lines = [(1, 250_000, 7, 1), (1, 10, 8, 2), (2, 99_999, 5, 1), (2, 3, 6, 2), (3, None, 4, 2), (3, 5, 3, 1), (4, None, 9, 1), (5, 100_000, 1, 1), (5, 1, 2, 2)]
    spark.createDataFrame([(*r, "A") for r in lines], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 10 * k) for k in range(1, 7)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    out = QUERIES["extraction_merge"](spark, str(tmp_path))
    assert {r.id: r.v for r in out.collect()} == {1: 7, 2: 6, 3: 3, 4: None, 5: 2}
    assert oracle.differences(out, ORACLES["extraction_merge"], oracle.views(str(tmp_path))) == []


def test_a_persona_takes_two_python_workers_a_task(spark):
    """Calls that do not see each other's answers share a pass, and a call holds a bounded number of prompts."""
    from weftline.operators import folds, personas

    names = ["stats", "limited", "content_log", "production_log", "union_log", "usage_log"]
    rows = spark.range(3).select("id", *[F.concat(F.lit(n), F.col("id").cast("string")).alias(n) for n in names])
    made = personas.extract(rows, personas.OFFLINE)
    again = personas.update(made.select("id", F.col("persona").alias("current"), F.col("persona").alias("extracted")), personas.OFFLINE)
    passes = lambda df: df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    assert passes(made) == 2 and passes(again) == 4
    most = lambda prompts, attempt=0: [str(len(prompts))] * len(prompts)
    sizes = folds.call_model(spark.range(2500).coalesce(1).select(F.col("id").cast("string").alias("p")), "p", most).groupBy("response").count().collect()
    assert {r.response: r["count"] for r in sizes} == {"1000": 2000, "500": 500}
