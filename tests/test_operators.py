"""Micro-fixtures worked out by hand, and properties against literal folds."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import json as J
from weftline.functions import text as X
from weftline.operators import folds, history, lists, merging, neighbours, personas, ranking, sessions, vectors


def literal_sessions(items):
    """Session sizes of (date, share) items, item by item."""
    out, pending, held, fresh = [], [], [], True
    for date, pct in items:
        pending.append(date)
        if (pct or 0) >= 80:
            held += pending
            pending = []
            if len(held) >= 2:
                out.append(held)
                held = []
    rest = held + pending
    if rest:
        if out:
            out[-1] = out[-1] + rest
        else:
            out = [rest]
    merged = []
    for s in out:
        if merged and merged[-1][-1] == s[-1]:
            merged[-1] = merged[-1] + s
        else:
            merged.append(s)
    return [len(s) for s in merged]


CASES = [
    ([("d1", 90)], [1]),
    ([("d1", 10), ("d1", 20)], [2]),
    ([("d1", 10), ("d2", 90), ("d3", 90), ("d4", 90)], [2, 2]),
    ([("d1", 90), ("d2", 90), ("d3", 90)], [3]),
    ([("d1", 10), ("d1", 90), ("d1", 10), ("d1", 90)], [4]),
    ([("d1", 10), ("d2", 90), ("d3", None), ("d4", 80)], [2, 2]),
]


def sizes(spark, histories):
    rows = [(u, i + 1, d, "w", None if p is None else float(p)) for u, h in enumerate(histories) for i, (d, p) in enumerate(h)]
    df = spark.createDataFrame(rows, "user_id int, pos int, date string, weekday string, watched_pct double")
    got = sessions.summarize_sessions(sessions.sessionize(df)).orderBy("user_id", "session_num").collect()
    return [[r.n_items for r in got if r.user_id == u] for u in range(len(histories))]


def test_sessions_by_hand(spark):
    assert sizes(spark, [c[0] for c in CASES]) == [c[1] for c in CASES]
    assert [literal_sessions(c[0]) for c in CASES] == [c[1] for c in CASES]


def test_sessions_against_fold(spark):
    r = random.Random(5)
    histories = []
    for _ in range(300):
        day, h = 1, []
        for _ in range(r.randint(1, 14)):
            day += r.random() < 0.4
            h.append((f"d{day:02d}", r.choice([None, 10, 85, 90, 79.9, 80])))
        histories.append(h)
    assert sizes(spark, histories) == [literal_sessions(h) for h in histories]


@pytest.mark.parametrize("n,head", [(1, 1), (2, 1), (7, 1), (8, 2), (12, 2), (13, 3), (25, 5)])
def test_head_split(spark, n, head):
    df = spark.createDataFrame([(1, i) for i in range(n)], "user_id int, pos int")
    assert sessions.head_split(df).filter("is_init").count() == head


@pytest.mark.parametrize("rank,recall1,recall5,ndcg5,mrr", [(1, 1, 1, 1, 1), (3, 0, 1, 0.5, 1 / 3), (51, 0, 0, 0, 0)])
def test_metrics(spark, rank, recall1, recall5, ndcg5, mrr):
    m = ranking.metrics(F.col("r"))
    row = spark.createDataFrame([(rank,)], "r int").select(m["recall_1"], m["recall_5"], m["ndcg_5"], m["mrr_50"]).first()
    assert tuple(row) == pytest.approx((recall1, recall5, ndcg5, mrr))


def test_fold_stats(spark):
    df = spark.createDataFrame([(1, 1, [50.0]), (1, 2, [100.0]), (1, 3, []), (1, 4, [None])], "u int, s int, p array<double>")
    got = {r.step: (r.avg, r["var"], r.n) for r in history.fold_stats(df, "u", "s", "p").collect()}
    assert got[2] == (75.0, 625.0, 2) and got[3] == got[2] and got[4] == (50.0, 1666.67, 3)


def test_lists(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["b"])], "l array<string>, r array<string>")
    row = df.select(lists.except_keeping(F.col("l"), F.col("r")).alias("e"), lists.union_in_order(F.col("r"), F.col("l")).alias("u")).first()
    assert row.e == ["a", "a"] and row.u == ["b", "a"]


def test_windows_and_rerank(spark):
    df = spark.createDataFrame([(1, list(range(50)), 25)], "q int, items array<int>, t int")
    w = {r.w: r.window for r in ranking.candidate_windows(df, "items", "t").collect()}
    assert 25 in w[1][:19] and 25 in w[2][:19] and w[0][-1] == 25 and w[3][-1] == 25 and all(len(x) == 20 for x in w.values())
    scored = F.transform("items", lambda i: F.struct(i.alias("item"), i.alias("score")))
    four = [e.item for e in df.select(ranking.rerank(scored, 4).alias("x")).first().x]
    one = [e.item for e in df.select(ranking.rerank(scored, 1).alias("x")).first().x]
    assert four[:10] == list(range(49, 39, -1)) and sorted(four) == list(range(50))
    assert one == [*range(19, -1, -1), *range(20, 50)]


def test_ordered_sources(spark):
    df = spark.createDataFrame([("x", 0, 1, 1), ("x", 1, 2, 2), ("x", 2, 3, 3), ("", 0, 4, 9)], "id string, source_rank int, seq int, v int")
    assert merging.last_wins(df, ["id"], "source_rank", "seq").filter("id = 'x'").first().v == 3
    assert merging.first_wins(df, ["id"], "source_rank", "seq").collect()[0].v == 1
    assert merging.rank_aware(df, ["id"], "source_rank", "seq").filter("id = 'x'").first().replaced == 2
    with pytest.raises(Exception, match="duplicate key"):
        merging.require_unique(df, "id").count()
    with pytest.raises(Exception, match="missing key"):
        merging.strict_join(df, df.filter("id = 'x'"), "id").count()


def test_text(spark):
    row = spark.range(1).select(
        X.clean(F.lit(" NaN ")).alias("a"), X.to_boolean(F.lit("Yes")).alias("b"), X.key_user(F.lit("u_1_7")).alias("c"), X.key_session(F.lit("u_1_7")).alias("d"),
        X.tagged_answer(F.lit("x<answer> c </answer>")).alias("e"), X.tagged_answer(F.lit("<answer>Z</answer>")).alias("f"), X.first_keywords(F.lit("a, b,c,d,e,f")).alias("g"),
        X.without_role(F.lit(" Agent: hi")).alias("h"), X.preferred_title(F.lit("l"), F.lit("o"), F.lit("France, USA")).alias("i"), X.plain_answer(F.lit("A\nB.\n")).alias("j"),
    ).first()
    assert tuple(row) == (None, True, "u_1", "7", "C", None, "a, b, c, d, e", "hi", "o", "B")
    with pytest.raises(Exception, match="placeholders"):
        spark.range(1).select(X.render("[[$A$]] [[$B$]]", {"A": F.lit("x")})).collect()


def test_json():
    good = '{"dialogue_persona": ["a"], "memory": {"episodic_memory": [], "recommendation_outcomes": [{"item": "i", "reaction": "Accept", "reason": "r"}]}}'
    assert J.extracted_errors("dialogue", good) == []
    assert J.extracted_errors("dialogue", good.replace('"i"', "3")) == ["dialogue.memory.recommendation_outcomes[0].item: not a string"]
    assert J.extracted_errors("behavior", "{") == ["behavior: not JSON"] and J.extracted_errors("behavior", None) == ["behavior: not a string"]
    assert J.repair(' {"a": 1} ') == '{"a": 1}' and J.repair('{"a": 1} tail') == '{"a":1}' and J.repair('{"a":{"b":[{"c":1}]}') == '{"a":{"b":[{"c":1}]}}'
    assert J.repair("no") == "no" and J.repair(None) is None


def test_retry_and_cache(spark):
    calls = []
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "prompt string")
    out, cache = folds.cached_calls(df, "prompt", None, folds.offline)
    again, grown = folds.cached_calls(df, "prompt", cache, lambda p, k: (_ for _ in ()).throw(RuntimeError("called")))
    assert out.count() == 3 and cache.count() == 2 and again.filter("response is null").count() == 0 and grown.count() == 2
    tried = folds.retry_until_valid(df, "prompt", folds.offline, lambda r: F.get_json_object(r, "$.attempt") == "1", attempts=3)
    assert {(r.attempts, r.is_valid) for r in tried.collect()} == {(2, True)} and tried.count() == 3
    slow = folds.with_backoff(lambda p, k: calls.append(1) or 1 / 0, attempts=3, sleep=calls.append)
    assert slow(["x"]) == ["{}"] and calls[::2] == [1, 1, 1]
    assert 0.5 <= calls[1] <= 1 and 1 <= calls[3] <= 2  # pauses double, less a share of up to a half


def test_fold_gap_ends_user(spark):
    rows = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 4, 9), (2, 1, 5)], "u int, n int, v int")
    seed = rows.filter("n = 1").select("u", F.col("v").alias("state"))
    got = {(r.u, r.n): r.state for r in folds.fold_sessions(rows, seed, "u", "n", "v", lambda s, v: s + v, 4).collect()}
    assert got == {(1, 1): 1, (2, 1): 5, (1, 2): 3}


def test_fold_reaches_last_session(spark):
    rows = spark.createDataFrame([(1, n, n) for n in range(1, 8)] + [(2, 1, 5), (2, 2, 6), (2, 4, 7)], "u int, n int, v int")
    seed = rows.filter("n = 1").select("u", F.col("v").alias("state"))
    got = {(r.u, r.n): r.state for r in folds.fold_sessions(rows, seed, "u", "n", "v", lambda s, v: s + v).collect()}
    assert got == {(1, n): n * (n + 1) // 2 for n in range(1, 8)} | {(2, 1): 5, (2, 2): 11}


def test_fold_user_state_covers_every_session(spark):
    from itertools import accumulate

    from weftline.plans import catalog

    d, want = "/root/testdata/sf0.001", {}
    for r in sorted(sessions.summarize_sessions(catalog._sessions(spark, d)).collect(), key=lambda r: r.session_num):
        want.setdefault(r.user_id, []).append(r.n_items)
    got = {(r.user_id, r.session_num): r.state for r in catalog.QUERIES["fold_user_state"](spark, d).collect()}
    assert max(map(len, want.values())) > 4
    assert got == {(u, n): s for u, v in want.items() for n, s in enumerate(accumulate(v), 1)}


def literal_events(rows):
    """Event of each (user, session), one call after the other."""
    import json

    out, held = {}, {}
    for u, n, item in sorted(rows):
        events = held.setdefault(u, [])
        told = f"next | {item} | {json.dumps(events, separators=(',', ':'), ensure_ascii=False)} | {events[-1]}" if events else f"initial | {item}"
        candidates = folds.offline([told])[0]
        event = json.loads(folds.offline_choice([f"select | {told} | {candidates}"])[0]).get("refined_event", "No event selected.")
        events.append(event)
        out[u, n] = event
    return out


def test_event_chain_covers_every_session(spark):
    from weftline.plans import catalog

    d = "/root/testdata/sf0.001"
    want = literal_events([(r.user_id, r.session_num, r.date) for r in sessions.summarize_sessions(catalog._sessions(spark, d)).collect()])
    got = catalog.QUERIES["event_chain"](spark, d).collect()
    assert len(got) == len(want) and {(r.user_id, r.session_num): r.event for r in got} == want
    assert max(n for _, n in want) > 3 and "No event selected." in want.values()


def test_event_chain_gaps_and_bad_answers(spark):
    rows = [(1, 1, "a"), (1, 3, "b"), (1, 7, "c"), (2, 2, "d")]
    df = spark.createDataFrame(rows, "u int, n int, v string")
    got = {(r.u, r.n): r.event for r in folds.chain_events(df, "u", "n", "v", folds.offline, folds.offline_choice).collect()}
    assert got == literal_events(rows)
    bad = folds.chain_events(df, "u", "n", "v", folds.offline, lambda p, k: ["no json"] * len(p)).collect()
    assert [r.event for r in bad] == ["No event selected."] * 4
    assert folds.chain_events(df.limit(0), "u", "n", "v", folds.offline, folds.offline_choice).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 0.0])], "id long, v array<double>")
    assert vectors.mean_pairwise_distance(df, "v").first().avg_distance == pytest.approx(2 / 3, abs=1e-6)
    near = {(r["query"], r["rank"]): r.neighbour for r in vectors.nearest(df, 1, "id", "v").collect()}
    assert near[(1, 1)] == 3 and near[(3, 1)] == 1
    row = spark.range(1).select(vectors.find_sequence(F.array(*map(F.lit, [1, 2, 3, 2])), F.array(F.lit(3), F.lit(2))).alias("i")).first()
    assert row.i == 2


def test_merging_errors_and_counters(spark):
    base = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(Exception, match="duplicate key: 1"):
        merging.replace_or_append(base, base.filter("k = 2"), "k").collect()
    nulls = spark.createDataFrame([(None, 1), (3, 2)], "k int, v int")
    assert merging.require_unique(nulls, "k").count() == 2
    with pytest.raises(Exception, match="duplicate key: null"):
        merging.require_unique(nulls.union(nulls.filter("k is null")), "k").collect()
    # lines in the order they are read: rank 1, rank 0 (skipped), rank 1 and 2 (replace)
    rows = spark.createDataFrame([("x", 1, 1, "a"), ("x", 0, 2, "b"), ("x", 1, 3, "c"), ("x", 2, 4, "d"), ("y", 0, 5, "e")], "id string, source_rank int, seq int, v string")
    got = {r.id: (r.v, r.replaced, r.skipped) for r in merging.rank_aware(rows, ["id"], "source_rank", "seq", read="seq").collect()}
    assert got == {"x": ("d", 2, 1), "y": ("e", 0, 0)}
    with pytest.raises(Exception, match="missing key"):
        merging.assigned(rows, spark.createDataFrame([("x", 0)], "id string, shard int"), "id").collect()


def test_empty_and_too_small_inputs(spark):
    none = spark.createDataFrame([], "rank int")
    row = ranking.mean_metrics(none, "rank").first()
    assert row.n == 0 and row.recall_1 == 0.0 and row.mrr_50 == 0.0
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    with pytest.raises(Exception, match="too few vectors"):
        vectors.knn_distance(few, 2, "id", "v").collect()
    with pytest.raises(Exception, match="too few members"):
        vectors.cluster_entropy(spark.createDataFrame([(1,), (1,)], "n int"), "n", 3).collect()
    with pytest.raises(ValueError):
        personas.nonempty_texts(spark.createDataFrame([(" ",), (None,)], "t string"), "t")


def test_nearest_against_all_pairs(spark):
    import numpy as np

    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(90, 3)), 1)
    x[40:50] = x[:10]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    d = np.round(1 - u @ u.T, 9)
    want = {(i, k + 1): j for i in range(90) for k, (_, j) in enumerate(sorted((d[i, j], j) for j in range(90) if j != i)[:4])}
    block = neighbours.BLOCK
    try:
        neighbours.BLOCK = 25
        got = {(g["query"], g["rank"]): g.neighbour for g in vectors.nearest(df, 4, "id", "v").collect()}
    finally:
        neighbours.BLOCK = block
    assert got == want


@pytest.mark.parametrize("said,letter", [("**Answer**: B", "B"), ("final: (B)", "B"), ("Option B", "B"), ("The answer: [B]", "B"), ("answer is c", "C"), ("x Y z", None), ("index-d, b", "D"), ("", None), ("<THINK>A</THINK>e", "E")])
def test_plain_answers(spark, said, letter):
    row = spark.range(1).select(X.plain_answer_at(F.lit(said)).alias("a")).first().a
    assert (row.letter if row else None) == letter and (row is None or said.strip()[row.place].upper() == letter)


def test_repair_by_hand():
    broken = '{"episodic_memory":["a"},"updated_recommendation_history":[{"item":"i"}]}}'
    assert J.repair('{"memory":' + broken) == '{"memory":' + broken.replace('"a"}', '"a"]') and J.repair(broken) == broken
    assert J.repair('["a"] x') == '["a"] x' and J.repair(' "[1]" ') == "[1]" and J.repair("{'a'}") == "{'a'}"


def test_until_done(spark):
    work = spark.createDataFrame([(i,) for i in range(6)], "k int")
    run = lambda rows, n: (rows.filter(F.col("k") <= n), rows.filter(F.col("k") > n))
    assert folds.until_done(work, run, rounds=6).count() == 6 and folds.until_done(work, run, rounds=2, allow_pending=True).count() == 3
    with pytest.raises(ValueError, match="3 rows"):
        folds.until_done(work, run, rounds=2)


def test_failed_calls_and_answers(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "d")], "u int, n int, v string")
    seed = rows.filter("n = 1").select("u", F.col("v").alias("state"))
    bad = folds.with_backoff(lambda p, k: 1 / 0, attempts=2, sleep=lambda s: None)
    valid = lambda r: F.get_json_object(r, "$.code").isNotNull()
    args = ("u", "n", "v", lambda s, v: F.concat_ws("|", s, v), bad, valid, lambda r: F.get_json_object(r, "$.code"), 2)
    states, failed = folds.update_states(rows, seed, *args)
    assert states.count() == 2 and [(r.u, r.n, r.attempts, r.response) for r in failed.collect()] == [(1, 2, 2, "{}")]
    states, _ = folds.update_states(rows, seed, *args, fallback=lambda s, v: F.concat(s, v))
    assert {(r.u, r.n): (r.state, r.source) for r in states.collect()} == {(1, 1): ("a", "seed"), (2, 1): ("d", "seed"), (1, 2): ("ab", "fallback"), (1, 3): ("abc", "fallback")}
    judged = personas.judge(spark.createDataFrame([("u", "t", "p")], "user_id string, dataset_type string, persona string"), {"a": "x", "b": "y"}, lambda p, k: ["oops"] * len(p))
    assert [(r.metric, r.score) for r in judged.orderBy("metric").collect()] == [("a", 0), ("b", 0)]
    with pytest.raises(Exception, match="no personas"):
        spark.range(1).select(personas.sections_of(F.lit('{"behavior_persona":[],"dialogue_persona":[]}'))).collect()


def test_persona_extraction_by_hand(spark):
    names = ["limited", "stats", "content_log", "production_log", "union_log", "usage_log"]
    rows = spark.createDataFrame([tuple(names)], ", ".join(f"{n} string" for n in names))
    asked = []
    answer = lambda p, k=0: [folds.json.dumps({f: f"{f}<{x}>" for s in personas.SECTIONS.values() for f in s.values()}) for x in p]
    p = personas.extract(rows, answer).first().persona
    content, production = (answer([f"{n} | limited | {n}_log"])[0] for n in ("content", "production"))
    assert p.positive_preference.content_material == "positive_content_material<content | limited | content_log>"
    assert p.usage_patterns.immersion_style == "immersion_style<immersion | stats | usage_log>" and p.historical_stats == "stats" and not asked
    assert p.decision_drivers.motivations == f"behavioral_motivation<motives | {content} {production} | limited | union_log>"


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        folds.shared(Session)


def test_training_arithmetic(spark):
    ids = F.array(*[F.lit(i).cast("long") for i in (5, 6, 7, 8)])
    cut, place = vectors.truncate_left(ids, 2, F.lit(3))
    _, gone = vectors.truncate_left(ids, 2, F.lit(1))
    letters = F.array(F.lit(6).cast("long"), F.lit(5).cast("long"))
    seek = lambda *p: vectors.find_sequence(ids, F.array(*[F.lit(i).cast("long") for i in p]))
    row = spark.range(1).select(
        cut.alias("a"), place.alias("b"), gone.alias("c"), vectors.fit_right(ids, 6, 0).alias("d"), seek(9, 6).alias("e"), seek(9, 5).alias("f"), seek(1, 2).alias("g"), seek(7, 8, 9, 1, 2).alias("h"),
        vectors.rank_target(ids, F.lit(1), letters).alias("i"), vectors.rank_target(ids, F.lit(3), letters).alias("j"), vectors.rank_target(ids, F.lit(0), F.array(F.lit(5).cast("long"))).alias("k"),
    ).first()
    assert tuple(row[:8]) == ([7, 8], 1, -1, [5, 6, 7, 8, 0, 0], 0, 0, -1, -1)
    assert tuple(row.i) == (1, 6) and tuple(row.j) == (1, 6) and row.k is None


def test_user_stats_fold_exact_covers_every_session(spark):
    """Beside Python's own rounding, with sums of the shares' decimals, which have no order."""
    from fractions import Fraction

    from weftline.plans import catalog

    d, held = "/root/testdata/sf0.001", {}
    for r in catalog._sessions(spark, d).orderBy("user_id", "pos").collect():
        held.setdefault(r.user_id, {}).setdefault(r.session_num, []).append(Fraction(str(r.watched_pct or 0.0)))
    want = {}
    for user, own in held.items():
        mean, var, n = 0.0, 0.0, 0
        for s in sorted(own):
            x, m = own[s], len(own[s])
            mu, spread = float(sum(x) / m), float(sum(v * v for v in x) / m - (sum(x) / m) ** 2)
            both = (n * mean + m * mu) / (n + m)
            joined = (n * (var + (mean - both) * (mean - both)) + m * (spread + (mu - both) * (mu - both))) / (n + m)
            mean, var, n = round(both, 2), round(joined, 2), n + m
            want[user, s] = (mean, var, n)
    got = {(r.user_id, r.step): (r.avg, r["var"], r.n) for r in catalog.QUERIES["user_stats_fold_exact"](spark, d).collect()}
    assert got == want


def test_round2(spark):
    import random

    from weftline.functions import numbers as N

    r = random.Random(1)
    x = [50.125, 2.675, 1.005, 0.125, 0.375, -0.125, -2.675, 1e9 + 0.125, 0.0, 99.995, float("nan")]
    x += [round(r.uniform(-100, 100), 3) for _ in range(3000)] + [r.randint(0, 100_000) / 8 for _ in range(1000)]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", N.round2(F.col("x")).alias("y")).collect()
    assert all(g.y == round(g.x, 2) for g in got if g.x == g.x) and sum(g.y != g.y for g in got) == 1


def test_initial_stats_round_as_python(spark):
    rows = [(1, 50.0), (1, 50.25), (2, 10.0), (2, None), (3, 0.01)]
    got = {r.u: (r.watched_pct_avg, r.watched_pct_var, r.total_count) for r in history.initial_stats(spark.createDataFrame(rows, "u int, p double"), "u", "p").collect()}
    assert got == {1: (50.12, 0.02, 2), 3: (0.01, 0.0, 1)} and round(50.125, 2) == 50.12


def test_fallback_memory_removes_repeats(spark):
    text = "array<string>"
    row = lambda b, *c: lists.memory(F.lit(b), *[F.lit(None).cast(text) if x is None else F.array(*map(F.lit, x)) for x in c])
    past = row("old", ["a", "b"], ["e", "e"], ["f"], ["h"], None)
    new = row("new", ["b", "c"], ["e", "e"], None, ["g", "h"], ["o", "o"])
    m = spark.range(1).select(lists.fallback_memory(past, new).alias("m")).first().m
    assert (m.behavior, m.dialogue, m.events, m.outcomes) == ("old", ["a", "b", "c"], ["e", "f"], ["h", "g", "o"])
    m = spark.range(1).select(lists.fallback_memory(row(None, None, None, None, None, None), new).alias("m")).first().m
    assert (m.behavior, m.dialogue, m.events) == ("new", ["b", "c"], ["e"])


def test_shards_number_without_gaps(spark):
    users = spark.range(1000).select((F.col("id") * 7 % 1000).alias("u")).repartition(7)
    got = {r.u: r.shard for r in merging.shards(users.union(users), "u", 6).collect()}
    assert got == {u: u % 6 for u in range(1000)}
