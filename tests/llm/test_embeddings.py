"""Embedding near-duplicates where tiles are hard: ties, dense groups, odd rows."""

import numpy as np
import pytest

from weftline.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, c long, v int, bin long, d int"


def brute(rows, threshold=0.98):
    ok = [k for k, (_, e, g) in enumerate(rows) if g is not None and e is not None and None not in e and np.isfinite(e).all() and any(e)]
    links = [set() for _ in rows]
    for a, k in enumerate(ok):
        x = np.array(rows[k][1], np.float64)
        for m in ok[a + 1 :]:
            if rows[m][2] == rows[k][2] and len(rows[m][1]) == len(x):
                y = np.array(rows[m][1], np.float64)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[k].add(m)
                    links[m].add(k)
    comp = [None] * len(rows)
    for k in range(len(rows)):
        if comp[k] is None:
            seen, todo = {k}, [k]
            while todo:
                for m in links[todo.pop()] - seen:
                    seen.add(m)
                    todo.append(m)
            ids = [rows[m][0] for m in seen if rows[m][0] is not None]
            for m in seen:
                comp[m] = min(ids, default=None)
    return sorted(((r[0], len(links[k]), comp[k], r[0] == comp[k]) for k, r in enumerate(rows)), key=repr)


def check(spark, rows):
    rows = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], g) for i, e, g in rows]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(3)
    got = sorted(((g.vec_id, g.n_links, g.component_id, g.kept) for g in embeddings.near_duplicates(df).collect()), key=repr)
    assert got == brute(rows)
    return sum(g[1] for g in got)


@pytest.mark.parametrize("tile", [8, 1024])
def test_ties_on_the_second_axis(spark, monkeypatch, tile):
    """One-dimensional and two-dimensional vectors: bins that no range of the second axis parts."""
    monkeypatch.setattr(embeddings, "TILE", tile)
    r = np.random.default_rng(1)
    rows = [(i, [float(x)], 1) for i, x in enumerate(r.uniform(0.5, 2, 150))] + [(200 + i, [1.0, 0.0, float(i % 2) * 0.01 + i * 1e-6], 2) for i in range(100)]
    assert check(spark, rows) > 20_000


def test_dense_group_in_many_tiles(spark, monkeypatch):
    for name, n in (("TILE", 32), ("ROWS", 5), ("COLUMNS", 7)):
        monkeypatch.setattr(embeddings, name, n)
    r = np.random.default_rng(2)
    centre = r.normal(size=12)
    rows = [(i, (centre + 0.05 * r.normal(size=12) * (1 + i % 3)).tolist(), i % 2) for i in range(300)]
    assert check(spark, rows) > 1000


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (1, v, 1), (2, v, 1), (2, [1.0, 2.0, 3.1], 1), (3, v, None), (4, None, 1), (5, [0.0] * 3, 1), (6, [1.0, None, 3.0], 1), (7, [float("nan"), 1.0, 1.0], 1), (8, v[:2], 1), (9, [2.0, 4.0], 1), (10, [], 1), (11, [float("inf"), 1.0, 1.0], 1)]
    check(spark, rows)


def test_block_memory():
    """A pair of tiles that are all near copies holds a block's pairs, not its own."""
    import tracemalloc

    r = np.random.default_rng(0)
    x = r.normal(size=32) + 0.01 * r.normal(size=(1500, 32))
    tracemalloc.start()
    assert sum(len(i) for i, _ in embeddings.near(x, x, np.eye(32), 0.98)) == 1500 * 1500
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()
