"""The exact kNN join beside all pairs, and what it ships."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import neighbours as N


def brute(keys, v, k):
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    d = np.round(1 - u @ u.T, N.DIGITS)
    np.fill_diagonal(d, np.inf)
    out = []
    for i, row in enumerate(d):
        order = np.lexsort((keys, row))[: min(k, len(row) - 1)]
        out += [(int(keys[i]), r, int(keys[j]), float(row[j])) for r, j in enumerate(order, 1)]
    return sorted(out)


def frame(spark, keys, v):
    return spark.createDataFrame([(int(i), list(map(float, x)), "x", 1) for i, x in zip(keys, v)], "id long, v array<double>, cell string, bundle int").repartition(3)


def made(kind, n):
    r = np.random.default_rng(n)
    if kind == "uniform":
        return r.normal(size=(n, 3))
    v = np.repeat(r.normal(size=(n // 50, 16)), 50, 0) + 0.1 * r.normal(size=(n, 16))
    if kind == "copies":  # a third are one vector, many are zero, some others' multiples
        v[: n // 3] = v[0]
        v[n // 3 : n // 3 + 30] = 0
        v[-20:] = 3 * v[-40:-20]
    return v


@pytest.mark.parametrize("kind", ["uniform", "clustered", "copies"])
@pytest.mark.parametrize("block", [64, 2048])
def test_nearest(spark, monkeypatch, kind, block):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "CELL", 16)
    v = made(kind, 600)
    keys = np.random.default_rng(1).permutation(10_000)[: len(v)] - 500
    got = N.nearest(frame(spark, keys, v), 4, "id", "v").collect()
    got, want = sorted((g.query, g["rank"], g.neighbour, g.distance) for g in got), brute(keys, v, 4)
    assert [(a, b) for a, b in zip(got, want) if a != b] == [] and len(got) == len(want)


@pytest.mark.parametrize("kind", ["uniform", "clustered"])
def test_bounds_ship_less_than_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(N, "BLOCK", 64)
    monkeypatch.setattr(N, "CELL", 16)
    v = made(kind, 2000)
    own, _ = N.classes(frame(spark, np.arange(len(v)), v), 3, "id", "v")
    celled, cells = N.layout(own)
    sent = N.reach(celled, cells, 3).select(F.explode("bundles")).count()
    assert sent < 0.4 * len(v) * len(v) / 64


def test_few_and_none(spark):
    v = np.eye(3)
    got = N.nearest(frame(spark, [5, 6, 7], v), 4, "id", "v").collect()
    assert sorted((g.query, g["rank"], g.neighbour) for g in got) == [(5, 1, 6), (5, 2, 7), (6, 1, 5), (6, 2, 7), (7, 1, 5), (7, 2, 6)]
    assert N.nearest(frame(spark, [1], v[:1]), 2, "id", "v").count() == 0
    empty = spark.createDataFrame([(None, [1.0]), (3, None)], "id long, v array<double>")
    assert N.nearest(empty, 2, "id", "v").count() == 0


def test_blocks_travel_packed(spark, monkeypatch):
    """Vectors that nothing can be pruned of: a block is sent once a group of queries, not once a query; results are exact."""
    monkeypatch.setattr(N, "BLOCK", 64)
    monkeypatch.setattr(N, "CELL", 16)
    monkeypatch.setattr(N, "SIDES", 3)
    monkeypatch.setattr(N, "ROW_BYTES", 4096)  # more than one row a block
    monkeypatch.setattr(N, "_ROWS", 2)
    v = np.random.default_rng(3).normal(size=(1000, 16))
    rows = frame(spark, np.arange(len(v)), v)
    celled, cells = N.layout(N.classes(rows, 3, "id", "v")[0])
    packed = N.blocks(celled, cells, 3)
    span, parts = N.sides(int(cells.parts.sum()), 1)
    sent = N.meetings(packed, span, parts).select(F.sum(F.length("ids") / 8)).first()[0]
    one_by_one = N.reach(celled, cells, 3).select(F.explode("bundles")).count()
    assert sent <= 7 * len(v) < one_by_one
    got = N.nearest(rows, 3, "id", "v").collect()
    assert sorted((g.query, g["rank"], g.neighbour, g.distance) for g in got) == brute(np.arange(len(v)), v, 3)


def test_near_copies_in_doubt(spark, monkeypatch):
    """Distances that single precision cannot tell apart."""
    monkeypatch.setattr(N, "BLOCK", 64)
    monkeypatch.setattr(N, "CELL", 16)
    monkeypatch.setattr(N, "_DOUBTS", 100)
    r = np.random.default_rng(4)
    v = np.repeat(r.normal(size=(3, 24)), 100, 0) + 3e-5 * r.normal(size=(300, 24))
    got = N.nearest(frame(spark, np.arange(300), v), 5, "id", "v").collect()
    assert sorted((g.query, g["rank"], g.neighbour, g.distance) for g in got) == brute(np.arange(300), v, 5)


def shuffled(spark, run):
    """Bytes that all stages of run shuffle."""
    sc = spark.sparkContext

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_shuffled_bytes_grow_as_the_vectors(spark, monkeypatch):
    """Twice the vectors, of which nothing can be pruned, shuffle about twice the bytes and not four times."""
    monkeypatch.setattr(N, "BLOCK", 32)
    monkeypatch.setattr(N, "CELL", 16)
    monkeypatch.setattr(N, "SIDES", 3)
    v = np.random.default_rng(5).normal(size=(2400, 32))
    small, large = (shuffled(spark, lambda n=n: N.nearest(frame(spark, np.arange(n), v[:n]), 3, "id", "v").collect()) for n in (1200, 2400))
    assert small > 0 and large < 2.4 * small, (small, large)


def test_queries_pass_rows_over_that_lie_beyond_their_radius():
    """What lies between two cells on their pivots' line spares more than the plane between the pivots, and loses no neighbour."""
    v = N.shape(np.random.default_rng(6).integers(0, 16, size=(6000, 6)).astype(float))
    pivots = v[:200]
    far = N.to_pivots(v, pivots)
    cell = far.argmin(1)
    members = [np.flatnonzero(cell == c) for c in range(200)]
    n = np.array([len(m) for m in members])
    low, high = (np.array([f(far[m, c]) for c, m in enumerate(members)]) for f in (np.min, np.max))
    cells = N.Cells(pivots, low, high, n, np.arange(200), np.ones(200, np.int64))
    near = 1 - v[:, :-1] @ v[:, :-1].T
    radius = np.partition(near, 4, axis=1)[:, 4]
    rows = [dict(cell=c, ids=m.tobytes(), v=v[m].tobytes(), radius=radius[m].tobytes(), toward=cells.toward(v[m], c).tobytes()) for c, m in enumerate(members)]
    asked, own = N._Asked(rows, cells, 4), np.concatenate(members)
    planes, lines = (cells.reached(far, cell, radius) * n).sum(), 0
    for c, m in enumerate(members):
        reaching = own[asked.reaching(c, np.frombuffer(rows[c]["toward"], np.float32))]
        assert not set(np.flatnonzero((near[:, m] <= radius[:, None]).any(axis=1))) - set(reaching)
        lines += len(reaching) * len(m)
    assert lines < 0.8 * planes, (lines, planes)
