"""Importance resampling beside brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import oracle
import pytest

from weftline.llm import resample
from weftline.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, key string, bucket long, rank int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute(docs, targets, percent=25, least=20, seed=7):
    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in targets for f in features(x)[1])
    ws, wt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (ws + 10_000)) / ((s[b] + 1) * (wt + 10_000))))
    out, able = [], []
    for k, (i, text) in enumerate(docs):
        w, f = features(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if len(w) >= least:
            able.append(k)
    able.sort(key=lambda k: (-out[k][3], out[k][0] is not None, out[k][0]))
    for rank, k in enumerate(able[: percent * len(able) // 100], 1):
        out[k][4] = rank
    return sorted(map(tuple, out), key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


TEXTS = [None, "", "  \n", "One", "A a A", "é É ÄB\x85c\xa0d x-1_2", "words " * 30, "the cat of the house " * 8, "ｆｕｌｌ 一二 三四 " * 12, "a\x00b\x7fc"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "k", 1, 2) for i, t in enumerate(TEXTS * 6)] + [(None, "no key " * 12, "k", 1, 2), (3, "One", "k", 1, 2), (90, "v" * 300_000 + " tail " * 30, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def check(spark, docs, targets, **how):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(resample.resample(docs, frame, **how)) == brute(rows, targets, **how)


def test_resample(spark, docs):
    check(spark, docs, ["the cat", "full of words", None, "一二"])


def test_other_shares_and_seeds(spark, docs):
    check(spark, docs, ["house " * 5], percent=100, least=1, seed=3)
    check(spark, docs, [], percent=0)


def test_long_texts_come_in_parts(spark, docs, monkeypatch):
    texts = ["a b c d e f g " * 5, "", None, "x", "a b", "b a " * 9]
    want = [sorted(map(bucket, features(t)[1])) for t in texts]
    for most in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(resample, "WORDS", most)
        n, got = resample.features(texts)
        assert n == [len(features(t)[0]) for t in texts]
        assert [sorted(np.frombuffer(x, "<u2").tolist()) for x in got] == want


def test_drawn(spark, docs):
    target = spark.createDataFrame([("the cat",)], "text string")
    own = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    ranked = resample.resample(own, target).filter("rank is not null").count()
    got = resample.drawn(own, target)
    assert got.columns == own.columns and got.count() == ranked > 0


def test_none(spark, docs):
    target = spark.createDataFrame([("the cat",)], "text string")
    assert resample.resample(docs.limit(0), target).count() == 0


@pytest.mark.parametrize("size", ["sf0.001"])
def test_query(spark, size):
    sf = f"/root/testdata/{size}"
    df = QUERIES["op11_importance_resampling"](spark, sf)
    assert oracle.differences(df, ORACLES["op11_importance_resampling"], oracle.views(sf)) == []
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    targets = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert rows_of(df) == brute(docs, targets)
