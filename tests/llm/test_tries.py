"""Prefix tries beside brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import oracle
import pytest

from weftline.llm import tries
from weftline.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, node string, member long, pos int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            turns[c].append((turn is not None, turn or 0, role, digest, text))
    return {c: [(x[2], x[4]) for x in sorted(t)] for c, t in turns.items()}


def rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute(turns):
    members = defaultdict(list)
    for c, t in turns.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, below = [], {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves = sum(below[k][0] for k in children[node]) or 1
        saved = sum(below[k][1] for k in children[node]) + (len(members[node]) - 1) * words
        below[node] = leaves, saved
        ends = ",".join(str(c) for c in sorted(members[node]) if len(turns[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()), key=repr)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "n", 1, 2) for r in rows], SCHEMA).repartition(parts)


def made(seed, n):
    """Conversations with few turns to choose from: copies, prefixes of one another, families with and without a first."""
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(300), n):
        for turn in range(r.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, r.choice([turn, turn, None]), r.choice(["user", None, ""]), r.choice(["a b", "a  b", "", None, "\x0bx\x85y é"])))
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("ids", [2, 4096])
def test_trie(spark, monkeypatch, seed, ids):
    monkeypatch.setattr(tries, "IDS", ids)
    rows = made(seed, 120) + [(None, 1, "user", "no conversation")]
    turns = sequences(rows)
    df = frame(spark, rows)
    assert rows_of(tries.rebuilt_trie(df)) == sorted(brute(rebuilt(turns)), key=repr)
    assert rows_of(tries.prefix_trie(df)) == sorted(brute(turns), key=repr)


def test_many_copies_and_long_ones(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(1, 2000, 3) for t in range(3)]
    rows += [(5000, t, "user", f"word {t} " * 50) for t in range(500)] + [(5001, t, "user", f"word {t} " * 50) for t in range(500)]
    rows += [(5020, 0, "system", "x" * 200_000)]
    df = frame(spark, rows, 7)
    turns = sequences(rows)
    assert rows_of(tries.prefix_trie(df)) == sorted(brute(turns), key=repr)
    assert rows_of(tries.rebuilt_trie(df)) == sorted(brute(rebuilt(turns)), key=repr)


def test_none_and_turnless(spark):
    assert tries.rebuilt_trie(frame(spark, [(1, 1, "a", "b")]).limit(0)).count() == 0
    lost = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 0)  # its family has no first, its turn goes
    got = rows_of(tries.rebuilt_trie(frame(spark, [(lost, 1, "user", "hello")])))
    assert got == [(lost, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lost).encode()).hexdigest())]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = sorted(brute(rebuilt(sequences(rows))), key=repr)
    assert rows_of(QUERIES["op13_conversation_trie"](spark, sf)) == want
    con = oracle.views(sf)
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op13_conversation_trie']})").fetchall(), key=repr) == want
