"""Prefix tries of conversations by partition refinement.

All conversations are one class, the root. A round splits every class by its members' next turns; each part is a node,
known by its depth and its smallest member. A part with one member retires: what is left of its turns is a chain of
nodes with one child each. Parts with more go on, until none does; then counts are folded back from the deepest round to
the root. Conversations with equal turns are one member with a weight, so that copies retire together, and rounds are as
many as turns that different conversations share.

Turns are compared by SHA-256 digests of role and text, whole conversations by their length and two sums of 64-bit hashes
of their turns with places, which need no order and combine before they are shuffled; texts are read once and not moved.
Rounds exchange a row per conversation still active. The ids that end at a node go into its digest in ranges: rows of at
most IDS ids are made where the ranges lie, and strung together a node at a time.

Defined results: turns are ordered by turn, null first, then by role and by the digest of role and text; null roles and texts
are empty; repeated turns are turns of their own; rows without a conversation's id belong to none and are left out; a
table without conversations has no nodes, not even a root; extra columns stay out of the results, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, numbered
from weftline.llm.resample import CRC_SQL, crc_sql

#: Ids of one row on their way into a node's digest.
IDS = 4096
#: Conversations that the rebuilding rule takes together, and how many turns of their first it shares out at most.
FAMILY, SHARED = 20, 4
WORD = r"[^\x20\x09-\x0D]+"


def placed_turns(conversations: DataFrame, scratch: Scratch, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, turn, words): each conversation's turns by place from 0, with a digest and the words of its text."""
    c = conversations
    said, body = F.coalesce(c[role].cast("string"), F.lit("")), F.coalesce(c[text].cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(said).cast("string"), F.lit(":"), said, body), 256))
    rows = c.select(
        c[conv].cast("long").alias("conv_id"), c[turn].alias("_turn"), said.alias("_role"), digest.alias("turn"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("words")
    ).filter("conv_id is not null")
    order = [F.asc("conv_id"), F.asc_nulls_first("_turn")]
    at = numbered(rows, order, [F.asc("_role"), F.asc("turn")], scratch)
    first = at.groupBy("conv_id").agg(F.min("_at").alias("_first"))
    return scratch.put(at.join(first, "conv_id").select("conv_id", (F.col("_at") - F.col("_first")).alias("pos"), "turn", "words"))


def rebuild(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Conversations that start like their family's first: (conv_id) and the new turns.

    A conversation c takes the first h turns of conversation c - c % FAMILY, all where there are fewer and none where it
    is absent, and goes on with its own turns after its first h; h is the CRC-32 of c in decimals modulo SHARED.
    """
    c = F.col("conv_id")
    lengths = scratch.put(turns.groupBy("conv_id").agg(F.count("*").alias("length")))
    heads = lengths.select(c.alias("head"), F.col("length").alias("_longest"))
    plan = lengths.select(c, (c - c % FAMILY).alias("head"), (F.crc32(c.cast("string")) % SHARED).alias("h")).join(heads, "head", "left")
    plan = scratch.put(plan.withColumn("taken", F.least("h", F.coalesce("_longest", F.lit(0)))))
    own = turns.join(plan, "conv_id").filter("pos >= h").withColumn("pos", F.expr("pos - h + taken"))
    lent = turns.filter((c % FAMILY == 0) & (F.col("pos") < SHARED - 1)).withColumnRenamed("conv_id", "head").join(plan, "head").filter("pos < taken")
    columns = ["conv_id", "pos", "turn", "words"]
    return plan.select("conv_id"), scratch.put(own.select(*columns).unionByName(lent.select(*columns)))


def _strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (member, id) to rows of at most IDS ids of one member, joined by commas."""
    member, ids = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"member": pa.array([member], pa.int64()), "first": pa.array([ids[0]], pa.int64()), "ids": pa.array([",".join(map(str, ids))])})

    for batch in batches:
        for m, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (m != member or len(ids) == IDS):
                yield row()
                ids = []
            member = m
            ids.append(i)
    if ids:
        yield row()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (member, first, ids) to each member's SHA-256 of all its ids; what is held is the hash."""
    member = state = None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"member": pa.array([member], pa.int64()), "ends": pa.array([state.hexdigest()])})

    for batch in batches:
        for m, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if state is not None and m == member:
                state.update(b",")
            else:
                if state is not None:
                    yield row()
                member, state = m, hashlib.sha256()
            state.update(ids.encode())
    if state is not None:
        yield row()


def _members(ids: DataFrame, turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(member, copies, length, ends): the smallest conversation of each group of equal ones, how many they are, and the
    digest of their ids."""
    place = [F.xxhash64("pos", "turn"), F.xxhash64("turn", "pos", F.lit(1))]
    sums = turns.groupBy("conv_id").agg(F.count("*").alias("length"), *[F.sum(h.cast("decimal(38,0)")).alias(f"s{k}") for k, h in enumerate(place)])
    sums = scratch.put(ids.join(sums, "conv_id", "left").na.fill(0, ["length"]).withColumn("s0", F.coalesce("s0", F.lit(0))).withColumn("s1", F.coalesce("s1", F.lit(0))))
    same = ["length", "s0", "s1"]
    groups = scratch.put(sums.groupBy(*same).agg(F.min("conv_id").alias("member"), F.count("*").alias("copies")))
    ends = sums.join(groups.filter("copies > 1"), same).select("member", F.col("conv_id").alias("id"))
    strung = ends.repartitionByRange("member", "id").sortWithinPartitions("member", "id").mapInArrow(_strung, "member long, first long, ids string")
    many = strung.repartition("member").sortWithinPartitions("member", "first").mapInArrow(_digested, "member long, ends string")
    one = F.sha2(F.col("member").cast("string"), 256)
    return scratch.put(groups.join(many, "member", "left").select("member", "copies", "length", F.coalesce("ends", one).alias("ends")))


def trie(ids: DataFrame, turns: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of the trie of conversations (conv_id) with turns (conv_id, pos, turn, words).

    Per node, in longs: conv_id, its smallest member; depth; parent_conv_id (null at the root); n_convs, its members;
    n_children; n_leaves, the childless nodes of its subtree, itself included; saved_tokens, over its subtree the words of
    each node's last turn times its members but one; and ends_sha256, of the ids of the conversations that end at it.
    """
    members = _members(ids, turns, scratch)
    saved = (F.col("copies") - 1) * F.col("words")
    mine = turns.withColumnRenamed("conv_id", "member").join(members.select("member", "copies"), "member")
    mine = scratch.put(mine.repartitionByRange("pos", "member").sortWithinPartitions("pos", "member"))  # a round reads its own turns
    least, n = members.agg(F.min("member"), F.sum("copies")).first()
    active = scratch.put(members.select("member", F.lit(least).cast("long").alias("node"), "length"))
    root = members.sparkSession.createDataFrame([(0, least, None, n, 0)] if n else [], "depth long, node long, parent long, n_convs long, words long")
    # split
    inner, alone, stops = [scratch.put(root)], [], []
    while not active.isEmpty():
        depth = len(inner)
        stops.append(active.filter(F.col("length") == depth - 1).select(F.lit(depth - 1).cast("long").alias("depth"), "node", "member"))
        step = active.join(mine.filter(F.col("pos") == depth - 1), "member")
        parts = step.groupBy("node", "turn").agg(F.min("member").alias("to"), F.sum("copies").alias("n_convs"), F.count("*").alias("n"), F.min("words").alias("words"))
        parts = scratch.put(parts)
        alone.append(parts.filter("n = 1").select(F.lit(depth).cast("long").alias("depth"), F.col("node").alias("parent"), F.col("to").alias("member")))
        more = parts.filter("n > 1")
        inner.append(more.select(F.lit(depth).cast("long").alias("depth"), F.col("to").alias("node"), F.col("node").alias("parent"), "n_convs", "words"))
        active = scratch.put(step.select("member", "node", "turn", "length").join(more.select("node", "turn", "to"), ["node", "turn"]).select("member", F.col("to").alias("node"), "length"))
    # chains of what retired
    rest = reduce(DataFrame.unionByName, alone, root.filter("false").select("depth", "parent", F.col("node").alias("member"))).withColumnRenamed("depth", "_from")
    below = Window.partitionBy("member").orderBy(F.desc("pos"))
    tails = mine.join(rest, "member").filter("pos >= _from - 1").withColumn("saved", F.lit(0).cast("long"))
    tails = tails.filter("copies = 1").unionByName(tails.filter("copies > 1").withColumn("saved", F.sum(saved).over(below)))
    tails = scratch.put(tails.select("member", (F.col("pos") + 1).alias("depth"), "parent", "_from", "copies", "saved"))
    nothing = F.sha2(F.lit(""), 256)
    last = F.col("depth") == F.col("length")
    chains = tails.join(members.drop("copies"), "member").select(
        F.col("member").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("_from"), F.col("parent")).otherwise(F.col("member")).alias("parent_conv_id"),
        F.col("copies").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(nothing).alias("ends_sha256"),
    )
    heads = tails.filter("depth = _from").groupBy("depth", F.col("parent").alias("node"))
    heads = scratch.put(heads.agg(F.count("*").alias("n_children"), F.count("*").alias("n_leaves"), F.sum("saved").alias("saved")))
    # fold back
    kids, folded = None, []
    for depth in reversed(range(len(inner))):
        got = heads.filter(F.col("depth") == depth + 1).drop("depth")
        if kids is not None:
            up = kids.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
            got = got.unionByName(up).groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved")])
        own = inner[depth].join(got, "node", "left").na.fill(0, ["n_children", "n_leaves", "saved"])
        own = own.withColumn("saved", F.expr("saved + (n_convs - 1) * words")).withColumn("n_leaves", F.greatest("n_leaves", F.lit(1)))
        kids = scratch.put(own)
        folded.append(kids)
    ended = reduce(DataFrame.unionByName, stops, root.filter("false").select("depth", "node", F.col("parent").alias("member"))).join(members.select("member", "ends"), "member").drop("member")
    trunk = reduce(DataFrame.unionByName, folded).join(ended, ["depth", "node"], "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", nothing).alias("ends_sha256"),
    )
    return trunk.unionByName(chains)


def prefix_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """The trie of conversations as they are."""
    scratch = Scratch(conversations.sparkSession)
    turns = placed_turns(conversations, scratch, **columns)
    return trie(turns.select("conv_id").distinct(), turns, scratch)


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that `rebuild` makes."""
    scratch = Scratch(conversations.sparkSession)
    return trie(*rebuild(placed_turns(conversations, scratch), scratch), scratch)


ORACLE = f"""
WITH {CRC_SQL},
given AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, sha256(length(role) || ':' || role || text) AS k,
  len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM given),
convs AS (SELECT c, {crc_sql("CAST(c AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT c FROM turns), crc_table),
rebuilt AS (
  SELECT v.c, b.pos, b.k, b.words FROM convs v JOIN turns b ON b.c = v.c - v.c % 20 AND b.pos < v.h
  UNION ALL SELECT v.c, t.pos + 1000000000, t.k, t.words FROM convs v JOIN turns t ON t.c = v.c AND t.pos >= v.h),
grown AS (SELECT c, row_number() OVER w AS d, sha256(string_agg(k, ',') OVER w) AS path, words FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY pos)),
paths AS (SELECT c, 0 AS d, '' AS path, 0 AS words, NULL AS up FROM convs UNION ALL SELECT c, d, path, words, coalesce(lag(path) OVER (PARTITION BY c ORDER BY d), '') FROM grown),
ends AS (SELECT c, max(d) AS last FROM paths GROUP BY c),
nodes AS (SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, any_value(up) AS up, any_value(words) AS words,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = last), '')) AS ends_sha256 FROM paths JOIN ends USING (c) GROUP BY d, path),
children AS (SELECT d - 1 AS d, up AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
own AS (SELECT n.conv_id, n.d, (n.n_convs - 1) * n.words AS saved, CAST(c.n IS NULL AS BIGINT) AS leaf FROM nodes n LEFT JOIN children c USING (d, path)),
below AS (SELECT p.d, p.path, sum(o.saved) AS saved, sum(o.leaf) AS leaves FROM own o JOIN paths p ON p.c = o.conv_id AND p.d <= o.d GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (d, path) LEFT JOIN children c USING (d, path) LEFT JOIN nodes u ON u.d = n.d - 1 AND u.path = n.up
"""
