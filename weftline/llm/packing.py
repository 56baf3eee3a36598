"""Packing token sequences by first-fit decreasing with a tournament tree, in randomised groups.

A document's ids, then the end id, are cut at every CAPACITY ids; full pieces are sequences of their own, numbered below
zero. The rests, one a document at most, go through first-fit decreasing: a tournament tree over the bins' free
capacities, each node the larger of its two, leads to the first bin that holds a rest in logarithmic time. Rests are
dealt at random into groups of about GROUP documents, each packed by itself, so that no task holds more than a group;
only rests' sizes are shuffled. Sequences of a group are numbered from the group's number times 2**32 on.

Defined results: null text is the empty text, whose only id is the end id; texts of any length are cut whole; repeated
rows are packed as often as they occur; ties of size go by the order of key, text hash and start; extra columns stay out
of the result, whatever their names; no rows give no pieces.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.bpe import codec
from weftline.llm.common import Scratch, gathered

CAPACITY = 2048
GROUP = 4096
#: Bytes of texts that are encoded at once: the more, the fewer times a word is looked up.
GATHER = 4 << 20


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Tournament:
    """Free capacities of bins; `place` takes the first bin that has room."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.width = 1 << max(0, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.width)

    def place(self, size: int) -> tuple[int, int]:
        """The bin and what it held before."""
        tree, node = self.tree, 1
        while node < self.width:
            node *= 2
            if tree[node] < size:
                node += 1
        free = tree[node]
        leaf = node - self.width
        tree[node] = free - size
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a > b else b
            node >>= 1
        return leaf, free


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bins and offsets of sizes that do not rise; bins are numbered as they are opened."""
    tree = Tournament(len(sizes), capacity)
    bins, offsets = [], []
    for size in sizes:
        k, free = tree.place(size)
        bins.append(k)
        offsets.append(capacity - free)
    return bins, offsets


def pieces(docs: DataFrame, ids_of: Callable[[pa.Array], list[bytes]], text: str, key: str, capacity: int) -> DataFrame:
    """Per piece: key, h, start, length, ids_crc32, doc_tokens. ids_of gives each text's ids as little-endian 32-bit."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, start, length, crc, total = [], [], [], [], []
        for i, ids in enumerate(ids_of(batch.column(2))):
            n, view = len(ids) // 4, memoryview(ids)
            for a in range(0, n, capacity):
                part = view[4 * a : 4 * (a + capacity)]
                row.append(i)
                start.append(a)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                total.append(n)
        at = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(cut, gathered(batches, 2, GATHER))

    names = ["key", "h", "start", "length", "ids_crc32", "doc_tokens"]
    kind = docs.schema[key].dataType.simpleString()
    body = docs[text].cast("string")
    rows = docs.select(docs[key].alias("key"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("h"), body.alias("text"))
    return rows.mapInArrow(run, f"key {kind}, h long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(cut: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset."""

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        group = batch.column(0).to_numpy()
        sizes = batch.column(batch.schema.get_field_index("length")).to_numpy()
        seq = np.empty(len(group), np.int64)
        off = np.empty(len(group), np.int64)
        bounds = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            seq[a:b], off[a:b] = first_fit_decreasing(sizes[a:b].tolist(), capacity)
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(group << 32 | seq), pa.array(off)], names=[*batch.schema.names[1:], "sequence_id", "offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            group = batch.column(0).to_numpy()
            edge = np.flatnonzero(group[1:] != group[:-1])
            cut_at = int(edge[-1]) + 1 if len(edge) else 0
            if cut_at:
                yield solve(batch.slice(0, cut_at))
            rest = batch.slice(cut_at)
        if rest is not None:
            yield solve(rest)

    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.select(F.pmod(F.xxhash64("key", "h", "start", F.monotonically_increasing_id()), F.lit(groups)).alias("grp"), *cut.columns)
    ordered = dealt.repartition(parts, "grp").sortWithinPartitions("grp", F.desc("length"), "key", "h", "start")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ordered.mapInArrow(run, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Per piece of each document: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def ids_of(column: pa.Array) -> list[bytes]:
        end = pack_ids([end_id])
        return [ids + end for ids in codec(path, "packed").packed(column)]

    scratch = Scratch(docs.sparkSession)
    cut = scratch.put(pieces(docs, ids_of, text, key, capacity))
    rests = cut.filter(F.col("length") < capacity)
    number = -1 - F.monotonically_increasing_id()
    full = cut.filter(F.col("length") == capacity).select("*", number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    packed = pack(rests, max(1, -(-rests.count() // GROUP)), capacity)
    return packed.unionByName(full).drop("h").withColumnRenamed("key", key)
