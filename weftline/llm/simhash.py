"""SimHash near-duplicates by deletion-variant signatures.

Words are runs of bytes other than space and \\t..\\r, with A-Z in lower case; shingles are three words, repeats
included (fewer words: the whole sequence; none: fingerprint zero). A fingerprint bit is set if it is in over half
of the shingles' XXH64 (seed 42).

Fingerprints at three or fewer differing bits are cut into two segments only: one of them then differs by at most
one bit. Each distinct fingerprint is indexed under each segment as it is and under each of its 32 variants with one
bit deleted, so that linked fingerprints meet under an equal signature, and pairs that meet are verified. Under a
variant only fingerprints that differ in the deleted bit are compared, as the others meet under the whole segment.
Groups pass on a spanning star of their links, never all pairs. A group of over GROUP_ROWS fingerprints is dealt out
in tiles, each pair of tiles a group of its own, so that no task holds more than two tiles and no pair is lost.

Defined results: null text is the empty text; rows with null keys get fingerprints like any other, and a component of
null keys alone has a null component_id; repeated rows get equal results; texts of any length are taken whole; of equal
keys the smallest is the same whichever row has it; extra columns stay out of the results, whatever their names; no rows
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, by_batch, claim
from weftline.llm.components import components, spanning

#: Fingerprints of one signature that are compared in one tile.
GROUP_ROWS = 4096
_SIDE = np.uint64(0xFFFFFFFF)


def fingerprint_arrays(raw: list[bytes]) -> np.ndarray:
    hash_of = xxhash.xxh64_intdigest
    out = np.zeros(len(raw), np.uint64)
    hashes: list[int] = []
    counts = np.zeros(len(raw), np.int64)
    for i, text in enumerate(raw):
        words = text.lower().split()
        if not words:
            continue
        n = len(hashes)
        if len(words) < 3:
            hashes.append(hash_of(b" ".join(words), 42))
        else:
            pair = list(map(b" ".join, zip(words, words[1:])))
            hashes += [hash_of(p + b" " + w, 42) for p, w in zip(pair, words[2:])]
        counts[i] = len(hashes) - n
    if not hashes:
        return out
    full = np.flatnonzero(counts)
    ends = np.cumsum(counts[full])
    h = np.array(hashes, np.uint64)
    step = 1 << 15
    sums = np.zeros((len(full), 64), np.int64)
    for a in range(0, len(h), step):
        part = h[a : a + step]
        first, last = np.searchsorted(ends, [a, a + len(part) - 1], side="right")
        starts = np.concatenate([[0], ends[first:last] - a])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums[first : last + 1] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    on = (2 * sums > counts[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(on, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def text_hash(docs: DataFrame, text: str) -> Column:
    return F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, h (the text's hash) and fp, the fingerprint (the 64 bits as a long)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        claim("simhash")
        raw = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fingerprint_arrays(raw).view(np.int64))], names=["key", "h", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), text_hash(docs, text).alias("h"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(by_batch(run, 2), f"key {kind}, h long, fp long")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 33 * segment + deleted bit (32: none) above, the segment without that bit below."""
    mask = np.array([~(1 << p) & 0xFFFFFFFF for p in range(32)] + [0xFFFFFFFF], np.uint64)
    for batch in batches:
        whole = batch.column(0).to_numpy().view(np.uint64)
        for i in range(0, len(whole), 2048):
            fp = whole[i : i + 2048]
            sig = []
            for s in range(2):
                part = (fp >> np.uint64(32 * s)) & _SIDE
                kind = np.arange(33 * s, 33 * s + 33, dtype=np.uint64) << np.uint64(32)
                sig.append((part[:, None] & mask | kind).ravel())
            n = np.tile(np.repeat(fp, 33), 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(n)], names=["sig", "fp"])


def _links_within(sig: int, fp: np.ndarray, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    kind = (sig >> 32) % 33
    if kind == 32:
        left = right = fp
    else:
        bit = np.uint64(1) << np.uint64(kind + 32 * ((sig >> 32) // 33))
        left, right = fp[fp & bit == 0], fp[fp & bit != 0]
    us, vs = [], []
    for i in range(0, len(left), 512):
        a, b = np.nonzero(np.bitwise_count(left[i : i + 512, None] ^ right[None, :]) <= radius)
        us.append(left[i + a].view(np.int64))
        vs.append(right[b].view(np.int64))
        if len(us) > 8 and sum(map(len, us)) > 1 << 20:
            u, v = spanning(np.concatenate(us), np.concatenate(vs))
            us, vs = [u], [v]
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return spanning(np.concatenate(us), np.concatenate(vs))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, tile, fp) sorted by sig and tile; a group that runs over a batch's end is carried on."""
    rest = [np.zeros(0, np.int64)] * 3
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []

    def out() -> Iterator[pa.RecordBatch]:
        if us and sum(map(len, us)):
            u, v = spanning(np.concatenate(us), np.concatenate(vs))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        us.clear()
        vs.clear()

    def groups(cols: list[np.ndarray], last: bool) -> list[np.ndarray]:
        sig, tile, fp = cols
        edge = np.flatnonzero((sig[1:] != sig[:-1]) | (tile[1:] != tile[:-1])) + 1
        bounds = np.concatenate([[0], edge, [len(sig)] if last else []]).astype(np.int64)
        big = np.flatnonzero(np.diff(bounds) > 1)
        for a, b in zip(bounds[big].tolist(), bounds[big + 1].tolist()):
            u, v = _links_within(int(sig[a]), fp[a:b].view(np.uint64))
            if len(u):
                us.append(u)
                vs.append(v)
        cut = len(sig) if last else int(bounds[-1])
        return [c[cut:] for c in cols]

    for batch in batches:
        cols = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns)]
        if len(cols[0]):
            rest = groups(cols, False)
        if len(us) > 20_000:
            yield from out()
    if len(rest[0]):
        groups(rest, True)
    yield from out()


def link_fingerprints(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp) distinct fingerprints to (u, v) links whose components are those of all links at three or fewer bits."""
    signed = distinct.select("fp").mapInArrow(_signatures, "sig long, fp long")
    large = scratch.put(signed.groupBy("sig").count().filter(F.col("count") > GROUP_ROWS))
    if large.isEmpty():
        dealt = signed.select("sig", F.lit(0).cast("long").alias("tile"), "fp")
    else:
        tiles = F.ceil(F.col("count") / GROUP_ROWS).cast("int")
        own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
        pair = F.transform(
            F.sequence(F.lit(0), tiles - 1),
            lambda j: F.least(j, own).cast("long") * F.lit(1 << 31) + F.greatest(j, own).cast("long"),
        )
        dealt = signed.join(large, "sig", "left").select(
            "sig", F.explode(F.when(F.col("count").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pair)).alias("tile"), "fp"
        )
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = dealt.repartition(parts, "sig", "tile").sortWithinPartitions("sig", "tile")
    return components(together.mapInArrow(_verify, "u long, v long"), scratch)


def _rooted(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, ...) rows to (fp, root): each distinct fingerprint with one fingerprint that names its component."""
    distinct = scratch.put(rows.select("fp").distinct())
    stars = link_fingerprints(distinct, scratch)
    rooted = distinct.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left")
    return scratch.put(rooted.select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, fingerprint (16 hexadecimal digits) and component_id, the smallest key reachable over links."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.put(fingerprints(docs, text, key))
    rooted = _rooted(rows, scratch)
    least = rows.groupBy("fp").agg(F.min("key").alias("least")).join(rooted, "fp")
    least = scratch.put(least.groupBy("root").agg(F.min("least").alias("component_id")))
    named = scratch.put(rooted.join(least, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component, whole: of its rows the one of the smallest key (null keys last), and there of the
    smallest text hash. Rows that agree in key and text stay once."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.put(fingerprints(docs, text, key))
    own = rows.groupBy("fp").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "h")).alias("one"))
    best = own.join(_rooted(rows, scratch), "fp").groupBy("root").agg(F.min("one").alias("one"))
    # a row is named by key and text hash, and how often it stands decides whether its copies must be told apart
    kept = best.select("one.key", "one.h").join(rows.groupBy(F.col("key").alias("k"), F.col("h").alias("g")).agg(F.count("*").alias("n")), F.col("key").eqNullSafe(F.col("k")) & (F.col("h") == F.col("g")))
    kept = scratch.put(kept.select(F.col("k").alias("key"), F.col("g").alias("h"), "n"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), docs[key].alias("own"), text_hash(docs, text).alias("mine"))
    met = whole.join(kept, F.col("own").eqNullSafe(F.col("key")) & (F.col("mine") == F.col("h"))).select("row", "own", "mine", "n")
    out = met.filter("n = 1").select("row").unionAll(met.filter("n > 1").dropDuplicates(["own", "mine"]).select("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
