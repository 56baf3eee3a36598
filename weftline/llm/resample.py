"""Importance resampling towards a target distribution, with an integer dictionary of words.

Words of a batch are mapped to ids, runs of words are tuples of ids, and each distinct tuple's bytes are put together and
hashed once; places take their bucket from their tuple. Buckets of a corpus and of the target give a gain per bucket, a
document's weight is the mean gain of its features, and Gumbel noise on top of it makes the highest scores a sample
without replacement in proportion to the exponentials of the weights.

A dictionary is a batch's own: a tuple's bucket depends on its bytes alone, so that batches agree without one for all, which
would send every word of the corpus over the network. What leaves a batch for the counts is a row per bucket. Each
document's buckets, two bytes a feature, are a table in the shared folder; weights read them back, not the texts.

Defined results: words are runs of letters a-z (capitals A-Z made small), digits and all characters above ASCII; null
texts hold none; texts of any length are taken whole, a stretch at a time; documents with no feature weigh 0; a null key
is drawn as the empty one and comes before others of its score; repeated rows are rows of their own; extra columns stay
out of the results, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, by_batch, claim, numbered

BUCKETS = 10_000
#: Words of one dictionary at most; a longer text goes on in the next one.
WORDS = 1 << 20
#: A scale of 1000 to a unit of the natural logarithm, for weights and scores.
SCALE = 1000
#: The bytes of words: digits, small letters and all above ASCII, capitals made small; others part words.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_CLEAN).split()


def buckets(runs: list[list[bytes]]) -> list[np.ndarray]:
    """The buckets of each run's words and of its pairs of neighbours, in no order."""
    lengths = np.array([len(r) for r in runs], np.int64)
    coded = pa.array([w for r in runs for w in r], pa.binary()).dictionary_encode()
    names = coded.dictionary.to_pylist()
    ids = coded.indices.to_numpy().astype(np.int64)
    single = np.fromiter((zlib.crc32(w) % BUCKETS for w in names), np.uint16, len(names))
    ends = np.cumsum(lengths)
    inside = np.ones(max(len(ids) - 1, 0), bool)
    inside[ends[(ends > 0) & (ends < len(ids))] - 1] = False  # no pair over the border of two runs
    at = np.flatnonzero(inside)
    distinct, which = np.unique(ids[at] * len(names) + ids[at + 1], return_inverse=True)
    left, right = np.divmod(distinct, max(len(names), 1))
    made = (zlib.crc32(names[a] + b" " + names[b]) % BUCKETS for a, b in zip(left.tolist(), right.tolist()))
    double = np.fromiter(made, np.uint16, len(distinct))[which]
    ones, twos = single[ids], np.cumsum(inside)
    out = []
    for end, n in zip(ends.tolist(), lengths.tolist()):
        lo, hi = end - n, end
        pairs = double[(twos[lo - 1] if lo else 0) : (twos[hi - 2] if hi >= 2 else 0)] if n > 1 else double[:0]
        out.append(np.concatenate([ones[lo:hi], pairs]))
    return out


def _parts(texts: list[str | None]) -> Iterator[tuple[list[int], list[list[bytes]], list[int]]]:
    """Runs of words that come to about WORDS: whose they are, and how many words they are more than the text's. A long
    text's next run starts with the last word of the one before, for the pair between them."""
    who, runs, again, size = [], [], [], 0
    for k, text in enumerate(texts):
        own = words(text)
        for lo in range(0, max(len(own), 1), WORDS):
            run = own[max(lo - 1, 0) : lo + WORDS]
            who.append(k)
            runs.append(run)
            again.append(int(lo > 0))
            size += len(run)
            if size >= WORDS:
                yield who, runs, again
                who, runs, again, size = [], [], [], 0
    if who:
        yield who, runs, again


def features(texts: list[str | None]) -> tuple[list[int], list[bytes]]:
    """Of each text the number of words and the buckets of its features, as little-endian unsigned 16-bit."""
    count, held = [0] * len(texts), [[] for _ in texts]
    for who, runs, again in _parts(texts):
        for k, run, twice, got in zip(who, runs, again, buckets(runs)):
            count[k] += len(run) - twice
            held[k].append(got[1:] if twice else got)  # its first word was the last of the run before
    return count, [b"".join(x.astype("<u2").tobytes() for x in parts) for parts in held]


def hashed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(key, n_words, buckets): the buckets of each document's features."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        claim("resample")
        n, got = features(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(got, pa.binary())], names=["key", "n_words", "buckets"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).mapInArrow(by_batch(run, 1), f"key {kind}, n_words long, buckets binary")


def totals(held: DataFrame) -> DataFrame:
    """(bucket, n): a row per bucket that a feature has; a task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                sums += np.bincount(np.frombuffer(raw, "<u2"), minlength=BUCKETS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])

    return held.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(spark: SparkSession, source: DataFrame, target: DataFrame) -> np.ndarray:
    """A gain per bucket from the totals of both sides: BUCKETS rows at most, whatever the corpus."""
    s, t = (F.coalesce(F.col(c), F.lit(0)) for c in "st")
    rows = spark.range(BUCKETS).withColumnRenamed("id", "bucket")
    rows = rows.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").select("bucket", s.alias("s"), t.alias("t"))
    got = np.array(rows.orderBy("bucket").collect(), np.int64).reshape(-1, 3)
    s, t = got[:, 1].astype(float), got[:, 2].astype(float)
    ratio = ((t + 1) * (s.sum() + BUCKETS)) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(SCALE * np.log(ratio)).astype(np.int64)


def weighed(held: DataFrame, gain: np.ndarray) -> DataFrame:
    """(key, n_words, n_features, weight): the floored mean of the gains of each document's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = [], []
            for raw in batch.column(2).to_pylist():
                own = gain[np.frombuffer(raw, "<u2")]
                n.append(len(own))
                weight.append(int(own.sum()) // len(own) if len(own) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(weight, pa.int64())], names=["key", "n_words", "n_features", "weight"])

    kind = held.schema["key"].dataType.simpleString()
    return held.mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise from a hash of seed and key, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    u = (h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log(u)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least: int = 20, seed: int = 7, text: str = "text", key: str = "doc_id", target_text: str = "text") -> DataFrame:
    """Per document: key, n_features, weight, score and rank, from 1, null where it is not drawn.

    Of the documents with `least` words or more, the floored `percent` in a hundred with the highest scores are drawn;
    ties go to the smaller key.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    held = scratch.put(hashed(docs, text, key))
    aim = hashed(target.select(F.lit(0).alias("key"), target[target_text].alias("text")), "text", "key")
    gain = gains(spark, totals(held), totals(aim))
    scored = scratch.put(weighed(held, gain).withColumn("score", F.col("weight") + noise(F.col("key"), seed)))
    scratch.drop(held)
    columns = [F.col("key").alias(key), "n_features", "weight", "score", "rank"]
    able = scored.filter(F.col("n_words") >= least)
    drawn = able.count() * percent // 100
    placed = numbered(able, [F.desc("score"), F.asc_nulls_first("key")], [], scratch)
    ranked = placed.withColumn("rank", F.when(F.col("_at") < drawn, F.col("_at") + 1))
    rest = scored.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*columns).unionByName(rest.select(*columns))


def drawn(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """The documents that are drawn, whole. Keys must be those of one row each."""
    got = resample(docs, target, text=text, key=key, **how).filter("rank is not null")
    return docs.join(got.select(key), key, "left_semi")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: CRC-32 in SQL: a table of 256 values by its polynomial, then a fold over a text's bytes.
CRC_SQL = """crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc_sql(column: str) -> str:
    """The CRC-32 of a text column, where crc_table's t is at hand."""
    hex_at = f"strpos('0123456789ABCDEF', substr(hex(encode({column})), %s, 1)) - 1"
    octets = f"list_transform(range(octet_length(encode({column}))), lambda i: 16 * ({hex_at % '2 * i + 1'}) + {hex_at % '2 * i + 2'})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLE = f"""
WITH {CRC_SQL},
texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
cut AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
runs AS (SELECT side, id, len(w) AS n_words, w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS f FROM cut),
each AS (SELECT side, id, unnest(f) AS f FROM runs),
counted AS (SELECT side, id, f, count(*) AS n FROM each GROUP BY ALL),
hashed AS (SELECT f, {crc_sql('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted), crc_table),
bucketed AS (SELECT side, id, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM bucketed GROUP BY bucket),
whole AS (SELECT sum(s) AS ws, sum(t) AS wt FROM sums),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (ws + 10000)) / ((s + 1) * (wt + 10000))))::BIGINT AS gain FROM sums, whole),
weights AS (SELECT id, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM bucketed JOIN gains USING (bucket) WHERE side = 0 GROUP BY id),
noise AS (SELECT doc_id, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM documents),
scored AS (SELECT doc_id, len(f) AS n_features, n_words, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM noise JOIN runs ON side = 0 AND runs.id = doc_id LEFT JOIN weights ON weights.id = doc_id),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""
