"""Quality rules by distribution divergence.

A document is held against its language's reference: the Jensen-Shannon distance of its histogram over character
classes, and of its histogram over the language's common words, to those of all documents in that language that pass
the base rules, and once more to those of them that the first reference finds near (TRIM), so that junk does not shape
the reference; where none is near, the first reference stands. The references are sums over the whole table, one row for
each value of the language column, joined back; the words of languages that are not listed are those of all that are.

Base rules, over words (runs of characters other than space and \\t..\\r): under MIN_WORDS words, or over half of the
words in three-word windows that the text holds twice or more, fail.

A document fails beyond the limit of the character distance alone, or beyond both limits of a pair. Short documents
stray further from any reference by chance, so that wider limits hold below LONG words. Neither distance counts where
the document or the reference has fewer than CHAR_GUARD characters or WORD_GUARD words.

Defined results: null text is the empty text and fails the base rules; rows with a null language share one reference;
repeated rows get equal verdicts; texts of any length are taken whole; no rows give no rows; extra columns stay out of
the verdicts, and with the rows that `keep_good` keeps, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, by_batch, claim, small_batches, texts

MIN_WORDS = 50
CHAR_GUARD, WORD_GUARD = 200, 50
#: Jensen-Shannon distances (base 2, 0 to 1): of characters alone, and of characters and words together.
LONG = 120
ALONE = {True: 0.22, False: 0.33}
PAIR = {True: (0.17, 0.26), False: (0.17, 0.34)}
#: Distances up to which a document shapes the second reference.
TRIM = (0.15, 0.30)

# Frequent function words of each language.
COMMON = {
    "en": "the of and to in a is that it was for on are with as be by this at from or an have not he they which".split(),
    "fr": "de la le et les des en un une du est que pour dans qui par sur au plus pas ce avec il ne se sont aux elle".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o pero sus le ha es".split(),
}
_WORDS = {k: {w: i for i, w in enumerate(v)} for k, v in COMMON.items()}
_WORDS["other"] = {w: i for i, w in enumerate(sorted(set(chain(*COMMON.values()))))}
_WIDTH = max(map(len, _WORDS.values())) + 1
#: Character classes: lower, upper, digit, blank, line end, sentence marks, symbols, other ASCII marks, other letters.
CLASSES = 9
_CLASS = np.full(256, 7, np.uint8)
for _c in range(256):
    _ch = chr(_c)
    if _c >= 0x80:
        _CLASS[_c] = 8 if _c >= 0xC0 else 255  # a code point counts once, by its first byte
    elif _ch.islower():
        _CLASS[_c] = 0
    elif _ch.isupper():
        _CLASS[_c] = 1
    elif _ch.isdigit():
        _CLASS[_c] = 2
    elif _ch in " \t":
        _CLASS[_c] = 3
    elif _ch == "\n":
        _CLASS[_c] = 4
    elif _ch in ".,;:?!'\"":
        _CLASS[_c] = 5
    elif _ch in "#*$%&|<>":
        _CLASS[_c] = 6
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LEAD = np.array([c & 0xC0 != 0x80 for c in range(256)])


def _repeats(words: list[bytes]) -> int:
    """Words in three-word windows found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    total = end = 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def measure(text: str, lang: str | None) -> tuple:
    """The base counts, then both histograms of one text."""
    raw = text.encode()
    words = raw.split()
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = int(hist[_LEAD].sum())
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += bool(line.encode().split())
        else:
            seen.add(line)
    known = _WORDS[lang if lang in COMMON else "other"]
    common = [0] * _WIDTH
    for word, n in Counter(text.lower().split()).items():
        common[known.get(word.strip(".,;:?!"), _WIDTH - 1)] += n
    classes = np.bincount(_CLASS, weights=hist, minlength=256)[:CLASSES].astype(np.int64).tolist()
    return len(words), points - int(hist[_BLANK].sum()), int(hist[_SYMBOL].sum()), dup, _repeats(words), classes, common


def base_failed(n_words: tuple, n_repeat_words: tuple) -> np.ndarray:
    n, r = np.array(n_words), np.array(n_repeat_words)
    return (n < MIN_WORDS) | (100 * r > 50 * n)


def features(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Per row: key, grp (language), base counts, base_failed, both histograms."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        claim("quality")
        langs = batch.column(1).to_pylist()
        rows = [measure(t, g) for t, g in zip(texts(batch.column(2)), langs)]
        cols = list(zip(*rows))
        ints = [pa.array(c, pa.int64()) for c in cols[:5]]
        failed = pa.array(base_failed(cols[0], cols[4]))
        hists = [pa.array(list(c), pa.list_(pa.int64())) for c in cols[5:]]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *ints, failed, *hists], names=names)

    names = ["key", "grp", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "classes", "common"]
    kind = docs.schema[key].dataType.simpleString()
    body = docs[text].cast("string")
    rows = docs.select(docs[key].alias("key"), docs[lang].cast("string").alias("lang"), body.alias("text"))
    return rows.mapInArrow(
        by_batch(run, 2),
        f"key {kind}, grp string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, classes array<long>, common array<long>",
    )


def references(measured: DataFrame) -> DataFrame:
    """Histogram sums of each language's documents that pass the base rules: ref_grp, ref_classes, ref_common."""
    return measured.filter("not base_failed").groupBy(F.col("grp").alias("ref_grp")).agg(
        F.array(*[F.sum(F.col("classes")[i]) for i in range(CLASSES)]).alias("ref_classes"),
        F.array(*[F.sum(F.col("common")[i]) for i in range(_WIDTH)]).alias("ref_common"),
    )


def distance(count: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (square root of the divergence, base 2) of each row's histogram to the reference's."""
    p = count / np.maximum(count.sum(1, keepdims=True), 1)
    q = (reference / max(reference.sum(), 1))[None, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.maximum((a + b) / 2, 0))


def _sides(counts: pa.Array, groups: list[np.ndarray], refs: pa.Array, guard: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distance to its group's reference, and whether it counts."""
    rows = np.array(counts.to_pylist(), np.float64).reshape(len(counts), -1)
    out, use = np.zeros(len(counts)), np.zeros(len(counts), bool)
    for own in groups:
        reference = np.array(refs[int(own[0])].as_py() or [0], np.float64)
        if reference.sum() >= guard:
            out[own] = distance(rows[own], reference)
            use[own] = rows[own].sum(1) >= guard
    return out, use


def _decide(langs: list, n_words: np.ndarray, failed: np.ndarray, classes: pa.Array, common: pa.Array, ref_classes: pa.Array, ref_common: pa.Array) -> list[pa.Array]:
    """char_distance, word_distance and kept."""
    places: dict[str | None, list[int]] = {}
    for i, g in enumerate(langs):
        places.setdefault(g, []).append(i)
    groups = [np.array(x) for x in places.values()]
    c, use_c = _sides(classes, groups, ref_classes, CHAR_GUARD)
    w, use_w = _sides(common, groups, ref_common, WORD_GUARD)
    long = n_words >= LONG
    alone = c > np.where(long, ALONE[True], ALONE[False])
    both = (c > np.where(long, PAIR[True][0], PAIR[False][0])) & (w > np.where(long, PAIR[True][1], PAIR[False][1]))
    return [pa.array(c, mask=~use_c), pa.array(w, mask=~use_w), pa.array(~(failed | use_c & alone | use_c & use_w & both))]


def judged(measured: DataFrame, refs: DataFrame) -> DataFrame:
    """measured with char_distance, word_distance (null under their guards) and kept."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            failed = col["base_failed"].to_numpy(zero_copy_only=False)
            extra = _decide(col["grp"].to_pylist(), col["n_words"].to_numpy(), failed, col["classes"], col["common"], col["ref_classes"], col["ref_common"])
            yield pa.RecordBatch.from_arrays([*[col[n] for n in own_names], *extra], names=[*own_names, "char_distance", "word_distance", "kept"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in measured.schema)
    own_names = measured.columns
    return measured.join(refs, measured["grp"].eqNullSafe(refs["ref_grp"]), "left").mapInArrow(run, schema + ", char_distance double, word_distance double, kept boolean")


def final_references(measured: DataFrame, scratch: Scratch) -> DataFrame:
    """The second references, as a table, so that Spark knows their size and broadcasts them only where they are small."""
    wide = scratch.put(references(measured))
    first = judged(measured, wide)
    near = first.filter((F.coalesce("char_distance", F.lit(0.0)) <= TRIM[0]) & (F.coalesce("word_distance", F.lit(0.0)) <= TRIM[1]))
    trimmed = references(near).select(F.col("ref_grp").alias("_g"), F.col("ref_classes").alias("_c"), F.col("ref_common").alias("_w"))
    second = wide.join(trimmed, wide["ref_grp"].eqNullSafe(trimmed["_g"]), "left")
    return scratch.put(second.select("ref_grp", F.coalesce("_c", "ref_classes").alias("ref_classes"), F.coalesce("_w", "ref_common").alias("ref_common")))


def verdicts(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Per row: key, base counts, base_failed, both distances, kept."""
    scratch = Scratch(docs.sparkSession)
    measured = scratch.put(features(docs, text, key, lang))
    return judged(measured, final_references(measured, scratch)).drop("classes", "common", "grp").withColumnRenamed("key", key)


def keep_good(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The rows of docs that are kept. Texts are measured once more beside the references, rather than shuffled to meet
    their verdicts."""
    scratch = Scratch(docs.sparkSession)
    refs = final_references(scratch.put(features(docs, text, key, lang)), scratch)
    small_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def good(body: pa.Array, own: pa.Array, ref_classes: pa.Array, ref_common: pa.Array) -> pa.Array:
        claim("quality")
        if not len(body):
            return pa.array([], pa.bool_())
        langs = own.to_pylist()
        cols = list(zip(*[measure(t, g) for t, g in zip(texts(body), langs)]))
        return _decide(langs, np.array(cols[0]), base_failed(cols[0], cols[4]), *(pa.array(list(c)) for c in cols[5:]), ref_classes, ref_common)[2]

    rows = docs.select(F.struct(*docs.columns).alias("row"), docs[text].cast("string").alias("body"), docs[lang].cast("string").alias("own"))
    met = rows.join(refs, F.col("own").eqNullSafe(F.col("ref_grp")), "left")
    return met.filter(good("body", "own", "ref_classes", "ref_common")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
