"""The training-data operators' registered queries: thin digests of each operator's results over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, embeddings, licenses, packing, pieces, pii, quality, recompress, resample, simhash, suffixes, tries, urls
from weftline.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fields(column: str, *names: str) -> list[Column]:
    return [F.col(f"{column}.{n}").alias(n) for n in names]


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.dedup(docs).select("row.doc_id", *fields("cut", "n_bytes", "n_removed", "n_spans", "kept_sha256"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched"))
    return urls.filter_urls(pages, urls.entries(spark), "page_id", "url", "fetched")


def op6_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return recompress.dedup(docs).select("row.doc_id", *fields("cut", "n_words", "n_removed", "kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_sentencepiece_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.rebuilt_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_roundtrip": op1_bpe_roundtrip,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_url_filters": op5_url_filters,
    "op6_recompression_dedup": op6_recompression_dedup,
    "op7_packing": op7_packing,
    "op8_license_scan": op8_license_scan,
    "op9_pii": op9_pii,
    "op10_quality_rules": op10_quality_rules,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_sentencepiece_roundtrip": op12_sentencepiece_roundtrip,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLES: dict[str, str] = {"op5_url_filters": urls.ORACLE, "op11_importance_resampling": resample.ORACLE, "op13_conversation_trie": tries.ORACLE}
