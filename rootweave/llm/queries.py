"""One query for each numbered operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rootweave.llm import chat, collocations, prefix_trie, secret_scan
from rootweave.llm.decontaminate import find_contamination
from rootweave.llm.fingerprint_index import dedupe_windows
from rootweave.llm.licenses import scan_licenses
from rootweave.llm.near_dedup import near_duplicates
from rootweave.llm.neighbours import nearest_neighbours
from rootweave.llm.prefix_encode import encode_texts
from rootweave.llm.quality import classify_quality
from rootweave.llm.suffix_dedup import dedupe_substrings
from rootweave.llm.surrogates import replace_entities


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedupe_windows(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), ids=False)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedupe_substrings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turn_sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(turns))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_pii_surrogates,
        op3_minhash_near_dedup,
        op4_chat_formatting,
        op5_nearest_neighbours,
        op6_quality_classifier,
        op7_license_scan,
        op8_substring_dedup,
        op9_sentencepiece,
        op10_suffix_array_dedup,
        op11_collocations,
        op12_prefix_trie,
        op13_secret_scan,
    )
}
ORACLE_SQL: dict[str, str] = {"op4_chat_formatting": chat.SQL, "op11_collocations": collocations.SQL, "op12_prefix_trie": prefix_trie.SQL, "op13_secret_scan": secret_scan.SQL}
