"""The contract queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, chat, licenses, line_crf, merkle, packing, quality_rules, secrets, substrings, tries, warc
from tidemark.llm.common import table
from tidemark.llm.simhash import simhash_components
from tidemark.llm.vector_graph import vector_components

#: A tokenizer file, the same vocabulary as ranks, and its splitting pattern.
PACKING_VOCABULARY = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_components(table(spark, sf_dir, "embeddings"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.summary(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    tokens = chat.token_counter(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return chat.read_back(chat.format_conversations(rows.union(probe), tokens))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("clean_text")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *PACKING_VOCABULARY)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.summary(substrings.remove_repeats(table(spark, sf_dir, "documents")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(merkle.merkle_manifest(table(spark, sf_dir, "documents")))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.conversation_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_dedup": op1_simhash_dedup,
        "op2_vector_dedup": op2_vector_dedup,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_license_scan": op4_license_scan,
        "op5_secret_scan": op5_secret_scan,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_chat_format": op7_chat_format,
        "op8_quality_rules": op8_quality_rules,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_warc": op10_warc,
        "op11_substring_dedup": op11_substring_dedup,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_conversation_trie": op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": licenses.sql(), "op5_secret_scan": secrets.sql(), "op8_quality_rules": quality_rules.SQL, "op10_warc": warc.SQL, "op11_substring_dedup": substrings.SQL, "op12_merkle_manifest": merkle.SQL, "op13_conversation_trie": tries.SQL}
