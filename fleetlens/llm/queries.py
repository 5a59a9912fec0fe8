"""The operators as queries over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import ann, chat, fingerprints, html_text, licences, mixing, near_dups, negatives, packing, phrases, quality, sharding, suffixes
from fleetlens.llm.common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op1_query(table(spark, sf_dir, "documents"))


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op2_query(table(spark, sf_dir, "documents"))


def op3_scan_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.op3_query(table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.op4_query(table(spark, sf_dir, "embeddings"))


def op5_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.op5_query(table(spark, sf_dir, "documents"))


def op6_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op6_query(table(spark, sf_dir, "conversations"))


def op7_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op7_query(table(spark, sf_dir, "documents"))


def op8_extract_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.op8_query(table(spark, sf_dir, "pages"))


def op9_shard_by_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op9_query(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.op10_query(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.op11_query(table(spark, sf_dir, "embeddings"))


def op12_fingerprint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.op12_query(table(spark, sf_dir, "documents"))


def op13_mine_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.op13_query(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_pack_sequences,
        op3_scan_licences,
        op4_nearest_neighbours,
        op5_remove_repeats,
        op6_chat_examples,
        op7_quality_outliers,
        op8_extract_main_text,
        op9_shard_by_slots,
        op10_near_duplicates,
        op11_hard_negatives,
        op12_fingerprint_documents,
        op13_mine_phrases,
    )
}

ORACLE = {
    "op1_mix_sources": mixing.ORACLE,
    "op2_pack_sequences": packing.ORACLE,
    "op3_scan_licences": licences.ORACLE,
    "op4_nearest_neighbours": ann.ORACLE,
    "op6_chat_examples": chat.ORACLE,
    "op9_shard_by_slots": sharding.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
    "op12_fingerprint_documents": fingerprints.ORACLE,
    "op13_mine_phrases": phrases.ORACLE,
}
