"""The registered queries of this package, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave.llm import (
    conversation_repair,
    decontamination,
    importance,
    language,
    license_scan,
    mixing,
    near_duplicates,
    neighbours,
    packing,
    periodic_runs,
    quality_rules,
    token_store,
    url_filter,
)
from alertweave.llm.oracles import ORACLES
from alertweave.llm.shared import table


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "ring", "ring_quota", "block"
    )


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_id(table(spark, folder, "documents")).select(
        "doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans")
    )


def op3_token_store(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_store.token_store(table(spark, folder, "documents"), path)


def op4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.url_filter(table(spark, folder, "pages"))


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "documents"))


def op9_importance(spark: SparkSession, folder: str) -> DataFrame:
    return importance.quality_classifier(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.license_scan(table(spark, folder, "documents")).drop("blocks")


def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    named = F.array_sort(F.transform("items", lambda item: item.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(named, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.run_digests(periodic_runs.with_planted_runs(table(spark, folder, "documents")))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.repair_digests(table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_language": op2_language,
    "op3_token_store": op3_token_store,
    "op4_neighbours": op4_neighbours,
    "op5_quality_rules": op5_quality_rules,
    "op6_url_filter": op6_url_filter,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_packing": op8_packing,
    "op9_importance": op9_importance,
    "op10_license_scan": op10_license_scan,
    "op11_decontamination": op11_decontamination,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_repair": op13_conversation_repair,
}

__all__ = ["ORACLES", "QUERIES"]
