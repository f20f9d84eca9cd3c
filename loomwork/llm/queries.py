"""The queries of this package: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import (
    chat,
    decontamination,
    filter_audit,
    fingerprints,
    license_scan,
    packing,
    quality,
    repair,
    sharding,
    simhash,
    toxicity,
    url_filter,
    wavelet,
)

from loomwork.llm.storage import keep

#: The tokenizer file of op9; None: ``word_bpe_49k.json`` of the installed public vocabularies.
TOKENIZER: str | None = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one more conversation, -7, whose texts hold control strings."""
    text = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", text), (-7, 1, "assistant", text)]
    more = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    formatted = keep(chat.examples(given.unionByName(more)), "chat")
    return chat.digests(formatted)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_table(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_components(_table(spark, sf_dir, "documents"))


def op9_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = TOKENIZER
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return wavelet.token_report(_table(spark, sf_dir, "documents"), path)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(repair.damaged(_table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The registered queries by name."""
    found = (
        op1_document_fingerprints,
        op2_packing,
        op3_toxicity,
        op4_benchmark_decontamination,
        op5_chat_formatting,
        op6_url_filters,
        op7_license_scan,
        op8_simhash_near_dedup,
        op9_wavelet_tokens,
        op10_quality_classifier,
        op11_filter_interaction_audit,
        op12_sharding,
        op13_conversation_repair,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that it can express whole; tests/llm holds the others against brute force."""
    return {
        "op5_chat_formatting": chat.DIGESTS_SQL,
        "op11_filter_interaction_audit": filter_audit.AUDIT_SQL,
        "op13_conversation_repair": repair.REPAIR_SQL,
    }
