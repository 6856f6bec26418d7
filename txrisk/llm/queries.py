"""The queries of this subpackage, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (byte_bpe, chat_format, decontaminate, hard_negatives, html_extract, language_id, merkle, ngram_jaccard, quality_classifier,
               quality_rules, substring_dedup, suffix_array_dedup, warc)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_language_id": language_id.op2_language_id,
        "op3_byte_bpe": byte_bpe.op3_byte_bpe,
        "op4_chat_format": chat_format.op4_chat_format,
        "op5_warc": warc.op5_warc,
        "op6_ngram_jaccard": ngram_jaccard.op6_ngram_jaccard,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_html_extract": html_extract.op9_html_extract,
        "op10_quality_classifier": quality_classifier.op10_quality_classifier,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_suffix_array_dedup": suffix_array_dedup.op13_suffix_array_dedup,
        "language_id_pages": language_id.language_id_pages,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_dedup.ORACLE_SQL,
        "op4_chat_format": chat_format.ORACLE_SQL,
        "op5_warc": warc.ORACLE_SQL,
        "op6_ngram_jaccard": ngram_jaccard.ORACLE_SQL,
        "op8_quality_rules": quality_rules.ORACLE_SQL,
        "op11_hard_negatives": hard_negatives.ORACLE_SQL,
        "op12_merkle_manifest": merkle.ORACLE_SQL,
        "op13_suffix_array_dedup": suffix_array_dedup.ORACLE_SQL,
    }
