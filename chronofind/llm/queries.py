"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_dedup, decontamination, language_id, license_scan, mixing, pii, simhash, topk, url_filter, word_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.op1_language_id,
    "op2_byte_dedup": byte_dedup.op2_byte_dedup,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_word_dedup": word_dedup.op5_word_dedup,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_simhash": simhash.op7_simhash,
    "op8_mixing": mixing.op8_mixing,
    "op9_pii": pii.op9_pii,
    "op10_topk": topk.op10_topk,
}

ORACLES: dict[str, str] = {
    "op2_byte_dedup": byte_dedup.ORACLE_SQL,
    "op5_word_dedup": word_dedup.ORACLE_SQL,
    "op6_url_filter": url_filter.ORACLE_SQL,
    "op10_topk": topk.ORACLE_SQL,
}
