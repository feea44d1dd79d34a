"""Contract queries of the corpus operators: QUERIES (Spark) and ORACLES (DuckDB SQL)."""

from __future__ import annotations

from graphloom.llm import chat_tree, decontaminate, license_scan, line_dedup, mixing, near_dedup, quality, secrets_scan, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_warc_assembly": warc.query,
    "op3_quality_rules": quality.query,
    "quality_base_counts": quality.query_base,
    "op4_near_dedup": near_dedup.query,
    "op5_source_mixing": mixing.query,
    "op6_line_dedup": line_dedup.query,
    "line_dedup_short_texts": line_dedup.query_short,
    "op7_secret_scan": secrets_scan.query,
    "secret_base_spans": secrets_scan.query_base,
    "op8_chat_formatting": chat_tree.query,
    "op9_license_scan": license_scan.query,
    "op10_decontamination": decontaminate.query,
}

ORACLES = {
    "op1_url_filter": url_filter.ORACLE,
    "op2_warc_assembly": warc.ORACLE,
    "quality_base_counts": quality.ORACLE_BASE,
    "op4_near_dedup": near_dedup.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "line_dedup_short_texts": line_dedup.ORACLE_SHORT,
    "secret_base_spans": secrets_scan.ORACLE_BASE,
    "op8_chat_formatting": chat_tree.ORACLE,
    "op9_license_scan": license_scan.ORACLE,
    "op10_decontamination": decontaminate.ORACLE,
}
