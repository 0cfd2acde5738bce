"""The subpackage's queries, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timeweave.llm import exact_dedup, line_dedup, mixing, packing, quality_classifier, quality_rules, sharding, simhash, token_file, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": quality_classifier.query,
    "op2_simhash_near_dedup": simhash.query,
    "op3_link_graph_url_filter": url_filter.query,
    "op4_power_of_two_packing": packing.query,
    "op5_pfor_token_files": token_file.query,
    "op6_line_dedup": line_dedup.query,
    "op7_entropy_balancing": mixing.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_quality_rules": quality_rules.query,
    "op10_hypergeometric_sharding": sharding.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_link_graph_url_filter": url_filter.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op9_quality_rules": quality_rules.SQL,
}
