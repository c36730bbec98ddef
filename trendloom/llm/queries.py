"""Queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trendloom.llm import mixing, phrases
from trendloom.llm.license_scan import op7_license_scan
from trendloom.llm.packing import op10_best_fit_packing
from trendloom.llm.periodic_runs import op11_periodic_runs
from trendloom.llm.permutation_index import op3_permutation_index
from trendloom.llm.quality_classifier import op6_quality_classifier
from trendloom.llm.quality_rules import op9_quality_rules
from trendloom.llm.sharding import op5_key_shards
from trendloom.llm.simhash import op4_simhash_near_dedup
from trendloom.llm.suffix_dedup import op2_suffix_dedup
from trendloom.llm.token_index import op1_token_index
from trendloom.llm.window_packing import op13_window_packing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_index": op1_token_index,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_permutation_index": op3_permutation_index,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_key_shards": op5_key_shards,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_license_scan": op7_license_scan,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_quality_rules": op9_quality_rules,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_phrase_collocations": phrases.op12_phrase_collocations,
    "op13_window_packing": op13_window_packing,
}

ORACLE_SQL: dict[str, str] = {"op8_mix_sources": mixing.ORACLE, "op12_phrase_collocations": phrases.ORACLE}
