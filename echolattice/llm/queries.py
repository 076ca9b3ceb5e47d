"""The corpus queries and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from echolattice.llm import jaccard_join, line_dedup, mixing, packing, personal_data, quality_classifier, quality_rules, sharding, token_files, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cover_tree": vectors.op1_cover_tree,
    "op2_co_training": quality_classifier.op2_co_training,
    "op3_feistel_shards": sharding.op3_feistel_shards,
    "op4_jaccard_rtree": jaccard_join.op4_jaccard_rtree,
    "op5_personal_data": personal_data.op5_personal_data,
    "op6_cutting_stock": packing.op6_cutting_stock,
    "op7_simple8b_files": token_files.op7_simple8b_files,
    "op8_hierarchical_budget": mixing.op8_hierarchical_budget,
    "op9_line_frequency": quality_rules.op9_line_frequency,
    "op10_segment_edit_join": line_dedup.op10_segment_edit_join,
}

ORACLES: dict[str, str] = {
    "op1_cover_tree": vectors.ORACLE,
    "op3_feistel_shards": sharding.oracle(),
    "op4_jaccard_rtree": jaccard_join.ORACLE,
    "op5_personal_data": personal_data.ORACLE,
    "op8_hierarchical_budget": mixing.oracle(),
    "op9_line_frequency": quality_rules.ORACLE,
    "op10_segment_edit_join": line_dedup.ORACLE,
}
