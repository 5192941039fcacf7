"""The subpackage's queries, by the names that ``__spark_entry__`` registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import quality_rules
from palimpsest.llm.decontamination import op7_benchmark_windows
from palimpsest.llm.html_extraction import op8_wrapper_extraction
from palimpsest.llm.lm_scoring import op5_recurrent_lm
from palimpsest.llm.packing import op9_pattern_packing
from palimpsest.llm.quality_classifier import op4_latent_neighbours
from palimpsest.llm.quality_rules import op3_adaptive_rules
from palimpsest.llm.secret_scan import op10_grammar_secrets
from palimpsest.llm.sharding import op1_hash_tree_sharding
from palimpsest.llm.simhash_dedup import op2_simhash_vptree
from palimpsest.llm.toxicity import op6_boosted_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hash_tree_sharding": op1_hash_tree_sharding,
    "op2_simhash_vptree": op2_simhash_vptree,
    "op3_adaptive_rules": op3_adaptive_rules,
    "op4_latent_neighbours": op4_latent_neighbours,
    "op5_recurrent_lm": op5_recurrent_lm,
    "op6_boosted_toxicity": op6_boosted_toxicity,
    "op7_benchmark_windows": op7_benchmark_windows,
    "op8_wrapper_extraction": op8_wrapper_extraction,
    "op9_pattern_packing": op9_pattern_packing,
    "op10_grammar_secrets": op10_grammar_secrets,
}

#: Only where SQL can express the whole result.
ORACLE_SQL: dict[str, str] = {
    "op3_adaptive_rules": quality_rules.oracle(),
}
