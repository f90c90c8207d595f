"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import OP5_SQL, op5_benchmark_decontamination
from .earlier_copies import OP12_SQL, op12_suffix_array_dedup
from .langid import op9_language_id
from .lexical_search import OP11_SQL, op11_lexical_search
from .near_dup import op3_near_dedup
from .packing import op4_packing
from .quality_rules import op6_quality_rules
from .sharding import op2_sharding
from .spelling import op13_spelling_variants
from .substring_dedup import OP7_SQL, op7_substring_dedup
from .token_counts import op10_token_counts
from .toxicity import op8_toxicity
from .url_filter import OP1_SQL, op1_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_sharding": op2_sharding,
    "op3_near_dedup": op3_near_dedup,
    "op4_packing": op4_packing,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_token_counts": op10_token_counts,
    "op11_lexical_search": op11_lexical_search,
    "op12_suffix_array_dedup": op12_suffix_array_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}

SQL: dict[str, str] = {
    "op1_url_filters": OP1_SQL,
    "op5_benchmark_decontamination": OP5_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_suffix_array_dedup": OP12_SQL,
}
