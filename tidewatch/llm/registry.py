"""The corpus queries, op1 to op13, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import oracles
from tidewatch.llm.hardnegatives import op12_hard_negatives
from tidewatch.llm.linededup import op2_line_dedup
from tidewatch.llm.linelabels import op13_quality_rules
from tidewatch.llm.media import op9_media_columns
from tidewatch.llm.neardup import op7_near_duplicates
from tidewatch.llm.packing import op3_best_fit_packing
from tidewatch.llm.pieces import op6_sentencepiece
from tidewatch.llm.quality import op5_quality
from tidewatch.llm.secrets import op10_secret_scans
from tidewatch.llm.tokencount import op4_token_counts
from tidewatch.llm.topk import op8_exact_top_k
from tidewatch.llm.toxicity import op1_toxicity
from tidewatch.llm.variants import op11_spelling_variants

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_line_dedup": op2_line_dedup,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_token_counts": op4_token_counts,
        "op5_quality": op5_quality,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_near_duplicates": op7_near_duplicates,
        "op8_exact_top_k": op8_exact_top_k,
        "op9_media_columns": op9_media_columns,
        "op10_secret_scans": op10_secret_scans,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_quality_rules": op13_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": oracles.OP2,
        "op7_near_duplicates": oracles.OP7,
        "op8_exact_top_k": oracles.OP8,
        "op10_secret_scans": oracles.op10(),
        "op11_spelling_variants": oracles.OP11,
        "op12_hard_negatives": oracles.OP12,
    }
