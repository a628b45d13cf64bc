"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from odweave.llm.jaccard_join import op4_ngram_jaccard
from odweave.llm.line_dedup import OP8_SQL, op8_line_dedup
from odweave.llm.mixing import OP10_SQL, op10_mix_sources
from odweave.llm.outliers import op6_quality_rules
from odweave.llm.packing import op9_best_fit_packing
from odweave.llm.quality import op7_quality_classifier
from odweave.llm.secrets import op5_secret_scan
from odweave.llm.spotsigs import op2_spot_signatures
from odweave.llm.substring_dedup import op3_substring_dedup
from odweave.llm.suffix_array import op1_suffix_array_dedup


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_array_dedup, op2_spot_signatures, op3_substring_dedup, op4_ngram_jaccard, op5_secret_scan, op6_quality_rules, op7_quality_classifier, op8_line_dedup, op9_best_fit_packing, op10_mix_sources)}


def llm_oracles() -> dict[str, str]:
    return {"op8_line_dedup": OP8_SQL, "op10_mix_sources": OP10_SQL}
