"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from skyframe.llm.bpe_stream import op3_bpe
from skyframe.llm.context_tree import op4_lm_score
from skyframe.llm.decontamination import op5_decontamination
from skyframe.llm.license_scan import op1_license_scan
from skyframe.llm.line_dedup import OP12_SQL, op12_line_dedup
from skyframe.llm.near_dedup import op2_near_dedup
from skyframe.llm.quality_rules import op8_quality_rules
from skyframe.llm.sharding import op6_sharding
from skyframe.llm.spelling import op13_spelling_variants
from skyframe.llm.substring_dedup import op10_substring_dedup
from skyframe.llm.token_alignment import op11_token_alignment
from skyframe.llm.token_files import op9_token_files
from skyframe.llm.url_filters import OP7_SQL, op7_url_filters

QUERIES = [op1_license_scan, op2_near_dedup, op3_bpe, op4_lm_score, op5_decontamination, op6_sharding, op7_url_filters, op8_quality_rules, op9_token_files, op10_substring_dedup, op11_token_alignment, op12_line_dedup, op13_spelling_variants]


def queries():
    return {q.__name__: q for q in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    found = {"op7_url_filters": OP7_SQL, "op12_line_dedup": OP12_SQL}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
