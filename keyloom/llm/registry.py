"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import decontamination, exact_dedup, html_extraction, line_dedup, lm_scoring, packing, quality_resampling, simhash_dedup, token_counts, toxicity

MODULES = (lm_scoring, exact_dedup, line_dedup, token_counts, toxicity, decontamination, packing, html_extraction, quality_resampling, simhash_dedup)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
