"""All registered queries of the training-data operators, and their SQL for DuckDB."""

from __future__ import annotations

from . import bpe, chat_format, decontaminate, exact_dedup, jaccard_join, language_id, license_scan, quality, substring_dedup, token_counts

MODULES = [quality, license_scan, jaccard_join, substring_dedup, exact_dedup, decontaminate, bpe, language_id, token_counts, chat_format]

QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
