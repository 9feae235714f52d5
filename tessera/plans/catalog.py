"""All registered queries of the engine, and their SQL for DuckDB."""

from __future__ import annotations

from . import query_plans, state_plans, surface_plans, text_plans

QUERIES = query_plans.QUERIES | state_plans.QUERIES | text_plans.QUERIES | surface_plans.QUERIES
ORACLES = query_plans.ORACLES | state_plans.ORACLES | text_plans.ORACLES | surface_plans.ORACLES
