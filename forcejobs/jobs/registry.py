"""Registered queries of the force-trace jobs and the SQL that checks them."""

from __future__ import annotations

from . import batch_queries, cohort_queries, detail_queries, model_queries, phase_queries, run_queries, trial_queries, wave_queries

MODULES = (trial_queries, phase_queries, model_queries, cohort_queries, run_queries, detail_queries, wave_queries, batch_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
