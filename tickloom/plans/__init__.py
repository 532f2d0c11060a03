"""Registered queries of the market operators and their SQL counterparts."""

from tickloom.plans import explore_queries, feature_queries, fit_queries, job_queries, ledger_queries, live_queries, model_queries, quality_queries, stateful_queries, study_queries  # noqa: F401
from tickloom.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
