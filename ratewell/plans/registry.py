"""All queries of the evaluation jobs, by name."""

from __future__ import annotations

from ratewell.plans import arena_plans, curation_plans, log_plans, score_plans, stats_plans, work_plans

_PLANS = (arena_plans, score_plans, work_plans, curation_plans, stats_plans, log_plans)


def queries() -> dict:
    return {name: f for plans in _PLANS for name, f in plans.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plans in _PLANS for name, sql in plans.SQL.items()}
