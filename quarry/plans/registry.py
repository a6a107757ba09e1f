"""Registered queries: a function of the tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.tables import Tables

Plan = Callable[[Tables], DataFrame]
_plans: dict[str, tuple[Plan, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under a name; sql is its DuckDB counterpart, if SQL can express it."""

    def add(plan: Plan) -> Plan:
        if name in _plans:
            raise ValueError(f"{name} is registered twice")
        _plans[name] = (plan, sql)
        return plan

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quarry.plans import datasets, desk, etl, evaluation, mining, ops, retrieval, state, support, text, traces  # noqa: F401  registers

    return {name: (lambda spark, sf_dir, plan=plan: plan(Tables(spark, sf_dir))) for name, (plan, _) in _plans.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {name: sql for name, (_, sql) in _plans.items() if sql}
