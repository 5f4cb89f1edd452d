"""Registered queries: each name maps a Spark plan to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"duplicate query {name}")
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan
    return register


def load() -> None:
    """Import the modules whose decorators fill the registry."""
    from voxloom.catalog import (  # noqa: F401
        arrays,
        datasets,
        evaluation,
        files,
        fullsize,
        graphs,
        labels,
        morphology,
        shapes,
        spatial,
        store,
    )
