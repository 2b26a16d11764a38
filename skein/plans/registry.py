"""Queries by name, each with the SQL that says the same to another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.checks import checked
from ..sources.adapter import PRELUDE, Telemetry, load

PLANS: dict[str, Callable[[Telemetry], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan; ``sql`` follows the adapter's common table expressions."""

    def add(plan):
        plan = checked(plan)
        PLANS[name] = plan
        if sql:
            rest = sql.strip()
            SQL[name] = f"{PRELUDE}\n{rest}" if rest.startswith(",") or rest.upper().startswith("SELECT") else rest
        return plan

    return add


def bound() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import blocks, cores, guarantees, inventory, network, nodes, packages, rollups, search, timelines  # noqa: F401

    rollups.stored_forms()

    return {name: (lambda spark, sf_dir, plan=plan: plan(load(spark, sf_dir))) for name, plan in PLANS.items()}
