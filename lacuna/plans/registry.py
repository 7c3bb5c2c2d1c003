"""Named queries and, where SQL can say the same, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lacuna.plans.ctes import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_TWINS: dict[str, tuple[str, str]] = {}


def query(name: str, needs: str = "", sql: str | None = None):
    """Register a query; ``sql`` is its final SELECT over the subqueries named in ``needs``."""
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            _TWINS[name] = (needs, sql)
        return fn
    return add


def load() -> None:
    """Import every module that registers queries."""
    from lacuna.plans import (q_audit, q_evaluation, q_graph, q_ingest, q_intel, q_reports, q_rules,  # noqa: F401
                              q_scoring, q_stream)


def oracles() -> dict[str, str]:
    """Full SQL text of every twin."""
    return {name: with_ctes(needs, sql) for name, (needs, sql) in _TWINS.items()}
