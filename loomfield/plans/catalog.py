"""The registered queries: name, DataFrame plan and, where SQL can express it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

_PLANS: dict[str, Plan] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a plan under a name, with its oracle."""

    def put(plan: Plan) -> Plan:
        if name in _PLANS:
            raise ValueError(f"query {name} is registered twice")
        _PLANS[name] = plan
        if sql:
            _SQL[name] = sql
        return plan

    return put


def _load() -> None:
    from . import compounds, distributions, extracts, networks, records, relations, rollups, series, streams, texts, trends  # noqa: F401
    from . import services, views  # noqa: F401  after the others, whose SQL it uses


def queries() -> dict[str, Plan]:
    _load()
    return dict(_PLANS)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
