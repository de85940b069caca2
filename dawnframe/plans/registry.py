"""Every registered query of the library and its SQL counterpart.

A query takes ``(spark, sf_dir)`` and applies one operator to whole tables.  The modules ``*_queries`` register
themselves when they are imported.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

FLAGSHIP = "t9_regime_snapshot"
MODULES = ("series", "quotes", "signals", "news", "places", "registry", "runs")
QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()) -> Callable:
    """Register a function as a query; ``sql`` is what DuckDB runs on the same tables.

    ``dates`` columns are returned as ISO text by both, since the two engines' clients hand out dates as different types.
    """

    def register(made: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = (lambda spark, sf_dir: (found := made(spark, sf_dir)).withColumns({c: found[c].cast("string") for c in dates})) if dates else made
        if sql:
            as_text = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
            ORACLE_SQL[name] = f"SELECT * REPLACE ({as_text}) FROM ({sql})" if dates else sql
        return made

    return register


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"dawnframe.plans.{module}_queries")
