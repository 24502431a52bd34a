"""Registry of demo queries over the driver tables and their DuckDB oracles.

Each query is ``f(spark, sf_dir) -> DataFrame`` and reads only the given
tables (or data Spark derives from them).  ``sql`` is the equivalent DuckDB
statement over the pre-registered views; ``None`` marks a fitted-model query
checked on rows only.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every catalog module so its queries register."""
    from . import (q_sources, q_scalars, q_aggregates, q_joins_split, q_metrics,  # noqa: F401
                   q_quality, q_drift, q_features, q_training, q_selection, q_streaming)
