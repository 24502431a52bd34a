"""Null-safe equi-joins on group keys (a null group is a group, not a dropped row)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` with ``<=>`` so null keys match each other; one copy of each key."""
    keys = list(keys)
    if not keys:
        raise ValueError("join_on needs at least one key")
    r = right.select(*[right[k].alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys])
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])
