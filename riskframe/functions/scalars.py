"""Scalar column functions (SCL1-SCL9, FLT2 rule predicates).

All return native ``Column`` expressions so they stay inside whole-stage
codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lower=None, upper=None) -> Column:
    """SCL1: clip to [lower, upper]; null stays null.

    ``greatest``/``least`` skip nulls (greatest(NULL, 20) = 20), hence the guard.
    """
    x = col(c)
    out = x
    if lower is not None:
        out = F.greatest(out, F.lit(lower))
    if upper is not None:
        out = F.least(out, F.lit(upper))
    return F.when(x.isNotNull(), out)


def cap(c, ceiling) -> Column:
    """SCL4: values at or above ``ceiling`` become ``ceiling``; null stays null."""
    x = col(c)
    return F.when(x.isNotNull(), F.least(x, F.lit(ceiling)))


def cut_index(c, edges: Sequence[float]) -> Column:
    """SCL2: right-closed bins ``(e[i], e[i+1]]`` -> bin index ``i``.

    The lowest edge is excluded and values outside every bin give null, as a
    right-closed cut does (not Bucketizer/width_bucket, which are left-closed).
    """
    x = col(c)
    lo, hi = edges[0], edges[-1]
    expr = None
    # edges are sorted, so after the range guard the first edge >= x wins
    for i in range(1, len(edges)):
        cond = x <= F.lit(edges[i])
        expr = F.when(cond, F.lit(i - 1)) if expr is None else expr.when(cond, F.lit(i - 1))
    return F.when((x > F.lit(lo)) & (x <= F.lit(hi)), expr)


def edge_text(v) -> str:
    """Edge as printed in a bin label: whole numbers without a decimal point."""
    fv = float(v)
    if fv.is_integer():
        return str(int(fv))
    return repr(fv)


def bin_labels(edges: Sequence[float]) -> list[str]:
    """SCL3: label text ``(a, b]`` of each bin."""
    return [f"({edge_text(a)}, {edge_text(b)}]" for a, b in zip(edges[:-1], edges[1:])]


def label_of_index(idx, edges: Sequence[float], null_label: str | None = None) -> Column:
    """SCL3: bin index -> label text; ``null_label`` (e.g. ``"nan"``) for no bin."""
    labels = F.array(*[F.lit(s) for s in bin_labels(edges)])
    out = F.get(labels, col(idx))
    return F.coalesce(out, F.lit(null_label)) if null_label is not None else out


def cut_label(c, edges: Sequence[float], null_label: str | None = None) -> Column:
    return label_of_index(cut_index(c, edges), edges, null_label)


def recode(c, mapping: Mapping) -> Column:
    """SCL5: replace listed values, keep all others."""
    x = col(c)
    expr = None
    for k, v in mapping.items():
        expr = F.when(x == F.lit(k), F.lit(v)) if expr is None else expr.when(x == F.lit(k), F.lit(v))
    return x if expr is None else expr.otherwise(x)


def value_map(c, mapping: Mapping) -> Column:
    """SCL6: map listed values; all others (and null) become null."""
    x = col(c)
    expr = None
    for k, v in mapping.items():
        expr = F.when(x == F.lit(k), F.lit(v)) if expr is None else expr.when(x == F.lit(k), F.lit(v))
    return expr


def cast_ok(c, dtype: str) -> Column:
    """SCL7: true when the value is null or casts to ``dtype``."""
    x = col(c)
    return x.isNull() | x.try_cast(dtype).isNotNull()


def safe_cast(c, dtype: str) -> Column:
    return col(c).try_cast(dtype)


def ratio(a, b) -> Column:
    """SCL8: a / b, null on null or zero divisor."""
    return F.try_divide(col(a), col(b))


def percent_text(c, digits: int = 2) -> Column:
    """SCL9: share as percent text, e.g. 0.1234 -> '12.34%'."""
    return F.format_string(f"%.{digits}f%%", F.round(col(c) * 100, digits))


def stable_round(c, digits: int = 6) -> Column:
    """Round half-up in decimal after fixing the value to 12 decimals.

    Summation order changes the last bits of a double; going through
    DECIMAL(38, 12) first makes the rounding of exact decimal ties
    (e.g. a mean of 0.0499185) independent of those bits.
    """
    return F.round(col(c).cast("decimal(38,12)"), digits).cast("double")


def rule_violations(rules: Mapping[str, Column]) -> Column:
    """FLT2: array of names of the rules a row breaks (empty when valid).

    ``rules`` maps a rule name to a boolean column that is true when the row
    is *valid*; a null result (missing field) counts as a violation.
    """
    return F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()
    ]))
