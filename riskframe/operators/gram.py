"""Centred cross products of many columns at once (DQ10, ML3, ML12).

One d x d state per group instead of one aggregate expression per pair of columns: every task
folds its Arrow batches into small matrices (for each pair: rows in which both are known, mean,
squared deviations and products of deviations over them), and the states of a
group are merged in any order.  Means are updated as rows come, so sums of
large values do not cancel.  A task holds few states at a time (``STATE_BYTES``) and hands on partial ones beyond;
what is shuffled is matrices, never rows, so a group with a third of all rows is as many
matrices as there are tasks, merged as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: bytes of matrices that a task holds before it hands them on
STATE_BYTES = 64 << 20
_PARTS = ("n", "mean", "var", "cov")


class Moments:
    """State of one group.  Entry (a, b): n rows with both known; mean and squared deviations of a, and
    products of deviations of a and b, over those rows."""

    def __init__(self, n: np.ndarray, mean: np.ndarray, var: np.ndarray, cov: np.ndarray):
        self.n, self.mean, self.var, self.cov = n, mean, var, cov

    @classmethod
    def of(cls, x: np.ndarray, known: np.ndarray) -> Moments:
        count = known.sum(0)
        centre = np.where(known, x, 0.0).sum(0) / np.maximum(count, 1)
        y, m = np.where(known, x - centre, 0.0), known.astype(float)
        n, s, q, p = m.T @ m, y.T @ m, (y * y).T @ m, y.T @ y
        some = np.maximum(n, 1)
        return cls(n, centre[:, None] + s / some, q - s * s / some, p - s * s.T / some)

    def add(self, other: Moments) -> None:
        n = np.maximum(self.n + other.n, 1)
        d = np.where(other.n > 0, other.mean - self.mean, 0.0)
        d = np.where(self.n > 0, d, 0.0)
        w = self.n * other.n / n
        self.var = self.var + other.var + d * d * w
        self.cov = self.cov + other.cov + d * d.T * w
        self.mean = np.where(self.n > 0, self.mean, other.mean) + d * other.n / n
        self.n = self.n + other.n

    def cells(self) -> list:
        return [getattr(self, p).ravel() for p in _PARTS]


def _batch(states: dict, kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*[s.cells() for s in states.values()], strict=True))
    return pa.RecordBatch.from_arrays([pa.array(list(states), kind), *[pa.array(c, pa.list_(pa.float64())) for c in columns]],
                                      ["by", *_PARTS])


def _fold(d: int):
    most = max(1, STATE_BYTES // (8 * len(_PARTS) * d * d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}
        kind = None
        for b in batches:
            kind = b.schema.field("by").type
            flat = b.column("x").flatten()
            x = flat.fill_null(0.0).to_numpy().reshape(-1, d)
            known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, d)
            code = b.column("by").dictionary_encode(null_encoding="encode")
            names, code = code.dictionary.to_pylist(), code.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            for i, rows in enumerate(np.split(order, np.cumsum(np.bincount(code, minlength=len(names)))[:-1])):
                new = Moments.of(x[rows], known[rows])
                if names[i] in states:
                    states[names[i]].add(new)
                else:
                    states[names[i]] = new
                    if len(states) >= most:
                        yield _batch(states, kind)
                        states = {}
        if states:
            yield _batch(states, kind)
    return run


def _merge(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for b in batches:
            kind = b.schema.field("by").type
            for i, by in enumerate(b.column("by").to_pylist()):
                new = Moments(*[b.column(p)[i].values.to_numpy().reshape(d, d) for p in _PARTS])
                if by in state:
                    state[by].add(new)
                    continue
                if state:
                    yield _batch(state, kind)
                state = {by: new}
        if state:
            yield _batch(state, kind)
    return run


def cross_moments(df: DataFrame, features: Sequence[str], by: str | None = None, complete: bool = False) -> DataFrame:
    """(by, n, mean, var, cov): for each group d x d matrices, row after row (see ``Moments``); without
    ``by`` a single group.  ``complete``: only rows in which every feature is known.  No rows: no group."""
    d = len(features)
    rows = df
    if complete:
        for f in features:
            rows = rows.where(F.col(f).isNotNull())
    x = F.array(*[F.col(f).cast("double") for f in features])
    rows = rows.select((F.col(by) if by else F.lit(0)).alias("by"), x.alias("x"))
    schema = f"by {rows.schema['by'].dataType.simpleString()}, " + ", ".join(f"{p} array<double>" for p in _PARTS)
    return (rows.mapInArrow(_fold(d), schema).repartition("by").sortWithinPartitions("by").mapInArrow(_merge(d), schema))


def correlation_pairs(df: DataFrame, features: Sequence[str], name: str = "pearson") -> DataFrame:
    """(column_a, column_b, name): Pearson correlation of every pair over the rows in which both are
    known; null where it is not defined.  A row a pair, unfolded from one matrix by Spark."""
    d, features = len(features), list(features)
    names = F.array(*[F.lit(f) for f in features])
    i, j = F.floor(F.col("at") / d).cast("int"), (F.col("at") % d).cast("int")
    cells = cross_moments(df, features).select(F.posexplode(F.arrays_zip("cov", "var", F.col("n").alias("n"))).alias("at", "c"), F.col("var").alias("vars"))
    cells = cells.where(i < j).withColumn("scale", F.sqrt(F.col("c.var") * F.element_at("vars", j * d + i + 1)))
    r = F.when((F.col("c.n") > 0) & ((F.col("scale") != 0) | F.isnan("scale")), F.col("c.cov") / F.col("scale"))
    some = cells.select(F.get(names, i).alias("column_a"), F.get(names, j).alias("column_b"), r.alias(name))
    if d < 2:
        return some
    # a table without rows has no matrix: its pairs are still listed
    pairs = df.sparkSession.range(d * d).select(F.col("id").alias("at")).where(i < j).select(
        F.get(names, i).alias("column_a"), F.get(names, j).alias("column_b"))
    return pairs.join(some, ["column_a", "column_b"], "left")
