"""Two-phase running sums over an ordered value (WIN1; used by ROC/PR/AUC and KS/W1).

A window ordered over the whole table runs in a single task.  Instead the
(already aggregated, one row per distinct value) input is written once to the
shared folder, cut into value-range buckets per group using approximate quantiles
(numbers and times) or sampled values (any other type, text included: what is sampled are
the values themselves, whatever they start with), bucket totals are summed, a tiny window over the bucket totals gives
each bucket its starting offset, and the real running sum runs inside (group,
bucket) in parallel.  Every branch reads the written table, so the source is
scanned once.  Results are exact: rows are ordered by the original column, the
buckets only decide where work is split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import keep
from .keys import join_on

#: rows that one bucket of a group should hold; a group with no more is not split
ROWS_PER_BUCKET = 200_000
#: most split points a group gets (the accuracy of the quantile sketch bounds them)
MAX_BUCKETS = 4096
#: sampled values per bucket where there is no sketch
SAMPLED = 64


def position(df: DataFrame, column: str):
    """What picks a row's bucket, nothing else: a number that never falls while ``column`` rises, or
    the value itself."""
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double") if isinstance(kind, (T.NumericType, T.BooleanType)) else c


def _splits(rows: DataFrame, groups: list, buckets: int, accuracy: int, most: int) -> DataFrame:
    """(groups, _splits): ascending split points of each group into about ``buckets`` ranges of equally many
    values; ``most``: rows of the largest group."""
    if dict(rows.dtypes)["_o"] == "double":
        probs = [i / buckets for i in range(1, buckets)]
        return rows.groupBy(*groups).agg(F.percentile_approx("_o", probs, max(accuracy, 4 * buckets)).alias("_splits"))
    share = min(1.0, SAMPLED * buckets / max(most, 1))
    picked = rows.where(F.col("_o").isNotNull() & (F.pmod(F.xxhash64("_o", F.lit(3)), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))))
    found = picked.groupBy(*groups).agg(F.sort_array(F.collect_list("_o")).alias("_s"))  # about SAMPLED values a bucket
    n = F.least(F.lit(buckets), F.greatest(F.ceil(F.size("_s") / SAMPLED), F.lit(1))).cast("int")
    places = F.transform(F.sequence(F.lit(1), n), lambda i: F.get("_s", F.floor(i * F.size("_s") / n).cast("int")))
    return found.select(*groups, F.array_distinct(F.slice(places, F.lit(1), n - 1)).alias("_splits"))


def count_below(limits, n: int, x, equal: bool = False):
    """How many of the ``n`` ascending ``limits`` (an array column) lie below ``x``, with ``equal``
    also those equal to it: a binary search folded over its step sizes, so the expression stays
    small whatever the number of limits.  Null ``x``: 0."""
    steps = [1 << i for i in reversed(range(max(n, 1).bit_length()))]

    def move(low, step):
        at = F.get(limits, low + step - 1)  # null beyond the end
        return F.when(at <= x if equal else at < x, low + step).otherwise(low)

    return F.aggregate(F.array(*[F.lit(i) for i in steps]), F.lit(0), move)


def bucket_by_value(d: DataFrame, groups: list, buckets: int | None = None, accuracy: int = 10000):
    """Add ``_bk``: the value-range bucket of ``_o`` inside its group (approximate quantile split
    points per group - one partial/final aggregate).  ``d`` must be a written table.

    Only groups of more than ROWS_PER_BUCKET rows are split (all groups if ``buckets`` is given);
    there are at most rows / ROWS_PER_BUCKET of them, however many groups the table has.  The
    split points are written before they are joined, so that Spark knows their size and
    broadcasts them only if it is small."""
    # (not a literal: a join on a constant would be planned as a cross join)
    whole = F.when(F.col("_o").isNull(), F.lit(-1)).otherwise(F.lit(0))
    rows, most = d, None
    if buckets is None:
        big = keep(d.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rows")).where(f"_rows > {ROWS_PER_BUCKET}"), "large-groups")
        most = big.agg(F.max("_rows")).first()[0]
        if most is None:
            return d.withColumn("_bk", whole), groups
        buckets = min(MAX_BUCKETS, -(-most // ROWS_PER_BUCKET))
        rows = join_on(d, big.drop("_rows"), groups, "left_semi")
    if buckets <= 1:
        return d.withColumn("_bk", whole), groups
    splits = keep(_splits(rows, groups, buckets, accuracy, most or d.count()), "splits")
    d = join_on(d, splits, groups, "left")
    inside = count_below(F.col("_splits"), buckets - 1, F.col("_o"))
    return d.withColumn("_bk", F.when(F.col("_splits").isNull(), whole).otherwise(inside)).drop("_splits"), groups


def lay_out(df: DataFrame, groups: list, order: str, buckets: int | None, accuracy: int):
    """``df`` written once, with ``_g`` where there is no group column, ``_o`` and ``_bk``."""
    named = df if groups else df.withColumn("_g", F.lit(0))
    return bucket_by_value(keep(named.withColumn("_o", position(df, order)), "ordered"), groups or ["_g"], buckets, accuracy)


def running_max_before(df: DataFrame, groups: Sequence[str], order: str, value: str,
                       buckets: int | None = None, accuracy: int = 10000, name: str | None = None) -> DataFrame:
    """Add the maximum of ``value`` over the earlier rows of the group (null for the first row).

    Same two phases as ``running_sums``: per (group, bucket) maxima, a tiny window over the
    buckets for the maximum of all earlier buckets, then a window inside (group, bucket) - so
    a group holding a third of the rows is spread over ``buckets`` tasks.  At most one row per
    (groups, order) value.  NaN is not a maximum: it is left out.
    """
    name = name or f"max_before_{value}"
    d, groups = lay_out(df, list(groups), order, buckets, accuracy)
    number = F.when(~F.isnan(value), F.col(value)) if dict(df.dtypes)[value] in ("double", "float") else F.col(value)
    tops = d.groupBy(*groups, "_bk").agg(F.max(number).alias("_top"))
    before_b = Window.partitionBy(*groups).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offs = keep(tops.select(*groups, "_bk", F.max("_top").over(before_b).alias("_prev")), "offsets")
    d = join_on(d, offs, [*groups, "_bk"])
    inside = Window.partitionBy(*groups, "_bk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    here = F.max(number).over(inside)
    # greatest() skips nulls: the first row of the first bucket stays null
    return d.withColumn(name, F.greatest(F.col("_prev"), here)).select(*df.columns, name)


def running_sums(df: DataFrame, groups: Sequence[str], order: str, sums: Sequence[str],
                 descending: bool = False, buckets: int | None = None, accuracy: int = 10000,
                 with_next: bool = False, totals: bool = False) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum in ``order``) for each ``c`` in ``sums``.

    ``df`` must hold at most one row per (groups, order) value.  With ``with_next`` the
    next distinct order value of the group is added as ``next_<order>`` (null on the last
    row), with ``totals`` each group's sum as ``all_<c>``.
    """
    d, groups = lay_out(df, list(groups), order, buckets, accuracy)
    by_bucket = d.groupBy(*groups, "_bk").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums],
                                              F.min(order).alias("_bmin"), F.max(order).alias("_bmax"))
    wb = Window.partitionBy(*groups).orderBy(F.desc("_bk") if descending else F.asc("_bk"))
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    offs = keep(by_bucket.select(
        *groups, "_bk", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sums],
        *[F.sum(f"_t_{c}").over(Window.partitionBy(*groups)).alias(f"all_{c}") for c in sums if totals],
        F.lead("_bmax" if descending else "_bmin").over(wb).alias("_next_b")), "offsets")
    d = join_on(d, offs, [*groups, "_bk"])
    w = Window.partitionBy(*groups, "_bk").orderBy(F.desc(order) if descending else F.asc(order))
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = {f"cum_{c}": F.col(f"_off_{c}") + F.sum(c).over(run) for c in sums}
    if with_next:
        cols[f"next_{order}"] = F.coalesce(F.lead(order).over(w), F.col("_next_b"))
    return d.withColumns(cols).select(*df.columns, *cols, *[f"all_{c}" for c in sums if totals])
