"""Ordered target statistics: categories as numbers without one-hot and without leakage (ML6).

A training row's category becomes the mean label of the rows with the same category that come
before it in a seeded permutation, with ``weight`` rows of the overall mean added; a row never
sees its own label or a later one.  The sums over earlier rows are two-phase running sums, so
a category that holds a third of the rows is spread over many tasks.  Rows to score get the
statistics of all training rows; an unseen category gets the overall mean.  Null is a category.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep
from . import prefix
from .keys import join_on

#: added to the names of encoded columns
ENCODED = "_ts"


def _cells(df: DataFrame, columns: Sequence[str], *more) -> DataFrame:
    """One row per (row, column): column, value as text and what else is given."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(*more, F.explode(pairs).alias("s")).select("*", "s.column", "s.value").drop("s")


def _wide(df: DataFrame, stats: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``df`` with the statistic of each row's key and value per column."""
    stats = keep(stats.select("column", "value", "_key", "_stat"), "target-means")
    for c in columns:
        mine = stats.where(F.col("column") == c).select("value", "_key", F.col("_stat").alias(c + ENCODED))
        df = df.join(mine, (df[key] == F.col("_key")) & df[c].cast("string").eqNullSafe(F.col("value")), "left").drop("value", "_key")
    return df


def ordered_target_means(df: DataFrame, key: str, label: str, columns: Sequence[str], seed: int = 1961,
                         weight: float = 1.0) -> DataFrame:
    """``df`` (a written table: it is read three times; non-null ``key``; label 0/1) with ``<column>_ts`` from the rows
    before each in the order of md5("seed:key"); rows with equal keys are not before each other.

    Rows move once for all columns, to buckets of the md5 (evenly filled, whatever the table holds).  What
    the buckets before it hold of a category comes from counts per (column, value, bucket)."""
    names = df.columns
    n, prior = df.agg(F.count(F.lit(1)), F.avg(F.col(label).cast("double"))).first()
    prior, buckets = prior or 0.0, max(1, -(-n // prefix.ROWS_PER_BUCKET))
    md5 = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    # 28 bits of the md5 make the bucket: it never falls while the md5 rises
    at = F.floor(F.conv(F.substring(md5, 1, 7), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 28)).cast("int")
    # rows without a key come before all others and get no statistic, so they are only dealt out
    spread = F.lit(-1) - F.pmod(F.monotonically_increasing_id(), F.lit(buckets)).cast("int")
    counted = _cells(df, columns, F.coalesce(at, F.lit(-1)).alias("_bk"), F.col(label).cast("double").alias("_y"))
    totals = counted.groupBy("column", "value", "_bk").agg(F.sum("_y").alias("_y"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("column", "value").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    before = keep(totals.select("column", "value", "_bk", F.coalesce(F.sum("_y").over(earlier), F.lit(0.0)).alias("_oy"),
                                F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_on")).where("_bk >= 0"), "target-offsets")
    d = (df.withColumn("_bk", F.coalesce(at, spread)).repartition(buckets, "_bk")
         .withColumn("_place", F.concat(md5, F.lit(":"), F.col(key).cast("string"))).withColumn("_y", F.col(label).cast("double")))
    for i, c in enumerate(columns):
        d = d.withColumn("_v", F.col(c).cast("string"))
        alike = Window.partitionBy("_bk", "_v")
        # up to and with the rows of the same key; those alone
        run, own = alike.orderBy("_place").rangeBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("_bk", "_v", "_place")
        d = d.withColumns({f"_y{i}": F.sum("_y").over(run), f"_n{i}": F.count(F.lit(1)).over(run)})
        d = d.withColumns({f"_y{i}": F.col(f"_y{i}") - F.sum("_y").over(own), f"_n{i}": F.col(f"_n{i}") - F.count(F.lit(1)).over(own)})
        mine = before.where(F.col("column") == c).select(F.col("_bk").alias("_ob"), F.col("value").alias("_ov"), "_oy", "_on")
        d = d.join(mine, (F.col("_bk") == F.col("_ob")) & F.col("_v").eqNullSafe(F.col("_ov")), "left")
        stat = (F.col("_oy") + F.col(f"_y{i}") + F.lit(weight * prior)) / (F.col("_on") + F.col(f"_n{i}") + F.lit(weight))
        d = d.withColumn(c + ENCODED, stat).drop("_v", "_ob", "_ov", "_oy", "_on", f"_y{i}", f"_n{i}")
    return d.select(*names, *[c + ENCODED for c in columns])


def fit_target_means(df: DataFrame, label: str, columns: Sequence[str], weight: float = 1.0) -> tuple[DataFrame, float]:
    """((column, value, stat), overall mean) of all rows, for rows to score."""
    prior = df.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    stat = (F.sum("_y") + F.lit(weight * prior)) / (F.count(F.lit(1)) + F.lit(weight))
    return keep(_cells(df, columns, F.col(label).cast("double").alias("_y")).groupBy("column", "value").agg(stat.alias("stat")),
                "target-means"), prior


def apply_target_means(df: DataFrame, key: str, columns: Sequence[str], fitted: tuple[DataFrame, float]) -> DataFrame:
    """``df`` (non-null ``key``) with ``<column>_ts`` from ``fit_target_means``."""
    table, prior = fitted
    cells = join_on(_cells(df, columns, F.col(key).alias("_key")).distinct(), table, ["column", "value"], "left")
    return _wide(df, cells.withColumn("_stat", F.coalesce("stat", F.lit(prior))), key, columns)
