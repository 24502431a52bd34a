"""Reproducible splits (SPL1-SPL3) ranked by an md5 of (seed, key).

The md5 order is engine-independent, so the same rows land in the same part
on Spark and on an SQL engine.  Exact stratified ranks need a per-label
running position; a window partitioned by the label alone would put a whole
class (half the data for a binary label) into one task.  Instead rows are
bucketed by the leading hex digits of the hash (the leading sort key), bucket
sizes are aggregated per label, and a small window over those counts gives
each bucket its offset; the row window then runs inside (label, bucket), for a
hold-out only inside the one bucket per label that holds the limit.

``prefix`` hex digits give 16**prefix buckets per label (default 4: 65,536,
so a 10^12-row binary label still sorts only ~8M rows per window task).  The
key must be unique per row for the order to be deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep


def seeded_hash(key, seed: int) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", F.lit(str(seed)), k.cast("string")))


def _placed(df: DataFrame, label: str, key: str, seed: int, prefix: int) -> DataFrame:
    """Adds ``_b`` (bucket), its size ``_nb``, ``_off`` (rows of the label in the buckets before it) and ``_nl`` (label size)."""
    d = df.withColumn("_b", F.substring(seeded_hash(key, seed), 1, prefix))
    counts = d.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_nb"))
    wl = Window.partitionBy(label)
    offs = counts.select(F.col(label).alias("_lbl"), F.col("_b").alias("_ob"), "_nb",
                         (F.sum("_nb").over(wl.orderBy("_b")) - F.col("_nb")).alias("_off"),
                         F.sum("_nb").over(wl).alias("_nl"))
    # offsets: one row per (label, bucket), written, so that Spark knows their size and broadcasts them when
    # small without moving the rows.  Null-safe on the label so rows with a missing label form
    # their own stratum instead of being dropped.
    offs = keep(offs, "split-offsets")
    return d.join(offs, d[label].eqNullSafe(offs["_lbl"]) & (d["_b"] == offs["_ob"])).drop("_lbl", "_ob")


def _ranked(placed: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Adds ``_rank`` (1-based position by hash inside the label); the hash itself is not moved."""
    d = placed.repartition(label, "_b").withColumn("_h", seeded_hash(key, seed))
    # a number first: rows of different buckets are told apart without comparing texts
    d = d.withColumn("_x", F.xxhash64(label, "_b"))
    rn = F.row_number().over(Window.partitionBy("_x", label, "_b").orderBy("_h", key))
    return d.withColumn("_rank", F.col("_off") + rn).drop("_x")


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 1961,
                     prefix: int = 4, split_col: str = "split") -> DataFrame:
    """SPL1: exactly round(test_share * n) rows of each label value go to 'test'.

    A bucket that lies before or behind its label's limit is decided as a whole; only the rows of the
    bucket with the limit are ranked, so the others are not moved."""
    d = _placed(df, label, key, seed, prefix)
    limit = F.round(F.lit(test_share) * F.col("_nl"))
    cut = (F.col("_off") < limit) & (F.col("_off") + F.col("_nb") > limit)
    whole = d.where(~cut).withColumn(split_col, F.when(F.col("_off") < limit, "test").otherwise("train"))
    ranked = _ranked(d.where(cut), label, key, seed).withColumn(split_col, F.when(F.col("_rank") <= limit, "test").otherwise("train"))
    columns = [c for c in df.columns if c != split_col] + [split_col]
    return whole.select(*columns).unionAll(ranked.select(*columns))


def random_split(df: DataFrame, key: str, test_share: float, seed: int = 1961,
                 split_col: str = "split") -> DataFrame:
    """SPL2: plain seeded hold-out, map-only: leading 8 hex digits of the hash below a threshold."""
    threshold = format(int(round(test_share * 16 ** 8)), "08x")
    is_test = F.substring(seeded_hash(key, seed), 1, 8) < F.lit(threshold)
    return df.withColumn(split_col, F.when(is_test, "test").otherwise("train"))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 1,
                     prefix: int = 4, fold_col: str = "fold") -> DataFrame:
    """SPL3: stratified k-fold id = (hash rank inside the label - 1) mod k."""
    r = _ranked(_placed(df, label, key, seed, prefix), label, key, seed)
    return r.withColumn(fold_col, ((F.col("_rank") - 1) % k).cast("int")).drop("_h", "_b", "_nb", "_off", "_nl", "_rank")
