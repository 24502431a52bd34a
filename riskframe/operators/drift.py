"""Two-sample drift statistics between a reference and a current table (DR1-DR5).

Both sides are unpivoted once to (column, value) rows tagged by side and counted
per (column, value); these counts are written once, so each side is scanned a
single time for all columns and statistics.  Per-column running sums (two-phase,
see ``prefix``) give the distribution-function statistics.

Every column asked for gets a row.  A column without values on both sides has not
drifted (statistic 0); one that has values on one side only has (numeric: infinite
distance, categorical: the largest Jensen-Shannon distance).  NaN counts as no value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..config import DriftConfig
from ..session import keep
from .prefix import running_sums

#: least deviation by which a distance is normed, so that a constant reference has a verdict
LEAST_DEVIATION = 1e-3
#: Jensen-Shannon distance (natural logarithm) of distributions without a common value
LARGEST_JS = math.sqrt(math.log(2.0))


def _stack(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], side: int) -> DataFrame:
    def cell(c, number, text):
        return F.struct(F.lit(c).alias("column"), number.cast("double").alias("value"), text.cast("string").alias("text"))

    cells = [cell(c, F.col(c), F.lit(None)) for c in numeric] + [cell(c, F.lit(None), F.col(c)) for c in categorical]
    return df.select(F.explode(F.array(*cells)).alias("s")).select("s.*", F.lit(side).alias("side"))


def counts_by_side(reference: DataFrame, current: DataFrame, numeric: Sequence[str] = (),
                   categorical: Sequence[str] = ()) -> DataFrame:
    """(column, value, text, ref_n, cur_n) for the values of both sides, written once: numeric
    columns in ``value``, categorical ones in ``text``."""
    u = _stack(reference, numeric, categorical, 0).unionByName(_stack(current, numeric, categorical, 1))
    u = u.where((F.col("value").isNotNull() & ~F.isnan("value")) | F.col("text").isNotNull())
    return keep(u.groupBy("column", "value", "text").agg(F.count_if(F.col("side") == 0).alias("ref_n"),
                                                         F.count_if(F.col("side") == 1).alias("cur_n")), "drift-counts")


def _all_columns(found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for every column asked for; one without any value has counts of zero."""
    named = found.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    return named.join(found, "column", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("ref_rows", "cur_rows")})


def ks_pvalue(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value (Kolmogorov distribution tail).

    Uses the alternating series for large arguments and the Jacobi-transformed
    series for small ones, 100 terms each, clipped to [0, 1].
    """
    en = F.sqrt(n * m / (n + m))
    lam = (en + 0.12 + 0.11 / en) * d
    js = F.sequence(F.lit(1), F.lit(100))
    big = F.aggregate(js, F.lit(0.0), lambda acc, j: acc + 2 * F.pow(F.lit(-1.0), j - 1) * F.exp(-2 * j * j * lam * lam))
    small = 1 - math.sqrt(2 * math.pi) / lam * F.aggregate(
        js, F.lit(0.0), lambda acc, j: acc + F.exp(-(2 * j - 1) * (2 * j - 1) * math.pi ** 2 / (8 * lam * lam)))
    p = F.when(lam <= 0, F.lit(1.0)).when(lam < 1.18, small).otherwise(big)
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def numeric_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str],
                  buckets: int | None = None) -> DataFrame:
    """DR1 + DR2 per column: KS statistic and p-value, Wasserstein-1 distance, and W1 divided by
    the reference's population standard deviation (``LEAST_DEVIATION`` at least)."""
    return _numeric(counts_by_side(reference, current, columns), columns, buckets)


def _numeric(counts: DataFrame, columns: Sequence[str], buckets: int | None) -> DataFrame:
    c = counts.where("value is not null").select("column", "value", "ref_n", "cur_n")
    mean = F.try_divide(F.sum(F.col("ref_n") * F.col("value")), F.sum("ref_n"))
    tot = keep(c.groupBy("column").agg(F.sum("ref_n").alias("_N"), F.sum("cur_n").alias("_M"), mean.alias("_mean")), "totals")
    both = c.join(tot, "column")
    # centred on the mean first: squares of large values would cancel
    spread = F.try_divide(F.sum(F.col("ref_n") * F.pow(F.col("value") - F.col("_mean"), 2)), F.sum("ref_n"))
    deviation = both.groupBy("column").agg(F.sqrt(spread).alias("_std"))
    r = running_sums(c, ["column"], "value", ["ref_n", "cur_n"], buckets=buckets, with_next=True).join(tot, "column")
    diff = F.abs(F.try_divide(F.col("cum_ref_n"), F.col("_N")) - F.try_divide(F.col("cum_cur_n"), F.col("_M")))
    step = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))
    s = (r.groupBy("column", "_N", "_M").agg(F.max(diff).alias("ks_statistic"), F.sum(diff * step).alias("wasserstein"))
         .join(deviation, "column"))
    found = s.select("column", F.col("_N").alias("ref_rows"), F.col("_M").alias("cur_rows"), "ks_statistic", "wasserstein", "_std")
    n, m = F.col("ref_rows"), F.col("cur_rows")
    p = F.when((n > 0) & (m > 0), ks_pvalue(F.col("ks_statistic"), F.greatest(n, F.lit(1)).cast("double"),
                                            F.greatest(m, F.lit(1)).cast("double")))
    normed = (F.when((n == 0) & (m == 0), F.lit(0.0)).when((n == 0) | (m == 0), F.lit(float("inf")))
              .otherwise(F.col("wasserstein") / F.greatest(F.col("_std"), F.lit(LEAST_DEVIATION))))
    return _all_columns(found, columns).select("column", "ref_rows", "cur_rows", "ks_statistic", p.alias("ks_pvalue"),
                                               "wasserstein", normed.alias("wasserstein_norm"))


def _gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): series below a+1, continued fraction above."""
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    gln = math.lgamma(a)
    if x < a + 1:
        ap, s, d = a, 1.0 / a, 1.0 / a
        for _ in range(1000):
            ap += 1
            d *= x / ap
            s += d
            if abs(d) < abs(s) * 1e-15:
                break
        return max(0.0, 1.0 - s * math.exp(-x + a * math.log(x) - gln))
    tiny = 1e-300
    b, c, d = x + 1 - a, 1.0 / tiny, 1.0 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        de = d * c
        h *= de
        if abs(de - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - gln) * h


def chi2_sf_udf():
    """Pandas UDF: chi-square upper tail Q(dof/2, stat/2); applied to one row per column."""
    tail = _gammaincc

    def sf(stat: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([tail(k / 2.0, x / 2.0) if k and k > 0 and x == x else float("nan")
                          for x, k in zip(stat, dof)])
    return F.pandas_udf(sf, DoubleType())


def categorical_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """DR3 + DR4 per column: Jensen-Shannon distance (natural log, 0 ln 0 = 0) and the
    chi-square statistic of current counts against reference shares (+ dof, p-value)."""
    return _categorical(counts_by_side(reference, current, (), columns), columns)


def _categorical(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    c = counts.where("text is not null").select("column", "text", "ref_n", "cur_n")
    tot = keep(c.groupBy("column").agg(F.sum("ref_n").alias("_N"), F.sum("cur_n").alias("_M")), "totals")
    r = c.join(tot, "column")
    p, q = F.try_divide(F.col("ref_n"), F.col("_N")), F.try_divide(F.col("cur_n"), F.col("_M"))
    m = (p + q) / 2

    def kl(a):
        return F.when(a > 0, a * F.log(a / m)).otherwise(F.lit(0.0))

    expected = p * F.col("_M")
    chi = F.when(expected > 0, F.pow(F.col("cur_n") - expected, 2) / expected).otherwise(
        F.when(F.col("cur_n") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))
    s = r.groupBy("column", "_N", "_M").agg(
        F.sqrt(F.greatest(F.sum(0.5 * kl(p) + 0.5 * kl(q)), F.lit(0.0))).alias("js"),
        F.sum(chi).alias("chi"), (F.count(F.lit(1)) - 1).alias("dof"))
    found = s.select("column", F.col("_N").alias("ref_rows"), F.col("_M").alias("cur_rows"), "js", "chi", "dof")
    n, k = F.col("ref_rows"), F.col("cur_rows")
    both = (n > 0) & (k > 0)
    js = F.when(both, F.col("js")).when((n == 0) & (k == 0), F.lit(0.0)).otherwise(F.lit(LARGEST_JS))
    return _all_columns(found, columns).select("column", "ref_rows", "cur_rows", js.alias("js_distance"),
                                               F.when(both, F.col("chi")).alias("chi2_statistic"),
                                               F.when(both, F.col("dof")).alias("chi2_dof"))


def with_chi2_pvalue(cat: DataFrame) -> DataFrame:
    return cat.withColumn("chi2_pvalue", chi2_sf_udf()(F.col("chi2_statistic"), F.col("chi2_dof").cast("double")))


def drift_table(reference: DataFrame, current: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """DR5: one row per column: kind, test, statistic, threshold, drifted."""
    counts = counts_by_side(reference, current, numeric, categorical)
    parts = []
    if numeric:
        parts.append(_numeric(counts, numeric, cfg.prefix_buckets).select(
            "column", F.lit("num").alias("kind"), F.lit("wasserstein_norm").alias("stat_test"),
            F.col("wasserstein_norm").alias("statistic"), F.lit(cfg.numeric_threshold).alias("threshold")))
    if categorical:
        parts.append(_categorical(counts, categorical).select(
            "column", F.lit("cat").alias("kind"), F.lit("jensenshannon").alias("stat_test"),
            F.col("js_distance").alias("statistic"), F.lit(cfg.categorical_threshold).alias("threshold")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("drifted", F.col("statistic") >= F.col("threshold"))


def dataset_drift(table: DataFrame, cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """DR5 verdict: share of drifted columns and whether it reaches the dataset threshold."""
    return table.agg(F.count(F.lit(1)).alias("n_columns"), F.count_if("drifted").alias("n_drifted")).select(
        "n_columns", "n_drifted", (F.col("n_drifted") / F.col("n_columns")).alias("share_drifted"),
        (F.col("n_drifted") / F.col("n_columns") >= F.lit(cfg.dataset_share)).alias("dataset_drift"))
