"""Exploratory aggregates (AGG1-AGG14, JOIN3 zero-fill, SET2, SRT1-2).

Every operator aggregates first (partial + final aggregation, so a hot key
is combined map-side) and only then applies windows, which run over the
already-aggregated rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bin_labels, col
from ..session import keep
from .keys import join_on


def group_count(df: DataFrame, keys: Sequence[str], name: str = "count") -> DataFrame:
    """AGG1: row count per key combination."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def value_counts(df: DataFrame, c: str, name: str = "count") -> DataFrame:
    """AGG2: counts of each non-null value, most frequent first (ties by value)."""
    return (df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias(name))
            .orderBy(F.desc(name), F.asc(c)))


def value_shares(df: DataFrame, c: str, name: str = "share") -> DataFrame:
    """AGG3: share of each non-null value.

    The counts are written once and their total is one scalar read from them, so the source is
    scanned a single time and the per-value rows are never funnelled through a single
    un-partitioned window, however many distinct values there are.
    """
    counts = keep(df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n")), "value-counts")
    total = counts.agg(F.sum("_n")).first()[0] or 1
    return counts.select(c, (F.col("_n") / F.lit(total)).alias(name))


def group_shares(df: DataFrame, keys: Sequence[str], value: str,
                 name: str = "share", count_name: str | None = None) -> DataFrame:
    """AGG4: share of each value inside its group (normalised value counts per group)."""
    counts = (df.where(F.col(value).isNotNull())
              .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    w = Window.partitionBy(*keys)
    cols = [*keys, value, (F.col("_n") / F.sum("_n").over(w)).alias(name)]
    if count_name:
        cols.append(F.col("_n").alias(count_name))
    return counts.select(*cols)


def group_mean(df: DataFrame, keys: Sequence[str], value, name: str = "mean") -> DataFrame:
    """AGG5/AGG6: mean per group (bar heights when keys = (x, hue))."""
    return df.groupBy(*keys).agg(F.avg(col(value)).alias(name))


def pivot_counts(df: DataFrame, key: str, pivot: str, values: Sequence,
                 prefix: str = "n_") -> DataFrame:
    """AGG8: class counts pivoted to columns, plus each class's ratio to the row total.

    Pivot values are given, so no extra distinct job runs; a missing cell is null
    and so are its ratios.
    """
    p = df.groupBy(key).pivot(pivot, list(values)).count()
    names = [str(v) for v in values]
    p = p.select(key, *[F.col(f"`{n}`").alias(f"{prefix}{n}") for n in names])
    total = sum((F.coalesce(F.col(f"{prefix}{n}"), F.lit(0)) for n in names), F.lit(0))
    return p.select("*", *[F.try_divide(F.col(f"{prefix}{n}"), total).alias(f"share_{n}") for n in names])


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """AGG9: nulls per column in one pass, returned long (column, null_count)."""
    columns = list(columns or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return _long(wide, columns, "null_count")


def table_info(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """AGG10: type and non-null count per column (one pass)."""
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    wide = df.agg(*[F.count(F.col(c)).alias(c) for c in columns])
    long = _long(wide, columns, "non_null")
    type_map = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(types[c]))])
    return long.select("column", F.element_at(type_map, F.col("column")).alias("dtype"), "non_null")


def quantile(x: Column, p: float, exact: bool, accuracy: int = 10000) -> Column:
    """Exact (``percentile``: linear interpolation, keeps a value->count map per group, so its
    memory grows with the distinct values of a group) or sketch (``percentile_approx``,
    bounded memory, relative rank error 1/accuracy)."""
    if exact:
        return F.percentile(x, F.lit(p))
    return F.percentile_approx(x, p, accuracy).cast("double")


def _stack_values(df: DataFrame, columns: Sequence[str], groups: Sequence[str]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*groups, F.explode(arr).alias("_s")).select(*groups, "_s.column", "_s.value")


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], groups: Sequence[str] = (),
              exact: bool = False, accuracy: int = 10000, buckets: int | None = None) -> DataFrame:
    """Quantiles of several columns (per group) as long rows (groups, column, p, value).

    ``exact=True``: linear interpolation between the order statistics at (n-1)p, computed
    without any per-group value buffer: counts per distinct (group, column, value), written
    once, are cut into value-range buckets (``prefix.bucket_by_value``); bucket totals locate the bucket of
    each wanted rank (floor and ceil of (n-1)p), and only those buckets are sorted.
    ``exact=False``: ``percentile_approx`` sketches, one aggregation.
    """
    groups = list(groups)
    st = _stack_values(df, columns, groups).where(F.col("value").isNotNull())
    keys = [*groups, "column"]
    if not exact:
        a = st.groupBy(*keys).agg(F.percentile_approx("value", list(probs), accuracy).alias("_q"))
        return a.select(*keys, F.posexplode("_q").alias("_i", "value")).select(
            *keys, F.get(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i")).alias("p"),
            F.col("value").cast("double").alias("value"))
    return quantiles_of_counts(value_counts_of(st, keys), keys, probs, accuracy, buckets)


def value_counts_of(stacked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, value, n) of the non-null values, written once: several statistics read it."""
    return keep(stacked.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n")), "value-counts")


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], probs: Sequence[float], accuracy: int = 10000,
                        buckets: int | None = None) -> DataFrame:
    """Exact quantiles (keys, p, value) of a written table of (keys, value, n)."""
    from .prefix import bucket_by_value
    # value-range buckets per key; only the buckets holding a wanted rank are ever sorted
    d, _ = bucket_by_value(counts.withColumn("_o", F.col("value")), list(keys), buckets, accuracy)
    tot = d.groupBy(*keys, "_bk").agg(F.sum("n").alias("_t"))
    wb = Window.partitionBy(*keys).orderBy("_bk")
    offs = tot.select(*keys, "_bk", "_t",
                      F.coalesce(F.sum("_t").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
                      F.sum("_t").over(Window.partitionBy(*keys)).alias("_N"))
    t = offs.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
    h = (F.col("_N") - 1) * F.col("p")
    lo = F.floor(h)
    hi = F.when(h > lo, lo + 1).otherwise(lo)
    t = t.select(*keys, "_bk", "_t", "_off", "_N", "p", F.explode(F.array(
        F.struct(F.lit("lo").alias("which"), lo.alias("r")),
        F.struct(F.lit("hi").alias("which"), hi.alias("r")))).alias("tg")).select(
        *keys, "_bk", "_off", "_N", "p", "tg.which", "tg.r",
        ((F.col("_off") <= F.col("tg.r")) & (F.col("tg.r") < F.col("_off") + F.col("_t"))).alias("_in"))
    t = t.where("_in").drop("_in")
    sel = join_on(d, t, [*keys, "_bk"])
    w = Window.partitionBy(*keys, "_bk", "p", "which").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    sel = sel.withColumn("_cum", F.col("_off") + F.sum("n").over(w))
    hit = sel.where((F.col("_cum") - F.col("n") <= F.col("r")) & (F.col("r") < F.col("_cum")))
    v = hit.groupBy(*keys, "p", "_N").agg(F.max(F.when(F.col("which") == "lo", F.col("value"))).alias("_vlo"),
                                          F.max(F.when(F.col("which") == "hi", F.col("value"))).alias("_vhi"))
    hh = (F.col("_N") - 1) * F.col("p")
    frac = hh - F.floor(hh)
    val = F.when(frac > 0, F.col("_vlo") + frac * (F.col("_vhi") - F.col("_vlo"))).otherwise(F.col("_vlo"))
    return v.select(*keys, "p", val.alias("value"))


def quantile_columns(q: DataFrame, keys: Sequence[str], names: dict) -> DataFrame:
    """Long quantile rows -> one row per key with a column per probability (``names``: p -> name)."""
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("value"))).alias(n)
                                  for p, n in names.items()])


def describe(df: DataFrame, columns: Sequence[str], exact: bool = False) -> DataFrame:
    """AGG11: transposed describe: count, mean, std, min, 25/50/75 %, max per column.

    The source is scanned once: with sketches (the default) everything is one aggregation;
    ``exact=True`` counts the distinct values and takes all statistics from the counts.
    """
    names = ("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")
    if exact:
        st = _stack_values(df, columns, ()).where(F.col("value").isNotNull())
        return _describe_counts(value_counts_of(st, ["column"]), columns).select(*names)
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"),
                             F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
                             F.percentile_approx(x, [0.25, 0.5, 0.75], 10000).alias("q")).alias(c))
    wide = df.agg(*aggs)
    s = wide.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("s")).select("s.*")
    return s.select(*names[:5], *[F.get("q", i).cast("double").alias(n) for i, n in enumerate(names[5:8])], "max")


def _describe_counts(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Moments and quartiles per column from (column, value, n); columns without values included."""
    v, n = F.col("value"), F.col("n")
    base = keep(counts.groupBy("column").agg(F.sum(n).alias("count"), (F.sum(v * n) / F.sum(n)).alias("mean"),
                                             F.min(v).alias("min"), F.max(v).alias("max")), "moments")
    # deviations from the mean: sums of squares of large values would cancel
    around = counts.join(base.select("column", "mean", "count"), "column")
    std = around.groupBy("column", "count").agg(F.sum(n * F.pow(v - F.col("mean"), 2)).alias("_ss")).select(
        "column", F.when(F.col("count") > 1, F.sqrt(F.col("_ss") / F.greatest(F.col("count") - 1, F.lit(1)))).alias("std"))
    q = quantile_columns(quantiles_of_counts(counts, ["column"], (0.25, 0.5, 0.75)), ["column"],
                         {0.25: "p25", 0.5: "p50", 0.75: "p75"})
    named = counts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    out = named.join(base, "column", "left").join(std, "column", "left").join(q, "column", "left")
    return out.withColumn("count", F.coalesce("count", F.lit(0)))


def _long(wide: DataFrame, columns: Sequence[str], value_name: str) -> DataFrame:
    """Unpivot a one-row wide aggregate to (column, value)."""
    return wide.unpivot([], list(columns), "column", value_name)


def bin_dimension(spark, edges: Sequence[float], index_name: str = "bin",
                  label_name: str = "bin_label") -> DataFrame:
    """Fixed-size bin table (index, label, lower, upper) built from config edges."""
    labels = bin_labels(edges)
    rows = [(i, labels[i], float(edges[i]), float(edges[i + 1])) for i in range(len(labels))]
    return spark.createDataFrame(rows, f"{index_name} int, {label_name} string, lower double, upper double")


def zero_fill_bins(counts: DataFrame, edges: Sequence[float], keys_dim: DataFrame | None = None,
                   index_name: str = "bin", fill_cols: Sequence[str] = ("count",)) -> DataFrame:
    """JOIN3: list every bin (for every key row of ``keys_dim``), empty ones with 0.

    The bin list has a fixed size from the config (len(edges)-1), so the full
    (key, bin) frame is generated by exploding a literal sequence next to the
    aggregated key rows; no cross join and no broadcast of data-sized input.
    """
    spark = counts.sparkSession
    nb = len(edges) - 1
    labels = F.array(*[F.lit(s) for s in bin_labels(edges)])
    if keys_dim is None:
        dim = bin_dimension(spark, edges, index_name)
        keys = []
    else:
        keys = list(keys_dim.columns)
        dim = keys_dim.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias(index_name))
        dim = dim.select("*", F.get(labels, F.col(index_name)).alias("bin_label"))
    out = join_on(dim, counts, [*keys, index_name], "left")
    return out.fillna(0, subset=list(fill_cols))


def histogram(df: DataFrame, c: str, nbins: int = 20) -> DataFrame:
    """AGG12: equal-width histogram over [min, max]; max folds into the last bin.

    One tiny job fetches (min, max) - a single row - then binning is a map-side
    expression and the count a partial/final aggregation.
    """
    x = F.col(c).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, count bigint")
    width = (hi - lo) / nbins
    b = F.lit(0) if hi == lo else F.least(F.floor((x - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(nbins - 1))
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(hi - lo) / nbins).alias("lower"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(hi - lo) / nbins).alias("upper"),
        "count")


def density_curve(df: DataFrame, c: str, grid: Sequence[float], bandwidth: float,
                  group: str | None = None, prebin_width: float | str | None = "auto") -> DataFrame:
    """AGG13: Gaussian kernel density on a fixed grid, optionally per group.

    The sample is first collapsed to (value-bin, n) rows; each aggregated row
    is expanded over the grid (a fixed-size literal from the caller), so cost
    is bins x grid, never rows x grid.  ``"auto"`` bins values to bandwidth/20
    (kernel error far below the bandwidth's own smoothing); ``None`` keeps the
    exact values, for columns with few distinct values.
    """
    if prebin_width == "auto":
        prebin_width = bandwidth / 20
    x = F.col(c).cast("double")
    v = x if prebin_width is None else (F.floor(x / prebin_width) + 0.5) * prebin_width
    keys = [group] if group else []
    binned = df.where(x.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    g = F.array(*[F.lit(float(p)) for p in grid])
    z = (F.col("grid") - F.col("_v")) / bandwidth
    expanded = binned.select(*keys, "_v", "_n", F.explode(g).alias("grid"))
    agg = expanded.groupBy(*keys, "grid").agg(
        F.sum(F.col("_n") * F.exp(-z * z / 2)).alias("_k"), F.sum("_n").alias("_N"))
    return agg.select(*keys, "grid",
                      (F.col("_k") / (F.col("_N") * bandwidth * math.sqrt(2 * math.pi))).alias("density"))


def box_stats(df: DataFrame, keys: Sequence[str], value: str, exact: bool = False) -> DataFrame:
    """AGG14: quartiles, mean, whiskers (extreme points inside 1.5 IQR) and outlier count.

    The groups and values are written once; pass 1 aggregates quartiles per group, pass 2
    joins those per-group fences back (one row per group) and aggregates again.
    """
    one = [] if keys else [F.lit(0).alias("_g")]  # written, so that the fence join stays keyed
    named = keep(df.select(*keys, F.col(value).cast("double").alias(value), *one), "box-values")
    out = _box_stats(named, list(keys) or ["_g"], value, exact)
    return out if keys else out.drop("_g")


def _box_stats(df: DataFrame, keys: Sequence[str], value: str, exact: bool) -> DataFrame:
    x = F.col(value).cast("double")
    qs = quantile_columns(quantiles(df, [value], (0.25, 0.5, 0.75), groups=keys, exact=exact), keys,
                          {0.25: "q1", 0.5: "median", 0.75: "q3"})
    m = df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.count(x).alias("n"))
    q = join_on(m, qs, keys, "left")
    iqr = F.col("q3") - F.col("q1")
    fences = keep(q.select(*keys, "q1", "median", "q3", "mean", "n",
                           (F.col("q1") - 1.5 * iqr).alias("_lo"), (F.col("q3") + 1.5 * iqr).alias("_hi")), "fences")
    # one written fence row per group: AQE broadcasts them when they are few and else may split a hot group
    joined = join_on(df.select(*keys, x.alias("_x")), fences, list(keys))
    inside = (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))
    return joined.groupBy(*keys, "q1", "median", "q3", "mean", "n").agg(
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.count_if(F.col("_x").isNotNull() & ~inside).alias("outliers"))


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    """SET2: distinct values of a column."""
    return df.select(c).distinct()


def sort_desc(df: DataFrame, by: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """SRT1: sort by a measure, descending (range-partitioned sort, no single task)."""
    return df.orderBy(F.desc(by), *[F.asc(t) for t in tiebreak])


def order_position(c, order: Sequence) -> Column:
    """SRT2: position of a value in a custom category order (unlisted -> last)."""
    x = col(c)
    expr = None
    for i, v in enumerate(order):
        expr = F.when(x == F.lit(v), F.lit(i)) if expr is None else expr.when(x == F.lit(v), F.lit(i))
    return expr.otherwise(F.lit(len(order)))
