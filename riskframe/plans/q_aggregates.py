"""Demo queries: aggregates, sort, the flagship binned default rate (AGG*, SRT*, JOIN3, SET2).

Stand-ins on the driver tables: the binary target is ``l_returnflag = 'R'``,
amounts are ``l_extendedprice`` / ``c_acctbal``, categories are the TPC-H
flags, segments and priorities.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FeatureGroup
from ..functions.scalars import cut_index, stable_round
from ..operators import aggregates as A
from ..operators.features import prepare
from ..session import table
from .registry import register

# bins for a positive amount (lineitem price) and a signed amount (account balance)
PRICE_EDGES = (0, 25000, 50000, 75000, 200000)
PRICE_GROUP = FeatureGroup("price", ("l_extendedprice",), 0, 200000, PRICE_EDGES)
BAL_EDGES = (-1000, -1, 0, 2500, 5000, 10000)


def _lineitem_target(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.withColumn("target", (F.col("l_returnflag") == "R").cast("int"))


def binned_default_rate(spark, sf):
    """Flagship: FE1 (clip + right-closed cut) -> target rate + count per bin,
    every bin listed (JOIN3 zero-fill), ordered by bin."""
    li = _lineitem_target(spark, sf).select("l_extendedprice", "target")
    binned = prepare(li, [PRICE_GROUP]).withColumnRenamed("l_extendedprice", "bin")
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.sum("target").alias("n_target"))
    full = A.zero_fill_bins(counts, PRICE_EDGES, fill_cols=("n_rows", "n_target"))
    return full.select("bin", "bin_label", "n_rows", "n_target",
                       F.round(F.try_divide(F.col("n_target"), F.col("n_rows")), 6).alias("target_rate")
                       ).orderBy("bin")


_BIN_SQL = """
CASE WHEN l_extendedprice > 0 AND l_extendedprice <= 200000 THEN
  CASE WHEN l_extendedprice <= 25000 THEN 0 WHEN l_extendedprice <= 50000 THEN 1
       WHEN l_extendedprice <= 75000 THEN 2 ELSE 3 END END
"""
_BIN_DIM_SQL = """(VALUES (0, '(0, 25000]'), (1, '(25000, 50000]'), (2, '(50000, 75000]'), (3, '(75000, 200000]'))
  AS d(bin, bin_label)"""

register("agg4_binned_target_rate", f"""
WITH b AS (SELECT {_BIN_SQL} AS bin, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS target FROM lineitem),
c AS (SELECT bin, count(*) AS n_rows, sum(target) AS n_target FROM b GROUP BY bin)
SELECT d.bin, d.bin_label, coalesce(c.n_rows, 0)::BIGINT AS n_rows, coalesce(c.n_target, 0)::BIGINT AS n_target,
       round(CASE WHEN coalesce(c.n_rows, 0) = 0 THEN NULL ELSE c.n_target / c.n_rows END, 6) AS target_rate
FROM {_BIN_DIM_SQL} LEFT JOIN c ON c.bin = d.bin ORDER BY d.bin
""")(binned_default_rate)


@register("agg1_group_count", """
SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY 1, 2""")
def agg1_group_count(spark, sf):
    return A.group_count(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@register("agg2_value_counts", """
SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY 1 ORDER BY count DESC, c_mktsegment""")
def agg2_value_counts(spark, sf):
    return A.value_counts(table(spark, sf, "customer"), "c_mktsegment")


@register("agg3_value_shares", """
SELECT o_orderpriority, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1""")
def agg3_value_shares(spark, sf):
    out = A.value_shares(table(spark, sf, "orders"), "o_orderpriority")
    return out.withColumn("share", F.round("share", 6))


@register("agg4_group_shares", """
SELECT l_linestatus, l_returnflag, round(count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus), 6) AS share,
       count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def agg4_group_shares(spark, sf):
    out = A.group_shares(table(spark, sf, "lineitem"), ["l_linestatus"], "l_returnflag", count_name="n")
    return out.withColumn("share", F.round("share", 6))


@register("agg5_group_mean", """
SELECT l_returnflag, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY 1""")
def agg5_group_mean(spark, sf):
    out = A.group_mean(table(spark, sf, "lineitem"), ["l_returnflag"], "l_discount")
    return out.withColumn("mean", F.round("mean", 6))


@register("agg6_mean_by_hue", """
SELECT c_mktsegment, c_nationkey % 2 AS hue, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY 1, 2""")
def agg6_mean_by_hue(spark, sf):
    c = table(spark, sf, "customer").withColumn("hue", F.col("c_nationkey") % 2)
    return A.group_mean(c, ["c_mktsegment", "hue"], "c_acctbal").withColumn("mean", F.round("mean", 6))


@register("agg7_count_by_bin_class", f"""
WITH b AS (SELECT {_BIN_SQL} AS bin, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS target FROM lineitem),
t AS (SELECT DISTINCT target FROM b),
c AS (SELECT bin, target, count(*) AS count FROM b WHERE bin IS NOT NULL GROUP BY 1, 2)
SELECT t.target, d.bin, d.bin_label, coalesce(c.count, 0)::BIGINT AS count
FROM t CROSS JOIN {_BIN_DIM_SQL} LEFT JOIN c ON c.bin = d.bin AND c.target = t.target
""")
def agg7_count_by_bin_class(spark, sf):
    li = prepare(_lineitem_target(spark, sf).select("l_extendedprice", "target"), [PRICE_GROUP])
    counts = li.where(F.col("l_extendedprice").isNotNull()).groupBy(
        F.col("l_extendedprice").alias("bin"), "target").agg(F.count(F.lit(1)).alias("count"))
    classes = li.select("target").distinct()
    return A.zero_fill_bins(counts, PRICE_EDGES, keys_dim=classes).select("target", "bin", "bin_label", "count")


@register("agg8_pivot_shares", """
WITH c AS (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f,
                  count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p
           FROM orders GROUP BY 1)
SELECT o_orderpriority, nullif(f, 0) AS n_F, nullif(o, 0) AS n_O, nullif(p, 0) AS n_P,
       round(nullif(f, 0) / (f + o + p), 6) AS share_F, round(nullif(o, 0) / (f + o + p), 6) AS share_O,
       round(nullif(p, 0) / (f + o + p), 6) AS share_P
FROM c""")
def agg8_pivot_shares(spark, sf):
    """Order counts per priority pivoted by status, with each status's share of the priority.
    A (priority, status) cell without orders would be null, and so would its share."""
    out = A.pivot_counts(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])
    return out.withColumns({f"share_{v}": F.round(f"share_{v}", 6) for v in "FOP"})


_NULLY_CUSTOMER = """(SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_acctbal END AS c_acctbal,
  nullif(c_mktsegment, 'AUTOMOBILE') AS c_mktsegment, nullif(c_nationkey, 0) AS c_nationkey, c_name FROM customer)"""


def _nully_customer(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey",
                    F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal")).alias("c_acctbal"),
                    F.nullif("c_mktsegment", F.lit("AUTOMOBILE")).alias("c_mktsegment"),
                    F.nullif("c_nationkey", F.lit(0)).alias("c_nationkey"), "c_name")


@register("agg9_null_counts", f"""
SELECT * FROM (UNPIVOT (SELECT count_if(c_custkey IS NULL)::BIGINT AS c_custkey,
  count_if(c_acctbal IS NULL)::BIGINT AS c_acctbal, count_if(c_mktsegment IS NULL)::BIGINT AS c_mktsegment,
  count_if(c_nationkey IS NULL)::BIGINT AS c_nationkey, count_if(c_name IS NULL)::BIGINT AS c_name
  FROM {_NULLY_CUSTOMER}) ON COLUMNS(*) INTO NAME "column" VALUE null_count)""")
def agg9_null_counts(spark, sf):
    return A.null_counts(_nully_customer(spark, sf))


_DUCK_TYPE = """CASE t WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string'
  WHEN 'DOUBLE' THEN 'double' ELSE lower(t) END"""


@register("agg10_table_info", f"""
WITH n AS (SELECT * FROM (UNPIVOT (SELECT count(c_custkey) AS c_custkey, count(c_acctbal) AS c_acctbal,
  count(c_mktsegment) AS c_mktsegment, count(c_nationkey) AS c_nationkey, count(c_name) AS c_name
  FROM {_NULLY_CUSTOMER}) ON COLUMNS(*) INTO NAME "column" VALUE non_null)),
t AS (SELECT column_name AS "column", column_type AS t FROM (DESCRIBE SELECT * FROM {_NULLY_CUSTOMER}))
SELECT n."column", {_DUCK_TYPE} AS dtype, n.non_null FROM n JOIN t USING ("column")""")
def agg10_table_info(spark, sf):
    return A.table_info(_nully_customer(spark, sf))


_DESC_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register("agg11_describe", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, round(avg({c})::DECIMAL(38, 12), 6)::DOUBLE AS mean,
  round(stddev_samp({c})::DECIMAL(38, 12), 6)::DOUBLE AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max FROM lineitem""" for c in _DESC_COLS))
def agg11_describe(spark, sf):
    out = A.describe(table(spark, sf, "lineitem"), _DESC_COLS, exact=True)
    out = out.withColumns({c: stable_round(c, 6) for c in ("mean", "std")})  # a mean may be an exact decimal tie
    return out.withColumns({c: F.round(c, 6) for c in ("p25", "p50", "p75")})


@register("agg12_histogram", """
WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 20))::INT, 19) AS bin, lo, hi FROM lineitem, r)
SELECT bin, round(lo + bin * (hi - lo) / 20, 4) AS lower, round(lo + (bin + 1) * (hi - lo) / 20, 4) AS upper,
       count(*) AS count FROM b GROUP BY bin, lo, hi""")
def agg12_histogram(spark, sf):
    out = A.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 20)
    return out.withColumns({"lower": F.round("lower", 4), "upper": F.round("upper", 4)})


_GRID = [round(i * 0.005, 3) for i in range(0, 23)]


@register("agg13_density", f"""
WITH s AS (SELECT l_returnflag, l_discount AS v, count(*) AS n FROM lineitem GROUP BY 1, 2),
g AS (SELECT unnest([{", ".join(str(g) for g in _GRID)}]::DOUBLE[]) AS grid)
SELECT l_returnflag, grid, round(sum(n * exp(-((grid - v) / 0.01) * ((grid - v) / 0.01) / 2))
       / (sum(n) * 0.01 * sqrt(2 * pi())), 6) AS density
FROM s, g GROUP BY 1, 2""")
def agg13_density(spark, sf):
    # l_discount has 11 distinct values: exact values (no pre-binning) cost only 11 x grid rows
    out = A.density_curve(table(spark, sf, "lineitem"), "l_discount", _GRID, 0.01, group="l_returnflag",
                          prebin_width=None)
    return out.withColumn("density", F.round("density", 6))


@register("flt3_density_window", f"""
WITH s AS (SELECT l_discount AS v, count(*) AS n FROM lineitem GROUP BY 1),
g AS (SELECT unnest([{", ".join(str(g) for g in _GRID)}]::DOUBLE[]) AS grid)
SELECT grid, round(sum(n * exp(-((grid - v) / 0.01) * ((grid - v) / 0.01) / 2))
       / (sum(n) * 0.01 * sqrt(2 * pi())), 6) AS density
FROM s, g WHERE grid BETWEEN 0.02 AND 0.08 GROUP BY 1""")
def flt3_density_window(spark, sf):
    """FLT3: the x-range window applies to the density grid, not to the sample."""
    out = A.density_curve(table(spark, sf, "lineitem"), "l_discount", _GRID, 0.01, prebin_width=None)
    return out.where(F.col("grid").between(0.02, 0.08)).withColumn("density", F.round("density", 6))


@register("agg14_box_stats", """
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
  quantile_cont(l_extendedprice, 0.75) AS q3, avg(l_extendedprice) AS mean, count(l_extendedprice) AS n
  FROM lineitem GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.l_returnflag, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(mean, 6) AS mean, n,
  min(CASE WHEN x BETWEEN lo AND hi THEN x END) AS whisker_low, max(CASE WHEN x BETWEEN lo AND hi THEN x END) AS whisker_high,
  count_if(NOT (x BETWEEN lo AND hi)) AS outliers
FROM f JOIN (SELECT l_returnflag, l_extendedprice AS x FROM lineitem) l USING (l_returnflag)
GROUP BY ALL""")
def agg14_box_stats(spark, sf):
    out = A.box_stats(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", exact=True)
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3", "mean")})


@register("set2_distinct", "SELECT DISTINCT c_mktsegment FROM customer")
def set2_distinct(spark, sf):
    return A.distinct_values(table(spark, sf, "customer"), "c_mktsegment")


@register("srt1_sort_desc", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey""")
def srt1_sort_desc(spark, sf):
    return A.sort_desc(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"])


_PRIORITY_ORDER = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("srt2_custom_order", """
SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2
  WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 ELSE 5 END AS position, count(*) AS count
FROM orders GROUP BY 1 ORDER BY position""")
def srt2_custom_order(spark, sf):
    o = table(spark, sf, "orders")
    return (o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("count"))
            .select("o_orderpriority", A.order_position("o_orderpriority", _PRIORITY_ORDER).alias("position"), "count")
            .orderBy("position"))


_WIDE_SIZE_EDGES = (1, 5, 10, 20, 30, 40, 50, 75, 100)


@register("join3_bin_zero_fill", """
WITH b AS (SELECT CASE WHEN p_size > 1 AND p_size <= 100 THEN CASE WHEN p_size <= 5 THEN 0 WHEN p_size <= 10 THEN 1
  WHEN p_size <= 20 THEN 2 WHEN p_size <= 30 THEN 3 WHEN p_size <= 40 THEN 4 WHEN p_size <= 50 THEN 5
  WHEN p_size <= 75 THEN 6 ELSE 7 END END AS bin FROM part),
c AS (SELECT bin, count(*) AS count FROM b WHERE bin IS NOT NULL GROUP BY 1)
SELECT d.bin, d.bin_label, coalesce(c.count, 0)::BIGINT AS count FROM (VALUES (0, '(1, 5]'), (1, '(5, 10]'),
  (2, '(10, 20]'), (3, '(20, 30]'), (4, '(30, 40]'), (5, '(40, 50]'), (6, '(50, 75]'), (7, '(75, 100]')) d(bin, bin_label)
LEFT JOIN c USING (bin)""")
def join3_bin_zero_fill(spark, sf):
    """Counts per size bin with every configured bin listed; bins above the data range count 0."""
    p = table(spark, sf, "part").select(cut_index("p_size", _WIDE_SIZE_EDGES).alias("bin"))
    counts = p.where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    return A.zero_fill_bins(counts, _WIDE_SIZE_EDGES).select("bin", "bin_label", "count")
