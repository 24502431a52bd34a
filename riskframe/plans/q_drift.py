"""Demo queries: drift between a reference and a current table (DR1-DR5, DQ8).

Sides: closed lines (``l_linestatus = 'F'``) as the reference, open lines
(``'O'``) as the current table; a second pair splits orders by date.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as DR
from ..session import table
from .registry import register

NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
CAT = ("l_returnflag", "l_linenumber")


def _sides(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.where(F.col("l_linestatus") == "F"), li.where(F.col("l_linestatus") == "O")


def _stack_sql(src_ref, src_cur, cols, cast):
    parts = []
    for side, src in ((0, src_ref), (1, src_cur)):
        for c in cols:
            parts.append(f"SELECT '{c}' AS \"column\", {c}::{cast} AS value, {side} AS side FROM {src}")
    return " UNION ALL ".join(parts)


def numeric_sql(src_ref, src_cur, cols):
    return f"""u AS ({_stack_sql(src_ref, src_cur, cols, "DOUBLE")}),
c AS (SELECT "column", value, count_if(side = 0) AS ref_n, count_if(side = 1) AS cur_n FROM u
  WHERE value IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, sum(ref_n) OVER w AS cum_ref, sum(cur_n) OVER w AS cum_cur,
  lead(value) OVER (PARTITION BY "column" ORDER BY value) AS next_value,
  sum(ref_n) OVER (PARTITION BY "column") AS n_ref, sum(cur_n) OVER (PARTITION BY "column") AS n_cur FROM c
  WINDOW w AS (PARTITION BY "column" ORDER BY value ROWS UNBOUNDED PRECEDING)),
sd AS (SELECT "column", stddev_pop(value) AS ref_std FROM u WHERE side = 0 GROUP BY 1),
s AS (SELECT "column", n_ref, n_cur, max(abs(cum_ref / n_ref - cum_cur / n_cur)) AS ks,
  sum(abs(cum_ref / n_ref - cum_cur / n_cur) * coalesce(next_value - value, 0)) AS w1 FROM r GROUP BY 1, 2, 3),
k AS (SELECT *, (sqrt(n_ref * n_cur / (n_ref + n_cur)) + 0.12 + 0.11 / sqrt(n_ref * n_cur / (n_ref + n_cur))) * ks AS lam
  FROM s JOIN sd USING ("column")),
num AS (SELECT "column", n_ref::BIGINT AS ref_rows, n_cur::BIGINT AS cur_rows, ks AS ks_statistic,
  least(greatest(CASE WHEN lam <= 0 THEN 1.0
    WHEN lam < 1.18 THEN 1 - sqrt(2 * pi()) / lam * list_sum(list_transform(range(1, 101),
      lambda j: exp(-(2 * j - 1) * (2 * j - 1) * pi() * pi() / (8 * lam * lam))))
    ELSE list_sum(list_transform(range(1, 101), lambda j: 2 * pow(-1.0, j - 1) * exp(-2 * j * j * lam * lam))) END, 0.0), 1.0)
    AS ks_pvalue, w1 AS wasserstein, w1 / greatest(ref_std, 0.001) AS wasserstein_norm FROM k)"""


def categorical_sql(src_ref, src_cur, cols):
    return f"""cu AS ({_stack_sql(src_ref, src_cur, cols, "VARCHAR")}),
cc AS (SELECT "column", value, count_if(side = 0) AS ref_n, count_if(side = 1) AS cur_n FROM cu
  WHERE value IS NOT NULL GROUP BY 1, 2),
ct AS (SELECT "column", sum(ref_n) AS n_ref, sum(cur_n) AS n_cur FROM cc GROUP BY 1),
cj AS (SELECT cc.*, n_ref, n_cur, ref_n / n_ref AS p, cur_n / n_cur AS q FROM cc JOIN ct USING ("column")),
cat AS (SELECT "column", n_ref::BIGINT AS ref_rows, n_cur::BIGINT AS cur_rows,
  sqrt(greatest(sum(0.5 * CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END
                  + 0.5 * CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END), 0)) AS js_distance,
  sum(CASE WHEN p * n_cur > 0 THEN (cur_n - p * n_cur) * (cur_n - p * n_cur) / (p * n_cur)
           WHEN cur_n > 0 THEN 'inf'::DOUBLE ELSE 0 END) AS chi2_statistic, count(*) - 1 AS chi2_dof
  FROM cj GROUP BY 1, 2, 3)"""


_REF = "(SELECT * FROM lineitem WHERE l_linestatus = 'F')"
_CUR = "(SELECT * FROM lineitem WHERE l_linestatus = 'O')"


@register("dr1_ks_test", f"""WITH {numeric_sql(_REF, _CUR, NUM)}
SELECT "column", ref_rows, cur_rows, round(ks_statistic, 6) AS ks_statistic, round(ks_pvalue, 6) AS ks_pvalue FROM num""")
def dr1_ks_test(spark, sf):
    ref, cur = _sides(spark, sf)
    n = DR.numeric_drift(ref, cur, NUM)
    return n.select("column", "ref_rows", "cur_rows", F.round("ks_statistic", 6).alias("ks_statistic"),
                    F.round("ks_pvalue", 6).alias("ks_pvalue"))


_OREF = "(SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-07-01')"
_OCUR = "(SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01')"


def _order_sides(spark, sf):
    o = table(spark, sf, "orders")
    cut = F.lit("1998-07-01").cast("timestamp_ntz")
    return o.where(F.col("o_orderdate") < cut), o.where(F.col("o_orderdate") >= cut)


@register("dr2_wasserstein", f"""WITH {numeric_sql(_OREF, _OCUR, ("o_totalprice", "o_custkey"))}
SELECT "column", ref_rows, cur_rows, round(wasserstein, 4) AS wasserstein, round(wasserstein_norm, 6) AS wasserstein_norm,
  round(ks_statistic, 6) AS ks_statistic FROM num""")
def dr2_wasserstein(spark, sf):
    ref, cur = _order_sides(spark, sf)
    n = DR.numeric_drift(ref, cur, ["o_totalprice", "o_custkey"])
    return n.select("column", "ref_rows", "cur_rows", F.round("wasserstein", 4).alias("wasserstein"),
                    F.round("wasserstein_norm", 6).alias("wasserstein_norm"),
                    F.round("ks_statistic", 6).alias("ks_statistic"))


@register("dr3_jensen_shannon", f"""WITH {categorical_sql(_REF, _CUR, CAT)}
SELECT "column", ref_rows, cur_rows, round(js_distance, 6) AS js_distance FROM cat""")
def dr3_jensen_shannon(spark, sf):
    ref, cur = _sides(spark, sf)
    c = DR.categorical_drift(ref, cur, CAT)
    return c.select("column", "ref_rows", "cur_rows", F.round("js_distance", 6).alias("js_distance"))


@register("dr4_chi_square", f"""WITH {categorical_sql(_OREF, _OCUR, ("o_orderpriority", "o_orderstatus"))}
SELECT "column", ref_rows, cur_rows, round(chi2_statistic, 6) AS chi2_statistic, chi2_dof FROM cat""")
def dr4_chi_square(spark, sf):
    ref, cur = _order_sides(spark, sf)
    c = DR.categorical_drift(ref, cur, ["o_orderpriority", "o_orderstatus"])
    return c.select("column", "ref_rows", "cur_rows", F.round("chi2_statistic", 6).alias("chi2_statistic"), "chi2_dof")


@register("dr4_chi_square_pvalue", f"""WITH {categorical_sql(_OREF, _OCUR, ("o_orderpriority", "o_orderstatus"))}
SELECT "column", chi2_dof, round(exp(-chi2_statistic / 2) * list_sum(list_transform(range(0, chi2_dof // 2),
  lambda i: pow(chi2_statistic / 2, i) / factorial(i::INT))), 6) AS chi2_pvalue FROM cat""")
def dr4_chi_square_pvalue(spark, sf):
    """Chi-square p-value per column (upper gamma tail, one small Arrow batch of per-column rows; the
    SQL form is the finite series for an even number of degrees of freedom)."""
    ref, cur = _order_sides(spark, sf)
    p = DR.with_chi2_pvalue(DR.categorical_drift(ref, cur, ["o_orderpriority", "o_orderstatus"]))
    return p.select("column", "chi2_dof", F.round("chi2_pvalue", 6).alias("chi2_pvalue"))


_DR5_SQL = f"""WITH {numeric_sql(_REF, _CUR, NUM)}, {categorical_sql(_REF, _CUR, CAT)},
t AS (SELECT "column", 'num' AS kind, 'wasserstein_norm' AS stat_test, wasserstein_norm AS statistic, 0.1 AS threshold FROM num
  UNION ALL SELECT "column", 'cat', 'jensenshannon', js_distance, 0.1 FROM cat)"""


@register("dr5_drift_table", _DR5_SQL + """
SELECT "column", kind, stat_test, round(statistic, 6) AS statistic, threshold, statistic >= threshold AS drifted FROM t""")
def dr5_drift_table(spark, sf):
    ref, cur = _sides(spark, sf)
    t = DR.drift_table(ref, cur, NUM, CAT)
    return t.withColumn("statistic", F.round("statistic", 6))


@register("dr5_dataset_drift", _DR5_SQL + """
SELECT count(*) AS n_columns, count_if(statistic >= threshold) AS n_drifted,
  round(count_if(statistic >= threshold) / count(*), 6) AS share_drifted,
  count_if(statistic >= threshold) / count(*) >= 0.5 AS dataset_drift FROM t""")
def dr5_dataset_drift(spark, sf):
    ref, cur = _sides(spark, sf)
    v = DR.dataset_drift(DR.drift_table(ref, cur, NUM, CAT))
    return v.withColumn("share_drifted", F.round("share_drifted", 6))


@register("dq8_drifted_columns", _DR5_SQL + """
SELECT count(*) AS n_columns, count_if(statistic >= threshold) AS n_drifted,
  count_if(statistic >= threshold) <= floor(count(*) / 3) AS passed FROM t""")
def dq8_drifted_columns(spark, sf):
    """Test: number of drifted columns within the limit (a third of the columns)."""
    ref, cur = _sides(spark, sf)
    v = DR.dataset_drift(DR.drift_table(ref, cur, NUM, CAT))
    return v.select("n_columns", "n_drifted", (F.col("n_drifted") <= F.floor(F.col("n_columns") / 3)).alias("passed"))


@register("dr5_planted_cases", """
SELECT * FROM (VALUES ('large_offset', 'num', false), ('constant_shifted', 'num', true), ('null_both', 'num', false),
  ('null_current', 'num', true), ('text_null_both', 'cat', false), ('text_null_current', 'cat', true),
  ('text_same', 'cat', false), ('large_shifted', 'num', true)) AS t("column", kind, drifted)""")
def dr5_planted_cases(spark, sf):
    """Verdicts on planted columns of all orders: large numbers that stay and that shift by 20, a
    constant that becomes another, columns without values on one or both sides."""
    o = table(spark, sf, "orders")
    none = F.when(F.col("o_orderkey") < 0, F.col("o_totalprice"))

    def side(current):
        big = F.lit(1.7e9) + F.col("o_orderkey") % 10
        text = F.when(F.col("o_orderkey") < 0, F.col("o_orderstatus"))
        return o.select(big.alias("large_offset"), (big + (20 if current else 0)).alias("large_shifted"),
                        (F.col("o_orderkey") * 0 + (99.0 if current else 1.0)).alias("constant_shifted"),
                        none.alias("null_both"), (none if current else F.col("o_totalprice")).alias("null_current"),
                        text.alias("text_null_both"), (text if current else F.col("o_orderstatus")).alias("text_null_current"),
                        F.col("o_orderpriority").alias("text_same"))

    t = DR.drift_table(side(False), side(True), ["large_offset", "large_shifted", "constant_shifted", "null_both", "null_current"],
                       ["text_null_both", "text_null_current", "text_same"])
    return t.select("column", "kind", "drifted")
