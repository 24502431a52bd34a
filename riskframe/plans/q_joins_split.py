"""Demo queries: insert-if-new merge (JOIN1, JOIN2, SET1) and splits (SPL1-SPL3).

The reference side of a merge is the orders placed before 1998, the new
batch is the orders placed from 1997 on, so the two overlap for one year.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as M
from ..operators import split as SP
from ..session import table
from .registry import register

_REF = "(SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')"
_NEW = "(SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')"


def _sides(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    ref = o.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).drop("o_orderdate")
    new = o.where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).drop("o_orderdate")
    return ref, new


@register("join1_rows_to_insert", f"""
SELECT * FROM {_NEW} n WHERE NOT EXISTS (SELECT 1 FROM {_REF} r WHERE r.o_orderkey = n.o_orderkey)""")
def join1_rows_to_insert(spark, sf):
    ref, new = _sides(spark, sf)
    return M.rows_to_insert(new, ref, "o_orderkey")


@register("join1_nothing_to_insert", f"""
SELECT * FROM {_REF} n WHERE NOT EXISTS (SELECT 1 FROM {_REF} r WHERE r.o_orderkey = n.o_orderkey)""")
def join1_nothing_to_insert(spark, sf):
    """All keys known -> an empty frame (not None)."""
    ref, _ = _sides(spark, sf)
    return M.rows_to_insert(ref, ref, "o_orderkey")


@register("join1_hot_key_customer", """
SELECT * FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)""")
def join1_hot_key_customer(spark, sf):
    """Anti join against a many-rows-per-key reference (orders by customer)."""
    c = table(spark, sf, "customer")
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return M.rows_to_insert(c, o, "c_custkey")


@register("join2_known_key_count", f"""
SELECT count(*) AS known FROM {_NEW} n WHERE EXISTS (SELECT 1 FROM {_REF} r WHERE r.o_orderkey = n.o_orderkey)""")
def join2_known_key_count(spark, sf):
    ref, new = _sides(spark, sf)
    return M.known_key_count(new, ref, "o_orderkey")


@register("set1_insert_if_new", f"""
SELECT * FROM {_REF} UNION ALL
SELECT * FROM {_NEW} n WHERE NOT EXISTS (SELECT 1 FROM {_REF} r WHERE r.o_orderkey = n.o_orderkey)""")
def set1_insert_if_new(spark, sf):
    ref, new = _sides(spark, sf)
    return M.insert_if_new(ref, new, "o_orderkey")


@register("spl1_stratified_split", """
WITH r AS (SELECT o_orderkey, o_orderstatus,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('1961:' || o_orderkey), o_orderkey) AS rk,
  count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, CASE WHEN rk <= round(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM r""")
def spl1_stratified_split(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return SP.stratified_split(o, "o_orderstatus", "o_orderkey", 0.2, seed=1961)


@register("spl1_split_sizes", """
WITH r AS (SELECT l_returnflag, row_number() OVER (PARTITION BY l_returnflag
  ORDER BY md5('1961:' || (l_orderkey * 8 + l_linenumber)), l_orderkey * 8 + l_linenumber) AS rk,
  count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, CASE WHEN rk <= round(0.2 * n) THEN 'test' ELSE 'train' END AS split, count(*) AS n_rows
FROM r GROUP BY 1, 2""")
def spl1_split_sizes(spark, sf):
    """Stratified split of every lineitem row (key = orderkey * 8 + linenumber), sizes per part."""
    li = table(spark, sf, "lineitem").select(
        "l_returnflag", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"))
    s = SP.stratified_split(li, "l_returnflag", "k", 0.2, seed=1961)
    return s.groupBy("l_returnflag", "split").agg(F.count(F.lit(1)).alias("n_rows"))


@register("spl2_random_split", """
SELECT o_orderkey, CASE WHEN substr(md5('1961:' || o_orderkey), 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS split
FROM orders""")
def spl2_random_split(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return SP.random_split(o, "o_orderkey", 0.2, seed=1961)


@register("spl3_stratified_folds", """
SELECT o_orderkey, o_orderstatus, ((row_number() OVER (PARTITION BY o_orderstatus
  ORDER BY md5('1:' || o_orderkey), o_orderkey) - 1) % 5)::INT AS fold FROM orders""")
def spl3_stratified_folds(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return SP.stratified_folds(o, "o_orderstatus", "o_orderkey", k=5, seed=1)
