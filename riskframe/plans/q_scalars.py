"""Demo queries: scalar functions, projections and filters (SCL*, PRJ*, FLT1, FLT2)."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import table
from .registry import register

BAL_EDGES = (-1000, -1, 0, 2500, 5000, 10000)
SIZE_EDGES = (1, 5, 10, 20, 30, 40, 50)


def _customer_nully(spark, sf):
    c = table(spark, sf, "customer")
    return c.withColumn("c_acctbal", F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal")))


_CUST_NULLY = """(SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_acctbal END AS c_acctbal,
  c_mktsegment, c_nationkey FROM customer)"""


@register("scl1_clip", f"""
SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN NULL ELSE least(greatest(c_acctbal, 0.0), 5000.0) END AS clipped
FROM {_CUST_NULLY}""")
def scl1_clip(spark, sf):
    c = _customer_nully(spark, sf)
    return c.select("c_custkey", S.clip("c_acctbal", 0.0, 5000.0).alias("clipped"))


_SIZE_CASE = """CASE WHEN p_size > 1 AND p_size <= 50 THEN CASE WHEN p_size <= 5 THEN 0 WHEN p_size <= 10 THEN 1
  WHEN p_size <= 20 THEN 2 WHEN p_size <= 30 THEN 3 WHEN p_size <= 40 THEN 4 ELSE 5 END END"""
_SIZE_LABELS = "['(1, 5]', '(5, 10]', '(10, 20]', '(20, 30]', '(30, 40]', '(40, 50]']"


@register("scl2_cut", f"""
SELECT p_partkey, p_size, {_SIZE_CASE} AS bin FROM part""")
def scl2_cut(spark, sf):
    """Right-closed cut; p_size = 1 sits on the excluded lowest edge -> null."""
    p = table(spark, sf, "part")
    return p.select("p_partkey", "p_size", S.cut_index("p_size", SIZE_EDGES).alias("bin"))


@register("scl3_bin_label", f"""
SELECT p_partkey, coalesce({_SIZE_LABELS}[({_SIZE_CASE}) + 1], 'nan') AS size_label,
  CASE WHEN c > -1000 AND c <= 10000 THEN
    CASE WHEN c <= -1 THEN '(-1000, -1]' WHEN c <= 0 THEN '(-1, 0]' WHEN c <= 2500 THEN '(0, 2500]'
         WHEN c <= 5000 THEN '(2500, 5000]' ELSE '(5000, 10000]' END END AS price_label
FROM (SELECT p_partkey, p_size, p_retailprice * 5 - 6000 AS c FROM part)""")
def scl3_bin_label(spark, sf):
    p = table(spark, sf, "part").withColumn("c", F.col("p_retailprice") * 5 - 6000)
    return p.select("p_partkey", S.cut_label("p_size", SIZE_EDGES, null_label="nan").alias("size_label"),
                    S.cut_label("c", BAL_EDGES).alias("price_label"))


@register("scl4_cap", """SELECT l_orderkey, l_linenumber AS raw, least(l_linenumber, 4) AS capped FROM lineitem""")
def scl4_cap(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", F.col("l_linenumber").alias("raw"), S.cap("l_linenumber", 4).alias("capped"))


@register("scl5_recode", """
SELECT o_orderkey, CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN '5-LOW' WHEN '1-URGENT' THEN '2-HIGH'
  ELSE o_orderpriority END AS priority FROM orders""")
def scl5_recode(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", S.recode("o_orderpriority", {"4-NOT SPECIFIED": "5-LOW", "1-URGENT": "2-HIGH"})
                    .alias("priority"))


@register("scl6_value_map", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END AS status_name FROM orders""")
def scl6_value_map(spark, sf):
    """Values outside the map (status P) become null."""
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", S.value_map("o_orderstatus", {"F": "filled", "O": "open"}).alias("status_name"))


@register("scl7_try_cast", """
SELECT c_custkey, TRY_CAST(substr(c_name, 10) AS INTEGER) AS name_number,
  TRY_CAST(c_mktsegment AS INTEGER) AS segment_number,
  (c_mktsegment IS NULL OR TRY_CAST(c_mktsegment AS INTEGER) IS NOT NULL) AS segment_ok FROM customer""")
def scl7_try_cast(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", S.safe_cast(F.substring("c_name", 10, 1000), "int").alias("name_number"),
                    S.safe_cast("c_mktsegment", "int").alias("segment_number"),
                    S.cast_ok("c_mktsegment", "int").alias("segment_ok"))


@register("scl8_ratio", """
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END, 6) AS ratio
FROM lineitem""")
def scl8_ratio(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(S.ratio("l_discount", "l_tax"), 6).alias("ratio"))


@register("scl9_percent_text", """
SELECT o_orderpriority, printf('%.2f%%', round(count(*) * 100.0 / sum(count(*)) OVER (), 2)) AS pct FROM orders GROUP BY 1""")
def scl9_percent_text(spark, sf):
    from ..operators.aggregates import value_shares
    shares = value_shares(table(spark, sf, "orders"), "o_orderpriority")
    return shares.select("o_orderpriority", S.percent_text("share").alias("pct"))


@register("prj1_rename", """SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice FROM orders""")
def prj1_rename(spark, sf):
    """Rename by map; names absent from the frame are ignored."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return o.withColumnsRenamed({"o_orderkey": "id", "o_orderstatus": "status", "not_there": "x"})


@register("prj2_drop", """SELECT c_custkey, c_nationkey, c_acctbal FROM customer""")
def prj2_drop(spark, sf):
    return table(spark, sf, "customer").drop("c_name", "c_mktsegment")


@register("prj3_select_order", """SELECT p_size, p_brand, p_partkey FROM part""")
def prj3_select_order(spark, sf):
    cols = ["p_size", "p_brand", "p_partkey"]
    return table(spark, sf, "part").select(*cols)


@register("prj4_derive", """
SELECT o_orderkey, o_totalprice, o_totalprice AS o_totalprice_new, o_orderstatus = 'F' AS is_final FROM orders""")
def prj4_derive(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return o.withColumns({"o_totalprice_new": F.col("o_totalprice"),
                          "is_final": F.col("o_orderstatus") == "F"}).drop("o_orderstatus")


@register("prj5_assemble", """
SELECT l_orderkey, l_linenumber, l_quantity AS f0, l_discount AS f1, l_tax AS f2 FROM lineitem""")
def prj5_assemble(spark, sf):
    """Horizontal feature block + extra column on the same rows (no zip of two frames)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    asm = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features")
    out = asm.transform(li).select("l_orderkey", "l_linenumber", vector_to_array("features").alias("f"))
    return out.select("l_orderkey", "l_linenumber", *[F.col("f")[i].alias(f"f{i}") for i in range(3)])


@register("flt1_equality_filter", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_returnflag = 'R'""")
def flt1_equality_filter(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.where(F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "l_extendedprice")


def part_rules():
    return {
        "size_range": (F.col("p_size") > 1) & (F.col("p_size") < 50),
        "price_below_2000": F.col("p_retailprice") < 2000,
        "brand_present": F.col("p_brand").isNotNull(),
    }


@register("flt2_request_rules", """
WITH v AS (SELECT p_partkey, list_filter([CASE WHEN NOT coalesce(p_size > 1 AND p_size < 50, false) THEN 'size_range' END,
  CASE WHEN NOT coalesce(p_retailprice < 2000, false) THEN 'price_below_2000' END,
  CASE WHEN NOT coalesce(p_brand IS NOT NULL, false) THEN 'brand_present' END], lambda x: x IS NOT NULL) AS viol FROM part)
SELECT p_partkey, array_to_string(viol, ',') AS violations, len(viol)::INT AS n_violations,
  CASE WHEN len(viol) = 0 THEN 'valid' ELSE 'quarantine' END AS route FROM v""")
def flt2_request_rules(spark, sf):
    """Rule list -> violations per row; valid rows and quarantine rows are split by ``route``."""
    p = table(spark, sf, "part").withColumn("_v", S.rule_violations(part_rules()))
    return p.select("p_partkey", F.array_join("_v", ",").alias("violations"), F.size("_v").alias("n_violations"),
                    F.when(F.size("_v") == 0, "valid").otherwise("quarantine").alias("route"))
