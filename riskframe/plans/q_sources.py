"""Demo queries: sources and sinks (SRC1-SRC3, SNK1-SNK3) through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path, table
from ..sources import files as IO
from .registry import register

ORDERS_CSV_SCHEMA = ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
                     "o_orderdate STRING, o_orderpriority STRING")

_ORDERS_TEXT_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders"""


def _orders_text(spark, sf):
    o = table(spark, sf, "orders")
    return o.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@register("src1_csv_scan", _ORDERS_TEXT_SQL)
def src1_csv_scan(spark, sf):
    """Write orders as CSV (SNK1), scan it back with a declared schema (SRC1)."""
    path = scratch_path(spark, "orders-csv")
    IO.write_csv(_orders_text(spark, sf), path)
    return IO.read_csv(spark, path, ORDERS_CSV_SCHEMA)


@register("snk1_csv_sink", """SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem""")
def snk1_csv_sink(spark, sf):
    path = scratch_path(spark, "lineitem-csv")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    IO.write_csv(li, path)
    return IO.read_csv(spark, path, "l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_returnflag STRING")


@register("src1_csv_corrupt_rows", """
SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS bad_rows, count(*) AS n_rows,
  count(*) FILTER (WHERE o_orderstatus <> 'P') AS priced_rows FROM orders""")
def src1_csv_corrupt_rows(spark, sf):
    """PERMISSIVE scan: lines whose fields do not fit the schema are kept aside, not fatal.
    Orders with status P get a text total price, so exactly those lines are corrupt."""
    path = scratch_path(spark, "orders-bad-csv")
    o = _orders_text(spark, sf).withColumn(
        "o_totalprice", F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")))
    IO.write_csv(o, path)
    r = IO.read_csv(spark, path, ORDERS_CSV_SCHEMA + ", _corrupt STRING", corrupt_col="_corrupt")
    # a corrupt line is corrupt whatever is selected: here the bad column itself is not
    keys = r.agg(F.count_if(F.col("_corrupt").isNotNull()).alias("bad_rows"))
    rest = r.agg(F.count(F.lit(1)).alias("n_rows"), F.count("o_totalprice").alias("priced_rows"))
    return keys.withColumn("_one", F.col("bad_rows") >= 0).join(rest.withColumn("_one", F.col("n_rows") >= 0), "_one").drop("_one")


@register("src2_table_scan", """
SELECT o_orderkey, o_totalprice FROM orders""")
def src2_table_scan(spark, sf):
    """Parquet scan of the whole table; the two-column projection reaches the scan."""
    return IO.read_table(spark, f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice")


@register("src3_reference_or_empty", """
SELECT 1 AS run, 0::BIGINT AS n_rows UNION ALL SELECT 2 AS run, count(*) AS n_rows FROM orders""")
def src3_reference_or_empty(spark, sf):
    """First run finds no reference (empty frame with the schema); after it is stored, the second finds it."""
    path = scratch_path(spark, "reference")
    schema = "o_orderkey BIGINT, o_totalprice DOUBLE"
    first = IO.read_reference(spark, path, schema).agg(F.count(F.lit(1)).alias("n_rows"))
    IO.replace_table(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), path)
    second = IO.read_reference(spark, path, schema).agg(F.count(F.lit(1)).alias("n_rows"))
    return first.select(F.lit(1).alias("run"), "n_rows").unionByName(second.select(F.lit(2).alias("run"), "n_rows"))


@register("snk2_table_overwrite", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE o_totalprice * 2 END AS o_totalprice FROM orders""")
def snk2_table_overwrite(spark, sf):
    """Overwrite a stored table with a job that reads that same table."""
    path = scratch_path(spark, "validated")
    IO.replace_table(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path)
    cur = IO.read_table(spark, path)
    doubled = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice")).otherwise(F.col("o_totalprice") * 2)
    IO.replace_table(cur.withColumn("o_totalprice", doubled), path)
    return IO.read_table(spark, path).select("o_orderkey", "o_totalprice")


@register("snk3_append", """
SELECT o_orderkey, o_orderstatus FROM orders""")
def snk3_append(spark, sf):
    path = scratch_path(spark, "collection")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    IO.append_table(o.where(F.col("o_orderstatus") == "F"), path)
    IO.append_table(o.where(F.col("o_orderstatus") != "F"), path)
    return IO.read_table(spark, path)
