"""Demo queries: feature pipeline (FE1-FE11)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..config import FeatureGroup
from ..functions.scalars import stable_round
from ..operators import features as FE
from ..session import keep, table
from .registry import register

# lineitem stand-in for the account-table config: a clip-only ordinal group,
# a positive amount and a small count, both cut into right-closed bins
LINE_GROUPS = (
    FeatureGroup("line_x", ("l_linenumber",), 1, 4, None),
    FeatureGroup("price", ("l_extendedprice",), 0, 200000, (0, 25000, 50000, 75000, 200000)),
    FeatureGroup("qty", ("l_quantity",), 0, 50, (0, 10, 20, 30, 40, 50)),
)

_FE1_SQL = """
SELECT l_orderkey, l_linenumber AS raw_linenumber, least(greatest(l_linenumber, 1), 4) AS l_linenumber,
  CASE WHEN p > 0 AND p <= 200000 THEN CASE WHEN p <= 25000 THEN 0 WHEN p <= 50000 THEN 1 WHEN p <= 75000 THEN 2 ELSE 3 END END
    AS l_extendedprice,
  CASE WHEN q > 0 AND q <= 50 THEN CASE WHEN q <= 10 THEN 0 WHEN q <= 20 THEN 1 WHEN q <= 30 THEN 2 WHEN q <= 40 THEN 3
    ELSE 4 END END AS l_quantity
FROM (SELECT l_orderkey, l_linenumber, least(greatest(l_extendedprice, 0), 200000) AS p,
  least(greatest(l_quantity, 0), 50) AS q FROM lineitem)"""


@register("fe1_prepare", _FE1_SQL)
def fe1_prepare(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    li = li.withColumn("raw_linenumber", F.col("l_linenumber"))
    return FE.prepare(li, LINE_GROUPS)


@register("fe1_prepare_labels", """
SELECT l_orderkey, l_linenumber,
  coalesce(['(0, 10]', '(10, 20]', '(20, 30]', '(30, 40]', '(40, 50]'][
    CASE WHEN q > 0 AND q <= 50 THEN CASE WHEN q <= 10 THEN 1 WHEN q <= 20 THEN 2 WHEN q <= 30 THEN 3
      WHEN q <= 40 THEN 4 ELSE 5 END END], 'nan') AS l_quantity
FROM (SELECT l_orderkey, l_linenumber, least(greatest(l_quantity - 1, 0), 50) AS q FROM lineitem)""")
def fe1_prepare_labels(spark, sf):
    """Label form; quantity shifted by -1 so 1 -> 0 clips onto the excluded lowest edge -> 'nan'."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 1).alias("l_quantity"))
    return FE.prepare(li, [LINE_GROUPS[2]], labels=True, null_label="nan")


@register("fe2_prepare_capped", """
SELECT l_orderkey, least(l_linenumber, 4) AS l_linenumber,
  CASE WHEN l_extendedprice > 0 AND l_extendedprice <= 75000 THEN CASE WHEN l_extendedprice <= 25000 THEN 0
    WHEN l_extendedprice <= 50000 THEN 1 ELSE 2 END END AS l_extendedprice FROM lineitem""")
def fe2_prepare_capped(spark, sf):
    """Older prepare: cap without clip; prices above the last edge fall out (null)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return FE.prepare_capped(li, {"l_linenumber": 4}, {"l_extendedprice": (0, 25000, 50000, 75000)})


@register("fe3_mean_impute", """
WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_acctbal END AS bal,
  CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_nationkey END AS nat FROM customer),
m AS (SELECT avg(bal) AS mb, avg(nat::DOUBLE) AS mn FROM c WHERE c_nationkey < 15)
SELECT c_custkey, round(coalesce(bal, mb)::DECIMAL(38, 12), 6)::DOUBLE AS bal,
  round(coalesce(nat::DOUBLE, mn)::DECIMAL(38, 12), 6)::DOUBLE AS nat FROM c, m""")
def fe3_mean_impute(spark, sf):
    """Fit means on the 'train' rows (nation < 15), impute every row; the int column keeps its fractional mean."""
    c = table(spark, sf, "customer").select(
        "c_custkey", "c_nationkey",
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal")).alias("bal"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey")).alias("nat"))
    means = FE.fit_mean_imputer(c.where(F.col("c_nationkey") < 15), ["bal", "nat"])
    out = FE.impute(c, means)
    return out.select("c_custkey", stable_round("bal", 6).alias("bal"), stable_round("nat", 6).alias("nat"))


_OH_COLS = ("c_nationkey", "c_mktsegment")
_DICT_SQL = """
WITH fit AS (SELECT * FROM customer WHERE c_acctbal > 0 AND c_nationkey < 20),
v AS (SELECT DISTINCT 0 AS pos, 'c_nationkey' AS "column", c_nationkey::VARCHAR AS value, c_nationkey::DOUBLE AS num FROM fit
  UNION SELECT DISTINCT 1, 'c_mktsegment', c_mktsegment, NULL FROM fit),
d AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY num, value) - 1 AS local_index FROM v),
o AS (SELECT pos, coalesce(sum(count(*)) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM d GROUP BY pos),
dict AS (SELECT d."column", d.value, d.local_index, (o.off + d.local_index)::INT AS feature_index,
  d."column" || '_' || d.value AS feature_name FROM d JOIN o USING (pos))"""


def _fit_onehot(spark, sf):
    fit = table(spark, sf, "customer").where((F.col("c_acctbal") > 0) & (F.col("c_nationkey") < 20))
    return FE.OneHotModel.fit(fit, _OH_COLS)


@register("fe4_onehot", _DICT_SQL + """
SELECT c.c_custkey, dict.feature_index, dict.feature_name FROM customer c JOIN dict
  ON (dict."column" = 'c_nationkey' AND dict.value = c.c_nationkey::VARCHAR)
  OR (dict."column" = 'c_mktsegment' AND dict.value = c.c_mktsegment)""")
def fe4_onehot(spark, sf):
    """Fit on customers with positive balance from nations < 20; nations 20-24 are unseen -> no bit set."""
    model = _fit_onehot(spark, sf)
    return model.active_features(table(spark, sf, "customer"), "c_custkey")


@register("fe4_onehot_vectors", _DICT_SQL + """
SELECT c.c_custkey, dict.feature_index::INT AS feature_index, 1.0 AS value FROM customer c JOIN dict
  ON (dict."column" = 'c_nationkey' AND dict.value = c.c_nationkey::VARCHAR)
  OR (dict."column" = 'c_mktsegment' AND dict.value = c.c_mktsegment)""")
def fe4_onehot_vectors(spark, sf):
    """The same encoding as ML vectors (JVM OneHotEncoder over fitted local indices): its non-zero cells."""
    model = _fit_onehot(spark, sf)
    v = model.transform(table(spark, sf, "customer").select("c_custkey", *_OH_COLS), "features")
    cells = v.select("c_custkey", F.posexplode(vector_to_array("features")).alias("feature_index", "value"))
    return cells.where("value <> 0")


@register("fe5_feature_names", _DICT_SQL + """
SELECT "column", value, local_index::INT AS local_index, feature_index, feature_name FROM dict""")
def fe5_feature_names(spark, sf):
    """Category dictionary: numeric columns in numeric order (nation 10 after 9), names COL_value."""
    fit = table(spark, sf, "customer").where((F.col("c_acctbal") > 0) & (F.col("c_nationkey") < 20))
    d = FE.category_dictionary(fit, _OH_COLS)
    return d.select("column", "value", d["local_index"].cast("int").alias("local_index"),
                    d["feature_index"].cast("int").alias("feature_index"), "feature_name")


def _embeddings(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", array_to_vector("embedding").alias("features"))


@register("fe6_kmeans_segments")
def fe6_kmeans_segments(spark, sf):
    """k-means (k-means||, seed 42) on the 64-d embeddings; cluster id per vector."""
    e = _embeddings(spark, sf)
    model, _, _ = FE.fit_segments(e, "features", k=5)
    return model.transform(e).select("vec_id", "label", "cluster")


@register("fe7_elbow")
def fe7_elbow(spark, sf):
    """Training cost for k = 2..14 on the embeddings and the knee-chosen k, with the final fit."""
    e = keep(_embeddings(spark, sf).select("features"), "vectors")
    _, k, costs = FE.fit_segments(e, "features", ks=range(2, 15))
    return spark.createDataFrame([(kk, c, kk == k) for kk, c in costs], "k int, cost double, chosen boolean")


@register("fe8_nearest_center", """
WITH e AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
c AS (SELECT label AS center, pos, avg(v) AS m FROM e GROUP BY 1, 2),
d AS (SELECT e.vec_id, c.center, sum((e.v - c.m) * (e.v - c.m)) AS dist FROM e JOIN c USING (pos) GROUP BY 1, 2)
SELECT vec_id, arg_min(center, dist)::INT AS cluster FROM d GROUP BY 1""")
def fe8_nearest_center(spark, sf):
    """Cluster feature with given centers: centers = per-label mean embeddings (an aggregate of
    the table, label count x 64 numbers), assignment = arg-min squared distance, native expressions."""
    e = table(spark, sf, "embeddings")
    centers_df = (e.select("label", F.posexplode("embedding").alias("pos", "v"))
                  .groupBy("label", "pos").agg(F.avg("v").alias("m")))
    rows = centers_df.orderBy("label", "pos").collect()
    labels = sorted({r["label"] for r in rows})
    centers = [[r["m"] for r in rows if r["label"] == lb] for lb in labels]
    idx = FE.nearest_center(F.col("embedding").cast("array<double>"), centers)
    lab = F.array(*[F.lit(lb) for lb in labels])
    return e.select("vec_id", F.get(lab, idx).cast("int").alias("cluster"))


@register("fe9_label_encode", """
SELECT o_orderkey, o_orderpriority, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS o_orderpriority_code FROM orders""")
def fe9_label_encode(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return FE.label_encode(o, "o_orderpriority").withColumn(
        "o_orderpriority_code", F.col("o_orderpriority_code").cast("int"))


_WEEK_SQL = "(date_diff('day', DATE '2024-01-01', ts::DATE) // 7)::INT"


def _weekly(spark, sf):
    ev = table(spark, sf, "events")
    week = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 7).cast("int")
    return ev.select("user_id", week.alias("week"), "value")


@register("fe11_long_to_wide", f"""
SELECT user_id, {", ".join(f"round(sum(value) FILTER (WHERE w = {i}), 4) AS w{i}" for i in range(5))}
FROM (SELECT user_id, {_WEEK_SQL} AS w, value FROM events) GROUP BY 1""")
def fe11_long_to_wide(spark, sf):
    """Event value per user x week as a wide five-week block (fixed column list, no distinct job)."""
    w = FE.long_to_wide(_weekly(spark, sf), ["user_id"], "week", "value", list(range(5)))
    return w.select("user_id", *[F.round(F.col(f"`{i}`"), 4).alias(f"w{i}") for i in range(5)])


@register("fe11_wide_to_long", f"""
WITH w AS (SELECT user_id, {", ".join(f"sum(value) FILTER (WHERE w = {i}) AS w{i}" for i in range(5))}
  FROM (SELECT user_id, {_WEEK_SQL} AS w, value FROM events) GROUP BY 1)
SELECT user_id, measure, round(value, 4) AS value FROM (UNPIVOT w ON {", ".join(f"w{i}" for i in range(5))}
  INTO NAME measure VALUE value)""")
def fe11_wide_to_long(spark, sf):
    """The wide block back to long rows (map-only unpivot; empty weeks drop out)."""
    w = FE.long_to_wide(_weekly(spark, sf), ["user_id"], "week", "value", list(range(5)))
    w = w.select("user_id", *[F.col(f"`{i}`").alias(f"w{i}") for i in range(5)])
    long = FE.wide_to_long(w, ["user_id"], [f"w{i}" for i in range(5)])
    return long.where(F.col("value").isNotNull()).withColumn("value", F.round("value", 4))
