"""Demo queries: selection, gates and registries (SEL1-SEL5, ML10).

Metric rows come from EV12 over the three stand-in score models; registry
and history rows are derived from orders (key = priority or customer,
score = price, sequence = order key / date).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection as SEL
from ..session import table
from .q_metrics import _QUALITY_SQL, _models_sql, evaluated_models
from .registry import register

_EVAL_SQL = _QUALITY_SQL.format(P=_models_sql(), G="model, seq, split")
_VIEW_SQL = f"""WITH m AS ({_EVAL_SQL}),
v AS (SELECT model, seq, max(CASE WHEN split = 'train' THEN {{p}} END) AS train_score,
  max(CASE WHEN split = 'test' THEN {{p}} END) AS test_score, max(CASE WHEN split = 'test' THEN accuracy END) AS test_accuracy
  FROM m GROUP BY 1, 2)"""


def _view(spark, sf, param):
    return evaluated_models(spark, sf).withColumns({c: F.round(c, 6) for c in ("accuracy", "roc_auc", "f1")})


@register("sel1_best_model", _VIEW_SQL.format(p="roc_auc") + """
SELECT model, seq, train_score, test_score, test_accuracy, round(train_score - test_score, 6) AS gap FROM v
WHERE train_score - test_score <= 0.6 AND test_accuracy >= 0.48 ORDER BY gap, seq DESC LIMIT 1""")
def sel1_best_model(spark, sf):
    """Trainer-style pick on roc_auc with gap <= 0.6 and an accuracy floor of 0.48."""
    b = SEL.best_model(_view(spark, sf, "roc_auc"), "roc_auc", 0.6, 0.48)
    return b.withColumn("gap", F.round("gap", 6))


@register("sel1_best_model_none", _VIEW_SQL.format(p="accuracy") + """
SELECT model, seq, train_score, test_score, test_accuracy, round(train_score - test_score, 6) AS gap FROM v
WHERE train_score - test_score <= 0.05 AND test_accuracy >= 0.805 ORDER BY gap, seq DESC LIMIT 1""")
def sel1_best_model_none(spark, sf):
    """Evaluation thresholds (accuracy, 0.05, 0.805): no stand-in model reaches the floor -> empty."""
    b = SEL.best_model(_view(spark, sf, "accuracy"), "accuracy", 0.05, 0.805)
    return b.withColumn("gap", F.round("gap", 6))


@register("sel2_overfit_flag", _VIEW_SQL.format(p="f1") + """
SELECT model, seq, train_score, test_score, test_accuracy, round(train_score - test_score, 6) AS gap,
  train_score - test_score > 0.05 AS overfit_warning FROM v""")
def sel2_overfit_flag(spark, sf):
    v = SEL.flag_overfit(SEL.train_test_view(_view(spark, sf, "f1"), "f1"))
    return v.withColumn("gap", F.round("gap", 6))


@register("sel3_gate_history", """
SELECT o_custkey, o_orderkey, o_totalprice, threshold_before,
  threshold_before IS NULL OR o_totalprice > threshold_before AS accepted
FROM (SELECT *, greatest(coalesce(max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100000.0), 100000.0) AS threshold_before FROM orders)""")
def sel3_gate_history(spark, sf):
    """Per customer, each order is a candidate; accepted iff it beats the stored threshold
    (initial 100000) and all earlier candidates."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return SEL.gate_history(o, "o_custkey", "o_orderkey", "o_totalprice", initial=100000.0)


def _sel4_sql(stored):
    return _VIEW_SQL.format(p="roc_auc") + f""",
b AS (SELECT * FROM v WHERE train_score - test_score <= 0.02 AND test_accuracy >= 0.48 ORDER BY train_score - test_score, seq DESC LIMIT 1)
SELECT model, test_score, test_accuracy, test_accuracy > {stored} AS accepted,
  CASE WHEN test_accuracy > {stored} THEN test_accuracy ELSE {stored} END AS new_threshold FROM b"""


@register("sel4_challenger_gate", _sel4_sql(0.45))
def sel4_challenger_gate(spark, sf):
    """All models together: SEL1 on roc_auc (gap 0.02), then the pick's test accuracy against a
    stored threshold that it beats."""
    return SEL.challenger_gate(_view(spark, sf, "roc_auc"), 0.45, "roc_auc", 0.02, 0.48)


@register("sel4_challenger_rejected", _sel4_sql(0.805))
def sel4_challenger_rejected(spark, sf):
    """The same pick against the pusher's stored threshold, which it does not reach."""
    return SEL.challenger_gate(_view(spark, sf, "roc_auc"), 0.805, "roc_auc", 0.02, 0.48)


@register("sel3_gate_large_keys", """
SELECT o_custkey, seq, score, threshold_before, threshold_before IS NULL OR score > threshold_before AS accepted
FROM (SELECT o_custkey, o_orderkey + 9007199254740992 AS seq, o_totalprice AS score,
  max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  AS threshold_before FROM orders)""")
def sel3_gate_large_keys(spark, sf):
    """The history with sequence numbers beyond 2^53, where doubles no longer tell neighbours apart."""
    o = table(spark, sf, "orders").select("o_custkey", (F.col("o_orderkey") + F.lit(2 ** 53)).alias("seq"),
                                          F.col("o_totalprice").alias("score"))
    return SEL.gate_history(o, "o_custkey", "seq", "score")


@register("sel5_history_upsert", """
SELECT o_orderdate_key, o_orderkey, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderdate_key ORDER BY seq, o_orderkey) AS rn FROM (
    SELECT strftime(o_orderdate, '%Y-%m') AS o_orderdate_key, o_orderkey, 0 AS seq FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT strftime(o_orderdate, '%Y-%m'), o_orderkey, 1 FROM orders WHERE o_orderstatus <> 'F'))
WHERE rn = 1""")
def sel5_history_upsert(spark, sf):
    """Run history keyed by month: existing (status F) entries win over new ones on equal keys;
    within one side the lowest order key stands for the run."""
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("o_orderdate_key"),
                                          "o_orderkey", "o_orderstatus")
    old = o.where(F.col("o_orderstatus") == "F").select("o_orderdate_key", "o_orderkey", F.lit(0).alias("seq"))
    new = o.where(F.col("o_orderstatus") != "F").select("o_orderdate_key", "o_orderkey", F.lit(1).alias("seq"))
    return SEL.upsert_first_wins(old, new, "o_orderdate_key", ("seq", "o_orderkey"))


@register("ml10_keep_best_registry", """
SELECT o_orderpriority, o_orderkey, score, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY score DESC, seq) AS rn FROM (
    SELECT o_orderpriority, o_orderkey, round(o_totalprice / 1000) AS score, o_orderkey AS seq FROM orders))
WHERE rn = 1""")
def ml10_keep_best_registry(spark, sf):
    """Registry upsert: per key keep the strictly best score; on a tie the earlier entry stays."""
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_orderstatus",
                                          F.round(F.col("o_totalprice") / 1000).alias("score"),
                                          F.col("o_orderkey").alias("seq"))
    old = o.where(F.col("o_orderstatus") == "F").drop("o_orderstatus")
    new = o.where(F.col("o_orderstatus") != "F").drop("o_orderstatus")
    return SEL.keep_best(old, new, "o_orderpriority", "score")


@register("ml10_nan_score", """
SELECT o_orderpriority, o_orderkey, score FROM (
  SELECT o_orderpriority, o_orderkey, o_totalprice AS score,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn
  FROM orders WHERE o_orderkey % 3 <> 0) WHERE rn = 1""")
def ml10_nan_score(spark, sf):
    """Every third entry has the score NaN: none of them may win."""
    o = table(spark, sf, "orders").select(
        "o_orderpriority", "o_orderkey", F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("score"))
    return SEL.keep_best(o.where("seq % 2 = 0"), o.where("seq % 2 = 1"), "o_orderpriority", "score").drop("seq")
