"""Demo queries: metrics and curves (EV1-EV12, WIN1, SNK4).

Stand-in predictions on every lineitem row: target ``l_returnflag = 'R'``,
P(1) ``(l_quantity / 50 + l_discount * 10) / 2`` (many ties), split by the
seeded md5 hold-out.  Three score formulas act as three models for EV12.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as EV
from ..operators.split import random_split
from ..session import table
from .registry import register

MODELS_SQL = {
    "qty_disc": "(l_quantity / 50 + l_discount * 10) / 2",
    "disc": "l_discount * 10",
    "tax": "1 - l_tax * 12.5",
}


def predictions(spark, sf, model: str = "qty_disc"):
    li = table(spark, sf, "lineitem")
    li = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), "l_returnflag", "l_linestatus",
                   "l_linenumber", "l_quantity", "l_discount", "l_tax")
    exprs = {"qty_disc": (F.col("l_quantity") / 50 + F.col("l_discount") * 10) / 2,
             "disc": F.col("l_discount") * 10, "tax": 1 - F.col("l_tax") * 12.5}
    p = li.select("k", "l_linestatus", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("target"),
                  exprs[model].alias("prediction"))
    return random_split(p, "k", 0.2, seed=1961)


def _pred_sql(model: str = "qty_disc") -> str:
    return f"""(SELECT l_orderkey * 8 + l_linenumber AS k, l_linestatus, l_linenumber,
  CASE WHEN substr(md5('1961:' || (l_orderkey * 8 + l_linenumber)), 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS split,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS target, {MODELS_SQL[model]} AS prediction FROM lineitem)"""


P = _pred_sql()
_M = ("accuracy", "precision", "recall", "f1", "roc_auc", "log_loss", "tpr", "tnr", "fpr", "fnr")


def _round(df, cols, d=6):
    return df.withColumns({c: F.round(c, d) for c in cols})


_QUALITY_SQL = """
WITH p AS {P},
c AS (SELECT {G}, prediction AS score, sum(target) AS pos, sum(1 - target) AS neg FROM p GROUP BY ALL),
r AS (SELECT *, sum(neg) OVER (PARTITION BY {G} ORDER BY score ROWS UNBOUNDED PRECEDING) AS cum_neg FROM c),
a AS (SELECT {G}, sum(pos * (cum_neg - neg + neg / 2.0)) / (sum(pos) * sum(neg)) AS roc_auc FROM r GROUP BY ALL),
q AS (SELECT {G}, count(*) AS n,
  count_if(target = 1 AND prediction >= 0.5) AS tp, count_if(target = 0 AND prediction >= 0.5) AS fp,
  count_if(target = 1 AND prediction < 0.5) AS fn, count_if(target = 0 AND prediction < 0.5) AS tn,
  avg(-(target * ln(least(greatest(prediction, 1e-15), 1 - 1e-15))
        + (1 - target) * ln(1 - least(greatest(prediction, 1e-15), 1 - 1e-15)))) AS log_loss FROM p GROUP BY ALL)
SELECT {G}, n, tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision,
  round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1,
  round(roc_auc, 6) AS roc_auc, round(log_loss, 6) AS log_loss, round(tp / nullif(tp + fn, 0), 6) AS tpr,
  round(tn / nullif(tn + fp, 0), 6) AS tnr, round(fp / nullif(fp + tn, 0), 6) AS fpr, round(fn / nullif(fn + tp, 0), 6) AS fnr
FROM q JOIN a USING ({G})"""


@register("ev1_quality", _QUALITY_SQL.format(P=P, G="split"))
def ev1_quality(spark, sf):
    return _round(EV.quality(predictions(spark, sf), ["split"]), _M)


@register("ev2_class_balance", f"""
SELECT split, target, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS share
FROM {P} GROUP BY 1, 2""")
def ev2_class_balance(spark, sf):
    return _round(EV.class_balance(predictions(spark, sf), ["split"]), ["share"])


@register("ev3_confusion_matrix", f"""
WITH p AS {P}, s AS (SELECT DISTINCT split FROM p),
cells AS (SELECT split, a AS actual, b AS predicted FROM s, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(a, b))
SELECT cells.split, actual, predicted, count(p.k) AS count FROM cells LEFT JOIN p
  ON p.split = cells.split AND p.target = actual AND (p.prediction >= 0.5)::INT = predicted GROUP BY ALL""")
def ev3_confusion_matrix(spark, sf):
    return EV.confusion_matrix(predictions(spark, sf), ["split"])


@register("ev4_quality_by_class", f"""
WITH p AS {P},
c AS (SELECT split, cls AS label, count_if(target = cls AND (prediction >= 0.5) = (cls = 1)) AS tp,
  count_if(target <> cls AND (prediction >= 0.5) = (cls = 1)) AS fp,
  count_if(target = cls AND (prediction >= 0.5) <> (cls = 1)) AS fn
  FROM p, (VALUES (0), (1)) v(cls) GROUP BY ALL),
per AS (SELECT split, label::VARCHAR AS label, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall,
  2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, tp + fn AS support FROM c),
allrows AS (SELECT * FROM per
  UNION ALL SELECT split, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per GROUP BY split
  UNION ALL SELECT split, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) FROM per GROUP BY split)
SELECT split, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  support::BIGINT AS support FROM allrows""")
def ev4_quality_by_class(spark, sf):
    return _round(EV.quality_by_class(predictions(spark, sf), ["split"]), ["precision", "recall", "f1"])


@register("ev5_class_separation", f"""
SELECT split, target, count(*) AS n, min(prediction) AS min, max(prediction) AS max,
  round(quantile_cont(prediction, 0.05), 6) AS p05, round(quantile_cont(prediction, 0.25), 6) AS p25,
  round(quantile_cont(prediction, 0.5), 6) AS p50, round(quantile_cont(prediction, 0.75), 6) AS p75,
  round(quantile_cont(prediction, 0.95), 6) AS p95 FROM {P} GROUP BY 1, 2""")
def ev5_class_separation(spark, sf):
    return _round(EV.class_separation(predictions(spark, sf), ["split"], exact=True), ["p05", "p25", "p50", "p75", "p95"])


@register("ev6_score_distribution", f"""
SELECT split, target, least(floor(prediction * 20)::INT, 19) AS bin, count(*) AS count FROM {P} GROUP BY 1, 2, 3""")
def ev6_score_distribution(spark, sf):
    return EV.score_distribution(predictions(spark, sf), ["split"])


_CURVE_SQL = f"""
WITH c AS (SELECT split, prediction AS score, sum(target) AS pos, sum(1 - target) AS neg FROM {P} GROUP BY 1, 2),
r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY split) AS tot_p,
  sum(neg) OVER (PARTITION BY split) AS tot_n FROM c
  WINDOW w AS (PARTITION BY split ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@register("win1_running_counts", _CURVE_SQL + """
SELECT split, score AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(fp / tot_n, 6) AS fpr, round(tp / tot_p, 6) AS tpr,
  round(tp / (tp + fp), 6) AS precision, round(tp / tot_p, 6) AS recall FROM r""")
def win1_running_counts(spark, sf):
    return _round(EV.curve_points(predictions(spark, sf), ["split"]), ["fpr", "tpr", "precision", "recall"])


@register("ev7_roc_curve", _CURVE_SQL + """
SELECT split, score AS threshold, round(fp / tot_n, 6) AS fpr, round(tp / tot_p, 6) AS tpr FROM r""")
def ev7_roc_curve(spark, sf):
    return _round(EV.roc_curve(predictions(spark, sf), ["split"]), ["fpr", "tpr"])


@register("ev8_roc_auc", f"""
WITH c AS (SELECT split, prediction AS score, sum(target) AS pos, sum(1 - target) AS neg FROM {P} GROUP BY 1, 2),
r AS (SELECT *, sum(neg) OVER (PARTITION BY split ORDER BY score ROWS UNBOUNDED PRECEDING) AS cum_neg FROM c)
SELECT split, round(sum(pos * (cum_neg - neg + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM r GROUP BY 1""")
def ev8_roc_auc(spark, sf):
    return _round(EV.roc_auc(predictions(spark, sf), ["split"]), ["roc_auc"])


@register("ev9_pr_curve", _CURVE_SQL + """
SELECT split, score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / tot_p, 6) AS recall FROM r""")
def ev9_pr_curve(spark, sf):
    return _round(EV.pr_curve(predictions(spark, sf), ["split"]), ["precision", "recall"])


@register("ev10_pr_table", f"""
WITH c AS (SELECT split, prediction AS score, sum(target) AS pos, sum(1 - target) AS neg, count(*) AS n_s FROM {P} GROUP BY 1, 2),
r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(n_s) OVER w AS cum_n,
  sum(n_s) OVER (PARTITION BY split) AS n, sum(pos) OVER (PARTITION BY split) AS tot_p FROM c
  WINDOW w AS (PARTITION BY split ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
x AS (SELECT * FROM r, (SELECT unnest(range(5, 101, 5)) AS top_percent) t
  WHERE ceil(top_percent * n / 100.0::DOUBLE) > cum_n - n_s AND ceil(top_percent * n / 100.0::DOUBLE) <= cum_n)
SELECT split, top_percent::INT AS top_percent, score AS threshold, cum_n::BIGINT AS count, tp::BIGINT AS tp,
  fp::BIGINT AS fp, round(tp / (tp + fp), 6) AS precision, round(tp / tot_p, 6) AS recall FROM x""")
def ev10_pr_table(spark, sf):
    return _round(EV.pr_table(predictions(spark, sf), ["split"]), ["precision", "recall"])


@register("ev11_quality_by_feature", f"""
WITH p AS {P},
l AS (SELECT split, target, prediction, 'l_linestatus' AS feature, l_linestatus AS value FROM p
  UNION ALL SELECT split, target, prediction, 'l_linenumber', l_linenumber::VARCHAR FROM p),
q AS (SELECT split, feature, value, count(*) AS n,
  count_if(target = 1 AND prediction >= 0.5) AS tp, count_if(target = 0 AND prediction >= 0.5) AS fp,
  count_if(target = 1 AND prediction < 0.5) AS fn, count_if(target = 0 AND prediction < 0.5) AS tn FROM l GROUP BY ALL)
SELECT split, feature, value, n, tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy,
  round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM q""")
def ev11_quality_by_feature(spark, sf):
    q = EV.quality_by_feature(predictions(spark, sf), ["l_linestatus", "l_linenumber"], ["split"])
    return _round(q.select("split", "feature", "value", "n", "tp", "fp", "fn", "tn", "accuracy", "precision", "recall"),
                  ["accuracy", "precision", "recall"])


def _models_sql() -> str:
    parts = []
    for i, m in enumerate(MODELS_SQL):
        parts.append(f"SELECT '{m}' AS model, {i} AS seq, split, target, prediction FROM {_pred_sql(m)}")
    return "(" + " UNION ALL ".join(parts) + ")"


def evaluated_models(spark, sf):
    return EV.evaluate_models({m: predictions(spark, sf, m) for m in MODELS_SQL})


@register("ev12_evaluate_models", _QUALITY_SQL.format(P=_models_sql(), G="model, seq, split"))
def ev12_evaluate_models(spark, sf):
    return _round(evaluated_models(spark, sf), _M)


@register("snk4_metric_report", f"""
WITH m AS ({_QUALITY_SQL.format(P=P, G="split")})
SELECT split || '_' || metric AS key, value FROM (UNPIVOT (SELECT split, {", ".join(_M)} FROM m)
  ON {", ".join(_M)} INTO NAME metric VALUE value)""")
def snk4_metric_report(spark, sf):
    """Metric report keyed test_<metric> / train_<metric>, written as one JSON object and read back."""
    from ..session import scratch_path
    from ..sources.files import read_json_report, write_json_report
    path = scratch_path(spark, "metric-report")
    write_json_report(EV.flatten_report(_round(EV.quality(predictions(spark, sf), ["split"]), _M)), path)
    return read_json_report(spark, path)
