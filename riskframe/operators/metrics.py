"""Binary classification metrics and curves (EV1-EV12).

Input rows carry ``target`` (0/1), ``prediction`` (P(class 1)) and any number
of group columns (model, split, feature bin...).  Everything is computed by
aggregations over the rows - never by collecting scores - and curves use the
two-phase running sums of ``prefix`` over *distinct* scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MetricConfig
from ..session import keep
from .prefix import running_sums
from .keys import join_on

METRIC_NAMES = ("accuracy", "precision", "recall", "f1", "roc_auc", "log_loss", "tpr", "tnr", "fpr", "fnr")


def score_counts(pred: DataFrame, groups: Sequence[str], target: str = "target",
                 score: str = "prediction") -> DataFrame:
    """(groups, score) -> positives, negatives; partial aggregation shrinks hot scores map-side.
    Rows without a score or a target are measured by nothing and left out."""
    pred = pred.where(F.col(target).isNotNull() & F.col(score).isNotNull())
    return pred.groupBy(*groups, F.col(score).alias("score")).agg(
        F.sum(F.col(target)).cast("long").alias("pos"),
        F.sum(1 - F.col(target)).cast("long").alias("neg"))


def roc_auc(pred: DataFrame, groups: Sequence[str] = (), target: str = "target",
            score: str = "prediction", buckets: int | None = None) -> DataFrame:
    """EV8: exact ROC AUC per group; tied scores count one half."""
    return _auc(score_counts(pred, list(groups), target, score), list(groups), buckets)


def _auc(counts: DataFrame, groups: list, buckets: int | None = None) -> DataFrame:
    r = running_sums(counts, groups, "score", ["neg"], buckets=buckets)
    # negatives strictly below this score = inclusive running count - this score's count
    part = r.groupBy(*groups).agg(
        F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0)).alias("_num"),
        F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    return part.select(*groups, F.try_divide(F.col("_num"), F.col("_P") * F.col("_N")).alias("roc_auc"))


def quality(pred: DataFrame, groups: Sequence[str] = (), cfg: MetricConfig = MetricConfig(),
            target: str = "target", score: str = "prediction", with_auc: bool = True) -> DataFrame:
    """EV1: accuracy, precision, recall, f1, roc_auc, log_loss, tpr, tnr, fpr, fnr per group.

    All of them follow from the counts of positives and negatives per distinct score, which
    are written once, so the rows are scanned (and models applied) a single time.  Rows
    without a score or a target are measured by nothing and are not counted in ``n``.
    """
    groups = list(groups)
    c = score_counts(pred, groups, target, score)
    if with_auc:
        c = keep(c, "score-counts")
    p, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    hit = p >= F.lit(cfg.threshold)
    pc = F.least(F.greatest(p, F.lit(cfg.log_loss_eps)), F.lit(1 - cfg.log_loss_eps))

    def total(x, when):
        return F.coalesce(F.sum(F.when(when, x)), F.lit(0))

    cells = c.groupBy(*groups).agg(
        F.coalesce(F.sum(pos + neg), F.lit(0)).alias("n"),
        total(pos, hit).alias("tp"), total(neg, hit).alias("fp"), total(pos, ~hit).alias("fn"), total(neg, ~hit).alias("tn"),
        F.try_divide(F.sum(-(pos * F.log(pc) + neg * F.log(1 - pc))), F.sum(pos + neg)).alias("log_loss"))
    out = _rates(cells)
    if with_auc and groups:
        return join_on(out, _auc(c, groups), groups)
    if with_auc:  # one row on either side
        return join_on(out.withColumn("_one", F.col("n") >= 0), _auc(c, []).withColumn(
            "_one", F.coalesce(F.col("roc_auc") >= 0, F.lit(True))), ["_one"], "left").drop("_one")
    return out


def _rates(c: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec = F.try_divide(tp, tp + fp)
    rec = F.try_divide(tp, tp + fn)
    return c.withColumns({
        "accuracy": F.try_divide(tp + tn, F.col("n")),
        "precision": prec, "recall": rec,
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
        "tpr": rec, "tnr": F.try_divide(tn, tn + fp),
        "fpr": F.try_divide(fp, fp + tn), "fnr": F.try_divide(fn, fn + tp)})


def class_balance(pred: DataFrame, groups: Sequence[str] = (), target: str = "target") -> DataFrame:
    """EV2: rows and share of each class per group."""
    from pyspark.sql import Window
    c = pred.groupBy(*groups, target).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*groups)))


def confusion_matrix(pred: DataFrame, groups: Sequence[str] = (), cfg: MetricConfig = MetricConfig(),
                     target: str = "target", score: str = "prediction") -> DataFrame:
    """EV3: (groups, actual, predicted, count) with all four cells present (zeros kept)."""
    t, hit = F.col(target), F.col(score) >= F.lit(cfg.threshold)
    c = pred.groupBy(*groups).agg(
        F.count_if((t == 1) & hit).alias("c11"), F.count_if((t == 0) & hit).alias("c01"),
        F.count_if((t == 1) & ~hit).alias("c10"), F.count_if((t == 0) & ~hit).alias("c00"))
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(f"c{a}{b}").alias("count"))
                      for a in (0, 1) for b in (0, 1)])
    return c.select(*groups, F.explode(cells).alias("x")).select(*groups, "x.*")


def quality_by_class(pred: DataFrame, groups: Sequence[str] = (), cfg: MetricConfig = MetricConfig(),
                     target: str = "target", score: str = "prediction") -> DataFrame:
    """EV4: precision / recall / f1 / support per class, plus macro and weighted averages."""
    groups = list(groups)
    cm = confusion_matrix(pred, groups, cfg, target, score)
    w = cm.groupBy(*groups).agg(*[F.sum(F.when((F.col("actual") == a) & (F.col("predicted") == b), F.col("count")))
                                  .alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])
    rows = []
    for k in (0, 1):
        o = 1 - k
        tp, fp, fn = F.col(f"c{k}{k}"), F.col(f"c{o}{k}"), F.col(f"c{k}{o}")
        rows.append(F.struct(F.lit(str(k)).alias("label"), F.try_divide(tp, tp + fp).alias("precision"),
                             F.try_divide(tp, tp + fn).alias("recall"),
                             F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support")))
    per = w.select(*groups, F.explode(F.array(*rows)).alias("r")).select(*groups, "r.*")
    n = F.sum("support")
    macro = per.groupBy(*groups).agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                                     F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), n.alias("support"))
    weighted = per.groupBy(*groups).agg(
        F.lit("weighted avg").alias("label"),
        *[(F.sum(F.col(m) * F.col("support")) / n).alias(m) for m in ("precision", "recall", "f1")],
        n.alias("support"))
    return per.unionByName(macro).unionByName(weighted)


def class_separation(pred: DataFrame, groups: Sequence[str] = (), target: str = "target",
                     score: str = "prediction", probs: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95),
                     exact: bool = False) -> DataFrame:
    """EV5: score quantiles per class (summaries, never all points); sketches unless ``exact``."""
    from .aggregates import quantile_columns, quantiles
    keys = [*groups, target]
    p = F.col(score)
    base = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(p).alias("min"), F.max(p).alias("max"))
    q = quantile_columns(quantiles(pred, [score], probs, groups=keys, exact=exact), keys,
                         {q: f"p{int(round(q * 100)):02d}" for q in probs})
    return join_on(base, q, keys, "left")


def score_distribution(pred: DataFrame, groups: Sequence[str] = (), target: str = "target",
                       score: str = "prediction", nbins: int = 20) -> DataFrame:
    """EV6: histogram of P(1) on [0, 1] per class; 1.0 folds into the last bin."""
    b = F.least(F.floor(F.col(score) * nbins).cast("int"), F.lit(nbins - 1))
    return pred.groupBy(*groups, target, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def curve_points(pred: DataFrame, groups: Sequence[str] = (), target: str = "target",
                 score: str = "prediction", buckets: int | None = None) -> DataFrame:
    """WIN1 / EV7 / EV9: cumulative counts at each distinct threshold, highest score first.

    Columns: threshold, tp, fp (rows scoring >= threshold), fpr, tpr, precision, recall.
    """
    c = score_counts(pred, list(groups), target, score)
    r = running_sums(c, groups, "score", ["pos", "neg"], descending=True, buckets=buckets, totals=True)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    return r.select(*groups, F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
                    F.try_divide(fp, F.col("all_neg")).alias("fpr"), F.try_divide(tp, F.col("all_pos")).alias("tpr"),
                    F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, F.col("all_pos")).alias("recall"))


def roc_curve(pred: DataFrame, groups: Sequence[str] = (), **kw) -> DataFrame:
    """EV7: (threshold, fpr, tpr) per distinct score."""
    return curve_points(pred, groups, **kw).select(*groups, "threshold", "fpr", "tpr")


def pr_curve(pred: DataFrame, groups: Sequence[str] = (), **kw) -> DataFrame:
    """EV9: (threshold, precision, recall) per distinct score."""
    return curve_points(pred, groups, **kw).select(*groups, "threshold", "precision", "recall")


def pr_table(pred: DataFrame, groups: Sequence[str] = (), step: int = 5, target: str = "target",
             score: str = "prediction", buckets: int | None = None) -> DataFrame:
    """EV10: for the top 5 %, 10 %, ... of rows by score: threshold, count, tp, fp, precision, recall.

    The cut at top x % is the score of the ceil(x % * n)-th row; all rows tied
    with it are included (so the table does not depend on tie order).
    """
    c = score_counts(pred, list(groups), target, score).withColumn("n_s", F.col("pos") + F.col("neg"))
    r = running_sums(c, groups, "score", ["pos", "neg", "n_s"], descending=True, buckets=buckets, totals=True)
    # a distinct score covers positions (cum_n_s - n_s, cum_n_s]; the cuts x with ceil(x n / 100) inside
    # are the multiples of the step from `first` to `last`, for most scores none
    n, end = F.col("all_n_s"), F.col("cum_n_s")
    last = F.floor(end * 100 / n / step)
    first = F.floor((end - F.col("n_s")) * 100 / n / step)
    at = lambda i: F.ceil(i * step * n / 100.0)
    cuts = F.filter(F.sequence(first, last + 1),
                    lambda i: (i > 0) & (i * step <= 100) & (at(i) > end - F.col("n_s")) & (at(i) <= end))
    x = r.withColumn("top_percent", F.explode(F.transform(cuts, lambda i: (i * step).cast("int"))))
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    return x.select(*groups, "top_percent", F.col("score").alias("threshold"), F.col("cum_n_s").alias("count"),
                    tp.alias("tp"), fp.alias("fp"), F.try_divide(tp, tp + fp).alias("precision"),
                    F.try_divide(tp, F.col("all_pos")).alias("recall"))


def quality_by_feature(pred: DataFrame, features: Sequence[str], groups: Sequence[str] = (),
                       cfg: MetricConfig = MetricConfig(), target: str = "target",
                       score: str = "prediction") -> DataFrame:
    """EV11: EV1 per (feature, feature value) for all features via one unpivot."""
    long = pred.select(*groups, target, score, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features])).alias("fv"))
    long = long.select(*groups, target, score, "fv.feature", "fv.value")
    return quality(long, [*groups, "feature", "value"], cfg, target, score, with_auc=False)


def evaluate_models(scored: dict[str, DataFrame], cfg: MetricConfig = MetricConfig(),
                    split: str = "split") -> DataFrame:
    """EV12: all models' predictions tagged and unioned, measured in one job per (model, split)."""
    tagged = None
    for i, (name, df) in enumerate(scored.items()):
        t = df.select(F.lit(name).alias("model"), F.lit(i).alias("seq"), split, "target", "prediction")
        tagged = t if tagged is None else tagged.unionByName(t)
    return quality(tagged, ["model", "seq", split], cfg)


def flatten_report(metrics: DataFrame, split: str = "split", groups: Sequence[str] = (),
                   names: Sequence[str] = METRIC_NAMES) -> DataFrame:
    """SNK4: metric rows -> (groups, key = '<split>_<metric>', value) records."""
    long = metrics.select(*groups, split, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])).alias("m"))
    return long.select(*groups, F.concat_ws("_", F.col(split), F.col("m.metric")).alias("key"), F.col("m.value").alias("value"))
