"""Demo queries: feature unit, training, tuning, scoring (FE10, ML1-ML14, SNK5, SNK6, SCO1-SCO4).

Training data: every lineitem row, label ``l_returnflag = 'R'``, features
from the lineitem feature config (prepared + one-hot) plus raw discount and
tax; folds from the stratified md5 fold id (SPL3), hold-out from SPL1.
Searches draw from the full ranges in ``training.SPACES``, are fitted on all
rows of the train part with early stopping for the boosting families, and
take the number of trials as an argument.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TRAINER_GATE
from ..operators import metrics as EV
from ..operators import scoring as SCO
from ..operators import selection as SEL
from ..operators import training as ML
from ..operators.features import counted_rows, feature_unit, fit_feature_unit, fit_segments, unit_names
from ..operators.split import seeded_hash, stratified_folds, stratified_split
from ..operators.target_stats import ordered_target_means
from ..session import keep, scratch_path, table
from ..sources.files import read_csv, write_csv
from .q_features import LINE_GROUPS
from .registry import register

FAMILIES = ("GBT", "RF", "LGBM", "XGB", "CATBOOST")
#: trials per family (an argument of every search; the original's default is 1000)
TRIALS = 1
#: labelled rows that a task of the fits below has at least (see ``training.written_rows``)
FIT_ROWS = ML.FIT_ROWS


#: targets of the demos: one that the features hardly tell, one that they do
RETURNED, REVENUE = "l_returnflag = 'R'", "l_extendedprice * (1 - l_discount) > 35000"


def labelled(spark, sf, target=RETURNED):
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"),
                     F.expr(target).cast("double").alias("label"),
                     "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linestatus")


def split_labelled(spark, sf):
    """Labelled rows with the stratified hold-out, cut from their lineage once: the fits and
    the scoring below read it several times, and the split windows should not be recomputed."""
    return keep(stratified_split(labelled(spark, sf), "label", "k", 0.2, seed=1961), "split-rows")


def unit():
    return feature_unit(LINE_GROUPS, categorical=["l_linestatus"], extra=["l_discount", "l_tax"])


def prepared(spark, sf, target=RETURNED):
    """(k, label, split, fold, is_val, features): unit fitted on the train part, applied to all rows.

    ``is_val`` marks a seeded 1/16 of the rows (first md5 hex digit 0) as the early-stopping
    set of the boosting variant, so every CV training fold has validation rows."""
    d = stratified_split(labelled(spark, sf, target), "label", "k", 0.2, seed=1961)
    d = stratified_folds(d, "label", "k", k=5, seed=1)
    d = keep(d.withColumn("is_val", F.substring(F.md5(F.col("k").cast("string")), 1, 1) == "0"), "prepared")
    model = unit().fit(d.where(F.col("split") == "train"))
    return model.transform(d), model


@register("fe10_feature_unit")
def fe10_feature_unit(spark, sf):
    """Prepare + one-hot + assemble + clusters (elbow over k = 2..14) fitted once, saved and re-loaded
    as one unit (SNK6) that appends features and cluster to raw rows."""
    d = split_labelled(spark, sf)
    train = d.where(F.col("split") == "train")
    model = fit_feature_unit(unit(), train)
    path = scratch_path(spark, "feature-unit")
    ML.save_unit(model, path)
    return ML.load_unit(path).transform(d).select("k", "split", "features", "cluster")


@register("snk6_model_unit")
def snk6_model_unit(spark, sf):
    """Feature unit + classifier saved as one PipelineModel, loaded back and scored."""
    d = split_labelled(spark, sf)
    stages = [*unit().getStages(), ML.make_estimator("GBT")]
    train = d.where(F.col("split") == "train")
    model = ML.fit_unit(stages, train)
    path = scratch_path(spark, "model-unit")
    ML.save_unit(model, path)
    return SCO.score(ML.load_unit(path), d, ["k", "split", "label"])


def _fit_rows(data, n=None):
    """All rows of the train part (``n`` rows, counted if not given), which the searches and classifiers are fitted on."""
    train = data.where(F.col("split") == "train")
    return ML.written_rows(train.select("k", "label", "fold", "is_val", "features"), train.count() if n is None else n,
                           ("label", seeded_hash("k", 1), "k"), FIT_ROWS)


def _cv_family(spark, sf, family, n=TRIALS):
    data, _ = prepared(spark, sf)
    params = ML.sample_params(ML.SPACES[family], n, 1961)
    est = ML.make_estimator(family, validation_col="is_val")
    return ML.trial_log(family, params, ML.cross_validate(est, params, _fit_rows(data)))


@register("ml1_gbt_search")
def ml1_gbt_search(spark, sf):
    """Gradient-boosted trees, sampled space, 5-fold stratified CV AUC per trial."""
    return _cv_family(spark, sf, "GBT")


@register("ml2_rf_search")
def ml2_rf_search(spark, sf):
    return _cv_family(spark, sf, "RF")


@register("ml4_lgbm_style_search")
def ml4_lgbm_style_search(spark, sf):
    """LightGBM-style space re-aimed on GBTClassifier."""
    return _cv_family(spark, sf, "LGBM")


@register("ml5_xgb_style_search")
def ml5_xgb_style_search(spark, sf):
    """XGBoost-style space re-aimed on GBTClassifier."""
    return _cv_family(spark, sf, "XGB")


_CATEGORIES = ["l_linenumber", "l_linestatus", "l_quantity"]


@register("ml6_ordered_target_statistics", "WITH d AS (SELECT l_orderkey * 8 + l_linenumber AS k, l_linenumber, l_linestatus, l_quantity, "
          "(l_returnflag = 'R')::INT::DOUBLE AS y, avg((l_returnflag = 'R')::INT) OVER () AS p FROM lineitem) SELECT k, " + ", ".join(
              f"round((coalesce(sum(y) OVER w{i}, 0) + p) / (count(*) OVER w{i} + 1), 9) AS {c}_ts" for i, c in enumerate(_CATEGORIES))
          + " FROM d WINDOW " + ", ".join(f"w{i} AS (PARTITION BY {c} ORDER BY md5('1961:' || k), k ROWS BETWEEN UNBOUNDED PRECEDING "
                                          "AND CURRENT ROW EXCLUDE GROUP)" for i, c in enumerate(_CATEGORIES)))
def ml6_ordered_target_statistics(spark, sf):
    """Line number, status and quantity of every line as the mean label of earlier lines alike."""
    d = labelled(spark, sf).select("k", F.col("label"), *_CATEGORIES)
    out = ordered_target_means(keep(d, "lines"), "k", "label", _CATEGORIES, seed=1961)
    return out.select("k", *[F.round(f"{c}_ts", 9).alias(f"{c}_ts") for c in _CATEGORIES])


@register("ml6_catboost_style_search")
def ml6_catboost_style_search(spark, sf):
    """CatBoost-style boosting: categories as ordered target statistics of the train part, beside the raw
    numbers, with early stopping on a validation indicator column."""
    d = stratified_folds(stratified_split(labelled(spark, sf), "label", "k", 0.2, seed=1961), "label", "k", k=5, seed=1)
    d = d.withColumn("is_val", F.substring(F.md5(F.col("k").cast("string")), 1, 1) == "0")
    train = keep(d.where(F.col("split") == "train"), "train-lines")
    encoded = ordered_target_means(train, "k", "label", _CATEGORIES)
    assembler = VectorAssembler(inputCols=[*[f"{c}_ts" for c in _CATEGORIES], "l_extendedprice", "l_discount", "l_tax"], outputCol="features")
    params = ML.sample_params(ML.SPACES["CATBOOST"], TRIALS, 1961)
    est = ML.make_estimator("CATBOOST", validation_col="is_val")
    return ML.trial_log("CATBOOST", params, ML.cross_validate(est, params, _fit_rows(assembler.transform(encoded), train.count())))


@register("ml7_cross_validation")
def ml7_cross_validation(spark, sf):
    """One GBT parameter set: the AUC of each fold (folds = SPL3 ids)."""
    data, _ = prepared(spark, sf)
    est = ML.make_estimator("GBT", validation_col="is_val")
    return ML.fold_scores(est, ML.sample_params(ML.SPACES["GBT"], 1, 7)[0], _fit_rows(data))


def _search(spark, sf, families=FAMILIES, trials=TRIALS, target=RETURNED):
    data, unit_model = prepared(spark, sf, target)
    rows = _fit_rows(data)
    reg, log = ML.search(rows, families, trials)
    return data, rows, reg, log, unit_model


@register("ml9_family_search")
def ml9_family_search(spark, sf):
    """Search the configured families in fixed order; best parameters + CV score per family."""
    return _search(spark, sf)[2]


@register("ml8_search_registry")
def ml8_search_registry(spark, sf):
    """A second search with other trials merged into the stored registry of the first (ML10
    upsert): per family the strictly better score stays, an equal one keeps the stored entry."""
    data, _ = prepared(spark, sf)
    rows = _fit_rows(data)
    stored = keep(ML.search(rows, ("GBT", "LGBM"), TRIALS)[0], "param-registry")
    new = ML.search(rows, ("GBT", "LGBM"), TRIALS, seed=2024)[0]
    return SEL.keep_best(stored, new.withColumn("seq", F.col("seq") + 100), "family", "score")


@register("snk5_trial_log")
def snk5_trial_log(spark, sf):
    """Trial log (one row per trial) written as CSV and read back."""
    log = _cv_family(spark, sf, "LGBM", 2)
    path = scratch_path(spark, "trial-log")
    write_csv(log.select("family", "trial", F.to_json("params").alias("params"), "score"), path)
    return read_csv(spark, path, "family string, trial int, params string, score double")


def _refit_all(data, rows, reg):
    """Every family refitted with its registry parameters and applied to all rows."""
    models = {r["family"]: ML.refit(r["family"], r["params"], rows) for r in reg.orderBy("seq").collect()}
    scored = {f: SCO.score(m, data, ["split", "label"]).withColumn("target", F.col("label").cast("int"))
              for f, m in models.items()}
    return models, scored


@register("ml11_refit_evaluate")
def ml11_refit_evaluate(spark, sf):
    """Refit two families with their best parameters; evaluate them on train + test in one job (EV12)."""
    data, rows, reg, _, _ = _search(spark, sf, ("GBT", "XGB"))
    out = EV.evaluate_models(_refit_all(data, rows, reg)[1])
    return out.select("model", "split", "accuracy", "roc_auc", "f1", "log_loss")


@register("ml13_feature_importance")
def ml13_feature_importance(spark, sf):
    """Importances of a fitted classifier on the assembled features, by feature name."""
    data, model = prepared(spark, sf)
    gbt = ML.make_estimator("GBT", validation_col="is_val").fit(_fit_rows(data))
    return ML.feature_importance(gbt, unit_names(model))


@register("ml14_train_job")
def ml14_train_job(spark, sf):
    """Train job: prepare -> search -> refit -> evaluate -> pick (trainer gate) -> save the chosen
    unit, preprocessing and model, load it again and score the hold-out with it.  One row: the
    pick, how many rows the loaded unit scored and whether as the fitted one (none acceptable: no row).
    The target is a revenue limit, which the features can tell."""
    data, rows, reg, _, unit_model = _search(spark, sf, ("GBT", "XGB"), target=REVENUE)
    models, scored = _refit_all(data, rows, reg)
    param, gap, floor = TRAINER_GATE
    best = keep(SEL.best_model(EV.evaluate_models(scored), param, gap, floor), "pick")
    found = best.first()
    if found is None:
        return best.withColumns({"scored_rows": F.lit(0).cast("long"), "same_scores": F.lit(False)})
    path = scratch_path(spark, "model-unit")
    ML.save_unit(PipelineModel([*unit_model.stages, models[found["model"]]]), path)
    raw = stratified_split(labelled(spark, sf, REVENUE), "label", "k", 0.2, seed=1961).where(F.col("split") == "test")
    total = lambda d, n: d.agg(F.count(F.lit(1)).alias(f"{n}_rows"),
                               F.sum(F.round("prediction", 9).cast("decimal(20,9)")).alias(f"{n}_sum"))
    loaded = total(SCO.score(ML.load_unit(path), raw), "loaded").first()
    fitted = total(SCO.score(models[found["model"]], data.where(F.col("split") == "test")), "fitted").first()
    return best.withColumns({"scored_rows": F.lit(loaded["loaded_rows"]), "same_scores": F.lit(tuple(loaded) == tuple(fitted))})


@register("ml12_segment_least_squares", """
SELECT l_returnflag, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
  round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, count(*) AS rows FROM lineitem GROUP BY 1""")
def ml12_segment_least_squares(spark, sf):
    """One closed-form model per segment (price ~ quantity per return flag), one aggregation."""
    m = ML.segment_least_squares(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")
    return m.select("l_returnflag", F.round("intercept", 4).alias("intercept"), F.round("slope", 6).alias("slope"), "rows")


@register("ml12_segment_models")
def ml12_segment_models(spark, sf):
    """Segments by k-means on the assembled features with the k of the elbow (2..14), a classifier per
    segment fitted on all its rows of the train part, every row scored by the model of its segment."""
    data, unit_model = prepared(spark, sf)
    train = data.where(F.col("split") == "train")
    clusters, k, _ = fit_segments(train, "features", counted=counted_rows(unit_model, train))
    # every row once, a folder per segment: its fit and its scoring read no other rows
    clustered = keep(clusters.transform(data).select("k", "label", "split", "is_val", "features", "cluster"), "clustered", "cluster")
    models = ML.fit_per_segment(clustered.where(F.col("split") == "train"), "cluster", list(range(k)),
                                lambda: ML.make_estimator("GBT", validation_col="is_val"), FIT_ROWS)
    return SCO.route_models(clustered, "cluster", models, ["k", "label"])


_LDA_FEATURES = ("l_quantity", "l_discount", "l_tax")


@register("ml3_lda_statistics", f"""
SELECT (l_returnflag = 'R')::INT AS label, count(*) AS n,
  {", ".join(f"round(avg({f}), 6) AS mean_{f}" for f in _LDA_FEATURES)},
  {", ".join(f"round(count(*) * covar_pop({a}, {b}), 2) AS sxx_{i}_{j}" for i, a in enumerate(_LDA_FEATURES)
             for j, b in enumerate(_LDA_FEATURES) if j >= i)}
FROM lineitem GROUP BY 1""")
def ml3_lda_statistics(spark, sf):
    """Linear discriminant statistics: class means and cross-product sums (one aggregation)."""
    li = table(spark, sf, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    s = ML.lda_statistics(li, _LDA_FEATURES, "label")
    d = len(_LDA_FEATURES)
    return s.select("label", "n", *[F.round(F.col("means")[i], 6).alias(f"mean_{f}") for i, f in enumerate(_LDA_FEATURES)],
                    *[F.round(F.col("scatter")[i * d + j], 2).alias(f"sxx_{i}_{j}") for i in range(d) for j in range(i, d)])


@register("ml3_lda_search")
def ml3_lda_search(spark, sf):
    """The discriminant with and without shrinkage, 5-fold stratified CV AUC, on all rows."""
    li = labelled(spark, sf, REVENUE).withColumn("label", F.col("label").cast("int"))
    return ML.lda_search(keep(stratified_folds(li, "label", "k", k=5, seed=1), "folds"), _LDA_FEATURES)


@register("ml3_lda_score")
def ml3_lda_score(spark, sf):
    """Fit the discriminant (p x p solve on the driver) and score every row by a dot product."""
    li = table(spark, sf, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    fit = ML.lda_fit(ML.lda_statistics(li, _LDA_FEATURES, "label").collect(), _LDA_FEATURES)
    return ML.lda_score(li.select("l_orderkey", "l_linenumber", "label", *_LDA_FEATURES), _LDA_FEATURES, fit)


@register("sco1_score_batch")
def sco1_score_batch(spark, sf):
    """Score raw rows with a fitted unit: predicted class and P(class 1)."""
    d = split_labelled(spark, sf)
    stages = [*unit().getStages(), ML.make_estimator("GBT")]
    train = d.where(F.col("split") == "train")
    model = ML.fit_unit(stages, train)
    return SCO.score(model, d, ["k"])


@register("sco2_probability_metrics")
def sco2_probability_metrics(spark, sf):
    """P(class 1) of a fitted unit measured with EV1 per split."""
    d = split_labelled(spark, sf)
    stages = [*unit().getStages(), ML.make_estimator("GBT")]
    train = d.where(F.col("split") == "train")
    model = ML.fit_unit(stages, train)
    s = SCO.score(model, d, ["split", "label"]).withColumn("target", F.col("label").cast("int"))
    return EV.quality(s, ["split"])


def request_rules():
    return {"quantity_range": (F.col("l_quantity") > 1) & (F.col("l_quantity") < 50),
            "discount_below_0.1": F.col("l_discount") < 0.1}


@register("sco3_request_scoring")
def sco3_request_scoring(spark, sf):
    """Requests = lineitem rows: rule check, valid rows scored, invalid rows quarantined with reasons."""
    d = split_labelled(spark, sf)
    stages = [*unit().getStages(), ML.make_estimator("GBT")]
    train = d.where(F.col("split") == "train")
    model = ML.fit_unit(stages, train)
    scored, quarantine = SCO.score_requests(model, d, request_rules(), ["k"])
    return scored.select("k", "predicted", "prediction", F.lit(None).cast("string").alias("violations")).unionByName(
        quarantine.select("k", F.lit(None).cast("int").alias("predicted"), F.lit(None).cast("double").alias("prediction"),
                          "violations"))


@register("sco4_segment_routing", """
WITH w AS (SELECT l_returnflag, regr_intercept(l_extendedprice, l_quantity) AS intercept,
  regr_slope(l_extendedprice, l_quantity) AS w_l_quantity FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_returnflag, round(intercept + l_quantity * w_l_quantity, 4) AS prediction
FROM lineitem JOIN w USING (l_returnflag)""")
def sco4_segment_routing(spark, sf):
    """Each row scored by its segment's linear model (weights: one row per segment)."""
    li = table(spark, sf, "lineitem")
    w = ML.segment_least_squares(li, "l_returnflag", "l_quantity", "l_extendedprice").select(
        "l_returnflag", "intercept", F.col("slope").alias("w_l_quantity"))
    out = SCO.route_linear(li.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), "l_returnflag",
                           w, ["l_quantity"])
    return out.select("l_orderkey", "l_linenumber", "l_returnflag", F.round("prediction", 4).alias("prediction"))


@register("ml12_segment_linear_models")
def ml12_segment_linear_models(spark, sf):
    """Per-segment (return flag) least squares of price on quantity, discount and tax from
    aggregated cross products; each segment's small system is solved on its statistic row."""
    li = table(spark, sf, "lineitem")
    return ML.segment_linear_models(li, "l_returnflag", ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")


@register("sco4_segment_routing_multi")
def sco4_segment_routing_multi(spark, sf):
    """Route each line to its segment's multi-feature linear model (weights: one row per segment)."""
    li = table(spark, sf, "lineitem")
    feats = ["l_quantity", "l_discount", "l_tax"]
    w = ML.segment_linear_models(li, "l_returnflag", feats, "l_extendedprice").drop("rows")
    out = SCO.route_linear(li.select("l_orderkey", "l_linenumber", "l_returnflag", *feats), "l_returnflag", w, feats)
    return out.select("l_orderkey", "l_linenumber", "l_returnflag", F.round("prediction", 4).alias("prediction"))
