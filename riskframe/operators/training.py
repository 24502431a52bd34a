"""Training, tuning and the keep-best parameter registry (ML1-ML14, SNK5, SNK6).

Tree families run on Spark ML (distributed tree induction); the search is a
seeded random sample of each family's space evaluated by ``CrossValidator``
on a stratified fold column (SPL3), so folds are the same rows on every run.
Gradient-boosting variants of other libraries are re-aimed onto
``GBTClassifier`` with the nearest parameters; options without an
equivalent (L1/L2 penalties, leaf-count caps, loss choice) are dropped.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import keep
from .gram import Moments, cross_moments


@dataclass(frozen=True)
class Param:
    kind: str          # "int", "float", "logfloat", "step", "choice"
    low: float | None = None
    high: float | None = None
    choices: tuple = ()
    step: float | None = None


# The tuned ranges of the original families under their Spark ML names.  Options
# without an equivalent (L1/L2 penalties, leaf-count caps, loss and tree-growth kinds) have no entry.
GBT_SPACE = {
    "stepSize": Param("logfloat", 1e-4, 1e-1), "maxIter": Param("int", 100, 1000),
    "maxDepth": Param("int", 3, 10), "subsamplingRate": Param("float", 0.1, 1.0),
    "minInstancesPerNode": Param("int", 1, 10), "minWeightFractionPerNode": Param("float", 0.0, 0.4999),
    "minInfoGain": Param("float", 0.0, 0.5), "featureSubsetStrategy": Param("choice", choices=("sqrt", "log2")),
}
RF_SPACE = {
    "impurity": Param("choice", choices=("gini", "entropy")), "maxDepth": Param("int", 3, 10),
    "numTrees": Param("int", 100, 1000), "bootstrap": Param("choice", choices=(True, False)),
    "featureSubsetStrategy": Param("choice", choices=("sqrt",)), "minInstancesPerNode": Param("int", 1, 10),
}
LGBM_SPACE = {  # leaf minimum, gain to split, bagging and feature fractions
    "stepSize": Param("logfloat", 1e-4, 1e-1), "maxIter": Param("int", 100, 1000), "maxDepth": Param("int", 3, 10),
    "minInstancesPerNode": Param("int", 1, 10), "minInfoGain": Param("step", 0.0, 100.0, step=5.0),
    "subsamplingRate": Param("step", 0.2, 0.95, step=0.1), "featureSubsetStrategy": Param("step", 0.2, 0.95, step=0.1),
}
XGB_SPACE = {  # child weight, gamma, row and column subsampling
    "stepSize": Param("logfloat", 1e-4, 1e-1), "maxIter": Param("int", 100, 1000), "maxDepth": Param("int", 3, 10),
    "minInstancesPerNode": Param("int", 1, 10), "minInfoGain": Param("logfloat", 1e-8, 1.0),
    "subsamplingRate": Param("logfloat", 0.5, 1.0), "featureSubsetStrategy": Param("logfloat", 0.5, 1.0),
}
CATBOOST_SPACE = {  # column share per level, depth, Bernoulli subsample; 1000 rounds at the default rate
    "maxDepth": Param("int", 3, 12), "featureSubsetStrategy": Param("logfloat", 0.01, 1.0),
    "subsamplingRate": Param("logfloat", 0.01, 1.0), "stepSize": Param("choice", choices=(0.03,)),
    "maxIter": Param("choice", choices=(1000,)),
}

#: rows that a task of a fit has at least, and about as many as a file of them has at most (see ``written_rows``)
FIT_ROWS, FIT_FILE_ROWS = 20_000, 200_000
#: boosting stops when the loss of the validation rows improves by less than this share
VALIDATION_TOL = 0.01


def fit_sample(train: DataFrame, key: str, rows: int, n: int | None = None) -> DataFrame:
    """At most about ``rows`` rows picked by a hash of ``key`` (the same on every run), for callers that ask for a
    sample; the queries fit on all rows (``written_rows``).  ``n``: rows of ``train``, if known."""
    n = train.count() if n is None else n
    share = min(1.0, rows / max(n, 1))
    return train if share == 1.0 else train.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 20)) < share * (1 << 20))


def written_rows(rows: DataFrame, n: int, order: Sequence = (), least: int | None = None) -> DataFrame:
    """All ``n`` rows that a classifier is fitted on, written once.  Every step of a fit is a job on them, so their
    number of files, and with it of tasks, follows the rows, not the source: a file for each ``least`` rows while
    there are cores for them, and not many more than ``FIT_FILE_ROWS`` in any.  ``order``: of the rows of a file."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    files = max(1, min(n // (least or FIT_ROWS), 2 * cores), n // FIT_FILE_ROWS)
    dealt = rows.repartition(files)
    return keep(dealt.sortWithinPartitions(*order) if order else dealt, "fit-rows")


def sample_params(space: Mapping[str, Param], n: int, seed: int) -> list[dict]:
    """Seeded random search: ``n`` parameter dicts drawn from ``space`` (driver-side, n small)."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        d = {}
        for k, p in space.items():
            if p.kind == "int":
                d[k] = rng.randint(int(p.low), int(p.high))
            elif p.kind == "float":
                d[k] = rng.uniform(p.low, p.high)
            elif p.kind == "logfloat":
                d[k] = min(p.high, max(p.low, math.exp(rng.uniform(math.log(p.low), math.log(p.high)))))
            elif p.kind == "step":
                d[k] = round(p.low + p.step * rng.randint(0, int((p.high - p.low) / p.step + 1e-9)), 10)
            else:
                d[k] = rng.choice(p.choices)
            if k == "featureSubsetStrategy":  # a share of the columns is text to Spark
                d[k] = str(d[k])
        out.append(d)
    return out


def make_estimator(family: str, features: str = "features", label: str = "label",
                   validation_col: str | None = None, seed: int = 1961) -> Estimator:
    """Family -> Spark estimator (factory dict instead of reflection).  Boosting families stop
    early on the rows that ``validation_col`` marks, if it is given."""
    if family in ("GBT", "LGBM", "XGB", "CATBOOST"):
        if family == "CATBOOST" and not validation_col:
            raise ValueError("the early-stopping variant needs a validation indicator column")
        est = GBTClassifier(featuresCol=features, labelCol=label, seed=seed, validationTol=VALIDATION_TOL)
        return est.setValidationIndicatorCol(validation_col) if validation_col else est
    if family == "RF":
        return RandomForestClassifier(featuresCol=features, labelCol=label, seed=seed)
    raise ValueError(f"unknown model family {family}")


SPACES = {"GBT": GBT_SPACE, "RF": RF_SPACE, "LGBM": LGBM_SPACE, "XGB": XGB_SPACE, "CATBOOST": CATBOOST_SPACE}


def _param_maps(est: Estimator, params: Sequence[dict]):
    return [{est.getParam(k): v for k, v in d.items()} for d in params]


def cross_validate(est: Estimator, params: Sequence[dict], train: DataFrame, fold_col: str = "fold",
                   label: str = "label", parallelism: int = 4, folds: int = 5):
    """ML7: mean ROC AUC over the ``folds`` folds of ``fold_col`` (ids 0..folds-1) per parameter dict."""
    ev = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")
    cv = CrossValidator(estimator=est, estimatorParamMaps=_param_maps(est, params), evaluator=ev,
                        foldCol=fold_col, numFolds=folds, parallelism=parallelism)
    return cv.fit(train)


def fold_scores(est: Estimator, params: Mapping, train: DataFrame, fold_col: str = "fold", label: str = "label",
                folds: int = 5) -> DataFrame:
    """ML7: ROC AUC of each fold (fitted on the other folds) for one parameter dict."""
    ev = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")
    one = {est.getParam(k): v for k, v in params.items()}
    rows = []
    for i in range(folds):
        model = est.copy(one).fit(train.where(F.col(fold_col) != i))
        rows.append((i, float(ev.evaluate(model.transform(train.where(F.col(fold_col) == i))))))
    return train.sparkSession.createDataFrame(rows, "fold int, roc_auc double")


def trial_log(family: str, params: Sequence[dict], cv_model) -> DataFrame:
    """SNK5: one row per trial: family, trial number, parameters (map), mean CV AUC."""
    spark = SparkSession.getActiveSession()
    rows = [(family, i, {k: str(v) for k, v in p.items()}, float(m))
            for i, (p, m) in enumerate(zip(params, cv_model.avgMetrics))]
    return spark.createDataFrame(rows, "family string, trial int, params map<string,string>, score double")


def search(train: DataFrame, families: Sequence[str], n_trials: int, spaces: Mapping[str, Mapping] | None = None,
           seed: int = 1961, fold_col: str = "fold", features: str = "features", label: str = "label",
           parallelism: int = 4) -> tuple[DataFrame, DataFrame]:
    """ML8/ML9: for each family in order, sample ``n_trials`` parameter sets, cross-validate,
    keep the best.  Returns (registry rows, trial log).  ``train`` should be persisted."""
    spaces = dict(spaces or SPACES)
    best_rows, logs = [], None
    for i, fam in enumerate(families):
        params = sample_params(spaces[fam], n_trials, seed + i)
        est = make_estimator(fam, features, label, validation_col="is_val")
        cvm = cross_validate(est, params, train, fold_col, label, parallelism)
        log = trial_log(fam, params, cvm)
        logs = log if logs is None else logs.unionByName(log)
        scores = np.array(cvm.avgMetrics, float)
        j = int(np.argmax(np.where(np.isnan(scores), -np.inf, scores)))  # a trial without a score never wins
        best_rows.append((fam, type(est).__name__, {k: str(v) for k, v in params[j].items()},
                          float(cvm.avgMetrics[j]), i))
    spark = train.sparkSession
    reg = spark.createDataFrame(best_rows, "family string, model_class string, params map<string,string>, "
                                           "score double, seq int")
    return reg, logs


def _typed(est: Estimator, params: Mapping[str, str]) -> dict:
    out = {}
    for k, v in params.items():
        cur = est.getOrDefault(est.getParam(k)) if est.hasDefault(k) or est.isSet(k) else None
        if isinstance(cur, bool):
            out[k] = v in ("True", "true", True)
        elif isinstance(cur, int):
            out[k] = int(float(v))
        elif isinstance(cur, float):
            out[k] = float(v)
        else:
            out[k] = v
    return out


def refit(family: str, params: Mapping[str, str], train: DataFrame, features: str = "features",
          label: str = "label", validation_col: str | None = "is_val"):
    """ML11: fit one family with its registry parameters."""
    est = make_estimator(family, features, label, validation_col)
    return est.copy({est.getParam(k): v for k, v in _typed(est, params).items()}).fit(train)


def feature_importance(model, names: Sequence[str]) -> DataFrame:
    """ML13: importance per feature name, sorted descending."""
    spark = SparkSession.getActiveSession()
    imp = model.featureImportances.toArray()
    rows = [(names[i], float(imp[i])) for i in range(len(names))]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def save_unit(model: PipelineModel, path: str) -> None:
    """SNK6: preprocessing + model saved as one unit."""
    model.write().overwrite().save(path)


def load_unit(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def fit_unit(stages: Sequence, train: DataFrame, classifier_rows: DataFrame | None = None) -> PipelineModel:
    """The stages fitted as one unit, the classifier at the end on the rows that the others prepared of all
    ``train`` (or of ``classifier_rows``, if a caller asks for others).  They are prepared and written once: a fit
    reads its rows many times and would scan ``train`` for them each time."""
    *prepare, classifier = stages
    prepared = Pipeline(stages=prepare).fit(train)
    rows = train if classifier_rows is None else classifier_rows
    written = written_rows(prepared.transform(rows), rows.count())
    return PipelineModel([*prepared.stages, classifier.fit(written)])


# ----------------------------------------------------------------- per-segment models
def segment_least_squares(df: DataFrame, segment: str, x: str, y: str) -> DataFrame:
    """ML12 (closed form): y = a + b x per segment with regr_slope/regr_intercept - one aggregation."""
    return df.groupBy(segment).agg(F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"),
                                   F.count(F.lit(1)).alias("rows"))


def segment_linear_models(df: DataFrame, segment: str, features: Sequence[str], label: str,
                          ridge: float = 0.0) -> DataFrame:
    """ML12 (many segments, several features): least squares per segment from sufficient
    statistics: one matrix of centred cross products per segment (``gram``, folded map-side, so a
    segment holding a third of the rows is a matrix per task), then the systems of a
    batch of segments are solved together - no group of raw rows is ever gathered into one
    task.  Output: segment, intercept, w_<f>, rows.
    """
    columns = [*features, label]
    p = len(features)
    seg_type = dict(df.dtypes)[segment]
    out_schema = f"`{segment}` {seg_type}, intercept double, " + ", ".join([*[f"`w_{f}` double" for f in features], "rows bigint"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All segments of a batch in one stacked solve."""
        for b in batches:
            square = lambda c: b.column(c).flatten().to_numpy().reshape(-1, p + 1, p + 1)  # noqa: B023, E731
            cov, mean, n = square("cov"), square("mean")[:, :, 0], square("n")[:, 0, 0]
            left = cov[:, :p, :p] + ridge * np.eye(p)
            w = (np.linalg.pinv(left, hermitian=True) @ cov[:, :p, p:])[:, :, 0]
            first = mean[:, p] - (w * mean[:, :p]).sum(1)  # the products are centred
            yield pa.RecordBatch.from_arrays([b.column("by"), pa.array(first), *[pa.array(c) for c in w.T], pa.array(n.astype(np.int64))],
                                             [segment, "intercept", *[f"w_{f}" for f in features], "rows"])

    return cross_moments(df, columns, segment, complete=True).mapInArrow(solve, out_schema)


def fit_per_segment(df: DataFrame, segment: str, segments: Sequence, make, least: int | None = None) -> dict:
    """ML12 (few segments): filter + fit one Spark model per segment on all its rows (``written_rows``)."""
    models = {}
    for s in segments:
        rows = df.where(F.col(segment) == F.lit(s))
        models[s] = make().fit(written_rows(rows, rows.count(), least=least))
    return models


# ----------------------------------------------------------------- linear discriminant
def lda_statistics(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """ML3 statistics: per class the count ``n``, the ``means`` (array) and the within-class ``scatter`` (d x d
    centred products, row after row) of the rows in which all features are known; one matrix per
    class whatever the number of features."""
    d = len(features)
    first = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.get("mean", i * d))
    return cross_moments(df, features, label, complete=True).select(
        F.col("by").alias(label), F.col("n")[0].cast("long").alias("n"), first.alias("means"), F.col("cov").alias("scatter"))


#: columns up to which a sum over them is written out (compiled by Spark; a fold over an array is not)
WRITTEN_OUT = 16


def _summed(features: Sequence[str], numbers: Sequence[tuple], term):
    """Sum over the columns of ``term(column, *numbers)``, each column with its numbers (literals)."""
    values = [F.col(f).cast("double") for f in features]
    literals = [[F.lit(float(n)) for n in some] for some in numbers]
    if len(features) <= WRITTEN_OUT:
        return sum((term(v, *some) for v, some in zip(values, literals, strict=True)), F.lit(0.0))
    packed = F.arrays_zip(F.array(*values).alias("v"), *[F.array(*some).alias(f"n{i}") for i, some in enumerate(zip(*literals, strict=True))])
    return F.aggregate(packed, F.lit(0.0), lambda total, e: total + term(e["v"], *[e[f"n{i}"] for i in range(len(numbers[0]))]))


def _size4(features: Sequence[str], stats_rows, label: str):
    """|z|^4 of a row standardised with its class's mean and deviations (literals); null for other classes."""
    terms = F.lit(None).cast("double")
    for r in stats_rows:
        size = _summed(features, list(zip(r["means"], _deviations(r, len(features)), strict=True)),
                       lambda v, m, s: ((v - m) / s) * ((v - m) / s))
        terms = F.when(F.col(label) == r[label], size * size).otherwise(terms)
    return terms


def _complete(df: DataFrame, features: Sequence[str]) -> DataFrame:
    for f in features:
        df = df.where(F.col(f).isNotNull())
    return df


def lda_fourth_moments(df: DataFrame, features: Sequence[str], stats_rows, label: str = "label") -> dict:
    """Per class the mean of |z|^4 over its standardised rows z (a second pass, with the class
    means and deviations as literals): what the Ledoit-Wolf intensity needs besides
    the covariance."""
    found = _complete(df, features).groupBy(label).agg(F.avg(_size4(features, stats_rows, label)).alias("m4"))
    return {int(r[label]): r["m4"] for r in found.collect() if r[label] is not None}


def _other_folds(df: DataFrame, features: Sequence[str], label: str, fold_col: str, folds: int) -> list[list[dict]]:
    """``lda_statistics`` of all folds but one, for each fold, from one scan: a matrix per (class, fold), merged here."""
    d, by = len(features), F.col(label).cast("int") * folds + F.col(fold_col)
    cells: dict = {}
    for r in cross_moments(df.where(F.col(label).isNotNull()).withColumn("_by", by), features, "_by", complete=True).collect():
        square = lambda c: np.array(r[c]).reshape(d, d)  # noqa: B023, E731
        cells[divmod(r["by"], folds)] = [square(c) for c in ("n", "mean", "var", "cov")]
    out = []
    for i in range(folds):
        merged: dict = {}
        for (k, fold), parts in sorted(cells.items()):
            if fold != i:
                merged.setdefault(k, Moments(*[np.zeros((d, d)) for _ in parts])).add(Moments(*parts))
        out.append([{label: k, "n": int(m.n[0, 0]), "means": m.mean[:, 0].tolist(), "scatter": m.cov.ravel().tolist()}
                    for k, m in merged.items()])
    return out


def _scatter(r, p: int) -> np.ndarray:
    return np.array(r["scatter"]).reshape(p, p)


def _deviations(r, p: int) -> np.ndarray:
    """Standard deviations of a class; 1 for a constant feature."""
    v = np.diag(_scatter(r, p)) / r["n"]
    return np.sqrt(np.where(v > 0, v, 1.0))


def _shrunk(r, p: int, m4: float) -> np.ndarray:
    """Ledoit-Wolf covariance of one class: shrunk on the standardised scale, then scaled back."""
    sd = _deviations(r, p)
    C = _scatter(r, p) / r["n"] / np.outer(sd, sd)
    mu = np.trace(C) / p
    spread = ((C - mu * np.eye(p)) ** 2).sum()
    noise = (m4 - (C ** 2).sum()) / r["n"]
    share = 1.0 if spread == 0 else min(max(noise, 0.0), spread) / spread
    return ((1 - share) * C + share * mu * np.eye(p)) * np.outer(sd, sd)


def lda_fit(stats_rows, features: Sequence[str], label: str = "label", fourth: Mapping | None = None) -> dict:
    """ML3 solve (driver, p x p): w = S^-1 (m1 - m0), c = w.(m0 + m1)/2 - ln(n1/n0).

    S is the pooled within-class covariance; with the fourth moments given, the mean of the
    classes' Ledoit-Wolf covariances weighted by class size (shrinkage "auto")."""
    p = len(features)
    rows = {int(r[label]): r for r in stats_rows}
    n = sum(r["n"] for r in rows.values())
    means = {k: np.array(r["means"]) for k, r in rows.items()}
    if fourth is None:
        S = sum(_scatter(r, p) for r in rows.values()) / max(n - len(rows), 1)
    else:
        S = sum(r["n"] / n * _shrunk(r, p, fourth[k]) for k, r in rows.items())
    w = np.linalg.solve(S + 1e-9 * np.eye(p), means[1] - means[0])
    c = float(w @ (means[0] + means[1]) / 2 - math.log(rows[1]["n"] / rows[0]["n"]))
    return {"weights": [float(v) for v in w], "offset": c}


#: the discriminant's choices; the solvers of the original agree on the result, so they are one here
LDA_CHOICES = ({"shrinkage": "none"}, {"shrinkage": "auto"})


def lda_search(df: DataFrame, features: Sequence[str], label: str = "label", fold_col: str = "fold",
               folds: int = 5) -> DataFrame:
    """ML3 in the search: mean cross-validated ROC AUC of every choice.  Three scans for all folds: the statistics
    per (class, fold), the fourth moments, and the scores of each row by the fits without its fold."""
    from .metrics import roc_auc
    stats = _other_folds(df, features, label, fold_col, folds)
    others = [F.when(F.col(fold_col) != i, _size4(features, s, label)) for i, s in enumerate(stats)]
    m4 = _complete(df, features).groupBy(label).agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(others)]).collect()
    fits = {}
    for i, s in enumerate(stats):
        fourth = {int(r[label]): r[f"m{i}"] for r in m4 if r[label] is not None}
        fits[i] = [lda_fit(s, features, label, fourth if choice["shrinkage"] == "auto" else None) for choice in LDA_CHOICES]
    scores = F.array(*[F.struct(F.lit(choice["shrinkage"]).alias("shrinkage"),
                                F.coalesce(*[F.when(F.col(fold_col) == i, _lda_probability(features, f[j])) for i, f in fits.items()]).alias("prediction"))
                       for j, choice in enumerate(LDA_CHOICES)])
    scored = df.select(F.lit("LDA").alias("family"), F.col(fold_col).alias("fold"), F.col(label).cast("int").alias("target"),
                       F.explode(scores).alias("s")).select("family", "s.shrinkage", "fold", "target", "s.prediction")
    per_fold = roc_auc(scored, ["family", "shrinkage", "fold"])
    return per_fold.groupBy("family", "shrinkage").agg(F.avg("roc_auc").alias("score"))


def _lda_probability(features: Sequence[str], fit: Mapping):
    z = _summed(features, [(w,) for w in fit["weights"]], lambda v, w: v * w) - F.lit(fit["offset"])
    return 1 / (1 + F.exp(-z))


def lda_score(df: DataFrame, features: Sequence[str], fit: Mapping) -> DataFrame:
    """ML3 scoring: P(1) = sigmoid(w.x - c), a native dot product."""
    return df.withColumn("prediction", _lda_probability(features, fit))
