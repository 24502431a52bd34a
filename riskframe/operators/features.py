"""Feature pipeline (FE1-FE11): prepare, impute, one-hot dictionary + encode,
label encode, k-means segments and the elbow choice, wide <-> long.

Fitting only collects bounded artifacts to the driver (bin edges, category
counts per column, <= 14 clustering costs); transforms are native expressions or JVM
ML transformers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FeatureGroup
from ..functions.scalars import cap, clip, cut_index, label_of_index
from ..session import keep
from .clusters import kmeans_all, model_of, weighted_rows
from .keys import join_on
from .prefix import bucket_by_value, lay_out


def prepare_columns(groups: Sequence[FeatureGroup], labels: bool = False,
                    null_label: str | None = None) -> dict[str, Column]:
    """FE1 as a column map: clip each column; cut it when its group has bins."""
    out: dict[str, Column] = {}
    for g in groups:
        for c in g.columns:
            x = clip(c, g.lower_bound, g.upper_bound)
            if g.bins:
                x = cut_index(x, g.bins)
                if labels:
                    x = label_of_index(x, g.bins, null_label)
            out[c] = x
    return out


def prepare(df: DataFrame, groups: Sequence[FeatureGroup], labels: bool = False,
            null_label: str | None = None) -> DataFrame:
    """FE1: config-driven clip + right-closed cut, one projection."""
    return df.withColumns(prepare_columns(groups, labels, null_label))


def prepare_capped(df: DataFrame, caps: dict[str, float], bins: dict[str, Sequence[float]]) -> DataFrame:
    """FE2 (older prepare): cap ordinals at a ceiling, cut amounts without clipping."""
    cols = {c: cap(c, v) for c, v in caps.items()}
    cols.update({c: cut_index(c, e) for c, e in bins.items()})
    return df.withColumns(cols)


def fit_mean_imputer(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """FE3 fit: column means (as double, so integer columns do not truncate)."""
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


def impute(df: DataFrame, means: dict[str, float]) -> DataFrame:
    """FE3 transform: nulls -> fitted mean."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in means.items()})


# ---------------------------------------------------------------- one-hot
def category_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """FE4/FE5 fit: sorted distinct values per column with their feature index.

    One unpivot + distinct (a single shuffle of partially de-duplicated rows)
    for all columns.  Values are ordered numerically for numeric columns.
    Output: (column, value (string), value_num, local_index, feature_index, feature_name).
    """
    dtypes = dict(df.dtypes)
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("_pos"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value"),
                 (F.col(c).cast("double") if dtypes[c] != "string" else F.lit(None).cast("double")).alias("value_num"))
        for i, c in enumerate(columns)])).alias("s")).select("s.*")
    d = stacked.where(F.col("value").isNotNull()).distinct()
    # numbered in two phases: value-range buckets per column, then inside each bucket
    place = F.struct("value_num", "value")  # null numbers, those of text columns, are equal
    groups = ["_pos", "column"]
    d = keep(d.withColumn("_o", place), "categories")
    d, _ = bucket_by_value(d, groups)
    before = Window.partitionBy("_pos").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keep(d.groupBy(*groups, "_bk").agg(F.count(F.lit(1)).alias("_n")), "category-sizes")
    inside = sizes.select("_pos", "_bk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row per column: how many values the columns before it have
    per = {r["_pos"]: r["n"] for r in sizes.groupBy("_pos").agg(F.sum("_n").alias("n")).collect()}
    start = F.array(*[F.lit(sum(per.get(j, 0) for j in range(i))) for i in range(len(columns))])
    d = join_on(d, keep(inside, "category-offsets"), ["_pos", "_bk"])
    w = Window.partitionBy("_pos", "_bk").orderBy("value_num", "value")
    local = F.col("_before") + F.row_number().over(w) - 1
    return d.select("_pos", "column", "value", "value_num", local.alias("local_index"),
                    (F.get(start, F.col("_pos")) + local).alias("feature_index"),
                    F.concat_ws("_", "column", "value").alias("feature_name"))


class OneHotModel:
    """FE4 fitted encoder: per column value -> local index, unseen/null -> all zeros.

    The dictionary is a written table in the shared folder with one row per (column, value).
    Encoding joins it column by column (Spark broadcasts a column's part only if it is
    small), so it may have any number of categories; the JVM ``OneHotEncoder`` then makes
    sparse vectors.  Only the number of values per column is on the driver.
    """

    def __init__(self, columns: Sequence[str], dictionary: DataFrame, sizes: dict[str, int]):
        self.columns = list(columns)
        self.dictionary = dictionary
        self.sizes = sizes

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> "OneHotModel":
        dd = keep(category_dictionary(df, columns), "one-hot")
        found = {r["column"]: r["n"] for r in dd.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        return cls(columns, dd, {c: found.get(c, 0) for c in columns})

    def feature_names(self) -> list[str]:
        """FE5: ``COL_value`` names in feature order (on the driver: one per feature)."""
        return [r[0] for r in self.dictionary.orderBy("feature_index").select("feature_name").collect()]

    def indexed(self, df: DataFrame) -> DataFrame:
        """``df`` with ``<column>__idx``: the local index, or the number of values if unseen or null."""
        for c in self.columns:
            known = self.dictionary.where(F.col("column") == c).select(
                F.col("value").alias("__value"), F.col("local_index").cast("double").alias(f"{c}__idx"))
            df = df.join(known, F.col(c).cast("string") == F.col("__value"), "left").drop("__value")
        return df.withColumns({f"{c}__idx": F.coalesce(f"{c}__idx", F.lit(float(self.sizes[c]))) for c in self.columns})

    def encoder(self, output_suffix: str = "__vec") -> Transformer:
        """JVM one-hot over the local indices; the extra last slot (unseen) is dropped."""
        spark = _active()
        fit_df = spark.range(1).select(*[F.lit(float(self.sizes[c])).alias(f"{c}__idx") for c in self.columns])
        enc = OneHotEncoder(inputCols=[f"{c}__idx" for c in self.columns],
                            outputCols=[f"{c}{output_suffix}" for c in self.columns], dropLast=True)
        return enc.fit(fit_df)

    def transform(self, df: DataFrame, output_col: str = "features") -> DataFrame:
        enc = self.encoder().transform(self.indexed(df))
        asm = VectorAssembler(inputCols=[f"{c}__vec" for c in self.columns], outputCol=output_col)
        out = asm.transform(enc)
        return out.drop(*[f"{c}__idx" for c in self.columns], *[f"{c}__vec" for c in self.columns])

    def active_features(self, df: DataFrame, key: str) -> DataFrame:
        """Long form of the encoding: (key, feature_index, feature_name) per set bit."""
        cells = df.select(key, F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in self.columns])).alias("s"))
        names = self.dictionary.select("column", "value", "feature_index", "feature_name")
        return cells.select(key, "s.*").join(names, ["column", "value"]).select(key, "feature_index", "feature_name")


def _active():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


def label_encode(df: DataFrame, c: str, name: str | None = None, buckets: int | None = None) -> DataFrame:
    """FE9: sorted distinct categories -> 0..n-1, joined back.

    The numbering is two-phase like the running sums: distinct values are cut into ordered
    value-range buckets (quantiles, for text of sampled values), bucket sizes
    give each bucket its offset through a window over the buckets only, and values are numbered
    inside their bucket - no global window over all values.
    """
    name = name or f"{c}_code"
    d, groups = lay_out(df.select(c).where(F.col(c).isNotNull()).distinct(), [], c, buckets, 10000)
    sizes = d.groupBy(*groups, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offs = keep(sizes.select("_bk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")), "offsets")
    d = join_on(d, offs, ["_bk"])
    d = d.select(c, (F.col("_off") + F.row_number().over(Window.partitionBy("_bk").orderBy(c)) - 1).alias(name))
    return df.join(d, c, "left")


def wide_to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str],
                 var_name: str = "measure", value_name: str = "value") -> DataFrame:
    """FE11: wide six-month block -> long rows (map-only unpivot)."""
    return df.unpivot(list(ids), list(columns), var_name, value_name)


def long_to_wide(df: DataFrame, ids: Sequence[str], var: str, value: str, values: Sequence,
                 agg: str = "sum") -> DataFrame:
    """FE11: long rows -> wide block with a fixed list of columns (no distinct job)."""
    return df.groupBy(*ids).pivot(var, list(values)).agg(getattr(F, agg)(value))


# ---------------------------------------------------------------- clustering
def knee(points: Sequence[tuple[int, float]]) -> int:
    """FE7: knee of a decreasing convex curve (largest gap below the chord after normalising)."""
    if len(points) < 3:
        return points[0][0]
    xs = [p[0] for p in points]
    ys = [p[1] for p in points]
    x0, x1, y0, y1 = min(xs), max(xs), min(ys), max(ys)
    if y1 == y0:
        return xs[0]
    best, best_k = None, xs[0]
    for x, y in points:
        xn = (x - x0) / (x1 - x0)
        yn = (y - y0) / (y1 - y0)
        gap = (1 - xn) - yn  # distance below the chord from (0,1) to (1,0)
        if best is None or gap > best:
            best, best_k = gap, x
    return best_k


def fit_segments(df: DataFrame, features: str, k: int | None = None, ks: Sequence[int] = range(2, 15),
                 seed: int = 42, max_iter: int = 300, counted: DataFrame | None = None):
    """FE6/FE7: k-means with the given k, or with the k of the elbow: all of ``ks`` in the same scans
    (``clusters``), and Spark's model of the chosen one's centres.  ``counted``: (features, weight), the rows
    of ``df`` with their number, if known.  Returns (model, k, costs)."""
    if k is not None:
        model = KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster",
                       maxIter=max_iter, initMode="k-means||").fit(df)
        return model, k, None
    rows = weighted_rows(df, features) if counted is None else weighted_rows(counted, features, "weight")
    found = kmeans_all(rows, list(ks), seed, max_iter)
    costs = [(k, found[k][1]) for k in ks]
    k = knee(costs)
    return model_of(df.sparkSession, found[k][0], features, "cluster"), k, costs


def nearest_center(vec, centers: Sequence[Sequence[float]]) -> Column:
    """FE8 with given centers: index of the closest center by squared distance (native)."""
    cs = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centers])
    dists = F.transform(cs, lambda c: F.aggregate(
        F.zip_with(c, vec, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x))
    best = F.array_min(F.transform(dists, lambda d, i: F.struct(d.alias("d"), i.alias("i"))))
    return best["i"]


def _num(v) -> str:
    fv = float(v)
    return str(int(fv)) if fv.is_integer() else repr(fv)


#: added to the names of prepared columns
PREPARED = "_p"


def prepare_sql(groups: Sequence[FeatureGroup], suffix: str = PREPARED) -> str:
    """FE1 as SQL text for an ``SQLTransformer`` stage: clip, then right-closed cut (bin index)."""
    exprs = []
    for g in groups:
        for c in g.columns:
            x = f"`{c}`"
            if g.lower_bound is not None:
                x = f"greatest({x}, {_num(g.lower_bound)})"
            if g.upper_bound is not None:
                x = f"least({x}, {_num(g.upper_bound)})"
            x = f"CASE WHEN `{c}` IS NOT NULL THEN {x} END"
            if g.bins:
                e = g.bins
                whens = " ".join(f"WHEN {x} <= {_num(e[i])} THEN {i - 1}" for i in range(1, len(e)))
                x = f"CASE WHEN {x} > {_num(e[0])} AND {x} <= {_num(e[-1])} THEN CASE {whens} END END"
            exprs.append(f"{x} AS `{c}{suffix}`")
    return "SELECT *, " + ", ".join(exprs) + " FROM __THIS__"


def feature_unit(groups: Sequence[FeatureGroup], categorical: Sequence[str] = (), extra: Sequence[str] = (),
                 output: str = "features") -> Pipeline:
    """FE10: prepare (SQL) + one-hot of every prepared and categorical column (``CategoryEncoder``:
    unseen / missing -> all zeros) + assembly, as one saveable ``Pipeline``."""
    from .encoder import CategoryEncoder
    columns = [*[f"{c}{PREPARED}" for g in groups for c in g.columns], *categorical]
    return Pipeline(stages=[SQLTransformer(statement=prepare_sql(groups)), CategoryEncoder(columns, "encoded"),
                            VectorAssembler(inputCols=["encoded", *extra], outputCol=output, handleInvalid="keep")])


def unit_names(model: PipelineModel) -> list[str]:
    """FE5 names (COL_value) of the features a fitted unit assembles, in order."""
    from .encoder import CategoryEncoderModel
    encoder = next(s for s in model.stages if isinstance(s, CategoryEncoderModel))
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    plain = {c: c.removesuffix(PREPARED) for c in encoder.getInputCols()}
    return [*encoder.names(plain), *assembler.getInputCols()[1:]]


def fit_feature_unit(unit: Pipeline, train: DataFrame, ks: Sequence[int] = range(2, 15)) -> PipelineModel:
    """FE10 with its clusters: the fitted unit followed by k-means with the k of the elbow, all
    fitted on the whole of ``train``, as one saveable model that appends ``cluster``."""
    model = unit.fit(train)
    rows = model.transform(train)
    clusters, _, _ = fit_segments(rows, "features", ks=ks, counted=counted_rows(model, rows))
    return PipelineModel([*model.stages, clusters])


def counted_rows(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """(features, weight) of all ``rows`` that a fitted unit made, those that are equal in what it encodes and
    assembles counted first, so that vectors are made once for them."""
    _, encoder, assembler = model.stages
    inputs = list(dict.fromkeys([*encoder.getInputCols(), *assembler.getInputCols()[1:]]))
    counted = rows.groupBy(*inputs).agg(F.count(F.lit(1)).alias("weight"))
    return PipelineModel([encoder, assembler]).transform(counted).select(assembler.getOutputCol(), "weight")


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
