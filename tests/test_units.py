"""The encoder stage (values apart, saved, loaded, unseen) and k-means for all k at once."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskframe.config import FeatureGroup
from riskframe.operators import clusters as C
from riskframe.operators import features as FE
from riskframe.operators.encoder import CategoryEncoder, CategoryEncoderModel


def bits(df):
    return [tuple(i for i, v in enumerate(r[0]) if v) for r in df.select(vector_to_array("features")).collect()]


def test_numbers_stay_apart_and_survive_saving(spark, tmp_path):
    values = [0.25, 0.75, 1.5, 1.9, -3.0, -0.0, 0.0, 123456789012.0, 123456789013.0, 1e300, float("nan"), None, 0.25]
    df = spark.createDataFrame([(v, "x" if v and v > 1 else "y") for v in values], "a double, c string")
    unit = FE.feature_unit((FeatureGroup("g", ("a",), None, None, None),), categorical=["c"]).fit(df)
    unit.write().overwrite().save(str(tmp_path / "unit"))
    loaded = PipelineModel.load(str(tmp_path / "unit"))
    names = ["a_-3", "a_0", "a_0.25", "a_0.75", "a_1.5", "a_1.9", "a_123456789012", "a_123456789013", "a_1.0E300", "a_NaN", "c_x", "c_y"]
    assert FE.unit_names(unit) == FE.unit_names(loaded) == names
    for model in (unit, loaded):
        found = bits(model.transform(df.coalesce(1)))
        assert sorted(found) == sorted([(2, 11), (3, 11), (4, 10), (5, 10), (0, 11), (1, 11), (1, 11), (6, 10), (7, 10), (8, 10), (9, 11), (11,), (2, 11)])
        new = spark.createDataFrame([(0.2500001, "z"), (0.25, None)], "a double, c string")
        assert sorted(bits(model.transform(new))) == [(), (2,)]
        assert model.transform(df.limit(0)).count() == 0


def test_dictionary_is_a_table(spark, tmp_path, monkeypatch):
    """Many categories: no list of them on the driver when fitting, encoding, saving or loading."""
    df = spark.range(30_000).select((F.col("id") / 7).alias("v"), F.concat(F.lit("k"), F.col("id") % 20_000).alias("t"))
    model = CategoryEncoder(["v", "t"], "features").fit(df)
    model.write().save(str(tmp_path / "encoder"))
    loaded = CategoryEncoderModel.load(str(tmp_path / "encoder"))
    assert loaded.onehot.sizes == {"v": 30_000, "t": 20_000} and loaded.dictionary().count() == 50_000
    out = loaded.transform(df.where("id % 1000 = 3" if "id" in df.columns else "t like 'k1999%'"))
    rows = out.select("features").collect()
    assert len(rows) > 0 and all(r.features.size == 50_000 and r.features.numNonzeros() == 2 for r in rows)


def plain_lloyd(x, w, centres, tol=1e-4):
    for _ in range(300):
        near = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        new = np.array([np.average(x[near == i], axis=0, weights=w[near == i]) if (near == i).any() else c for i, c in enumerate(centres)])
        shift, centres = ((new - centres) ** 2).sum(1).max(), new
        if shift <= tol * tol:
            break
    return centres, (w * ((x[:, None] - centres) ** 2).sum(2).min(1)).sum()


@pytest.mark.parametrize("cells", [0, C.LOCAL_CELLS])
def test_all_k_in_one_scan_equal_single_runs(spark, monkeypatch, cells):
    monkeypatch.setattr(C, "LOCAL_CELLS", cells)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.5, (150, 3)) for c in ([0, 0, 0], [4, 0, 0], [0, 5, 0], [1e3, 1e3, 1e3])])
    x = np.concatenate([x, x[:100], x[:100]])  # equal rows
    df = spark.createDataFrame([(r.tolist(),) for r in x], "a array<double>").select(array_to_vector("a").alias("features")).repartition(5)
    rows = C.weighted_rows(df, "features")
    assert rows.count() == 600 and rows.agg(F.sum("w")).first()[0] == 800
    starts = {k: x[rng.choice(600, k, replace=False)] for k in range(2, 9)}
    both = C.lloyd(rows, starts)
    for k, start in starts.items():
        centres, cost = plain_lloyd(x, np.ones(len(x)), start)
        assert both[k][0] == pytest.approx(centres, abs=1e-9) and both[k][1] == pytest.approx(cost, rel=1e-9)


def test_starts_find_planted_groups_and_the_model_keeps_the_centres(spark, tmp_path):
    rng = np.random.default_rng(1)
    true = rng.uniform(-50, 50, (6, 4))
    x = np.concatenate([c + rng.normal(0, 0.1, (80, 4)) for c in true])
    df = spark.createDataFrame([(r.tolist(),) for r in x], "a array<double>").select(array_to_vector("a").alias("features"))
    found = C.kmeans_all(C.weighted_rows(df, "features"), range(2, 10))
    assert found[6][1] < 1.2 * 480 * 4 * 0.01 and all(found[k + 1][1] <= found[k][1] * 1.05 for k in range(2, 6))
    model = C.model_of(spark, found[6][0], "features", "cluster")
    centres = np.array(model.clusterCenters())
    assert np.sort(centres, axis=0) == pytest.approx(np.sort(found[6][0], axis=0))
    model.write().save(str(tmp_path / "m"))
    assert model.transform(df).groupBy("cluster").count().select("count").distinct().collect()[0][0] == 80


def test_few_distinct_rows(spark):
    df = spark.createDataFrame([([float(i % 3), 1.0],) for i in range(50)], "a array<double>").select(array_to_vector("a").alias("features"))
    model, k, costs = FE.fit_segments(df, "features", ks=range(2, 6))
    assert [c for _, c in costs][1:] == pytest.approx([0, 0, 0], abs=1e-12) and k in (2, 3)
    assert model.transform(df).select("cluster").distinct().count() == k
