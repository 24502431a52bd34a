"""Fitted models: planted signal, searches inside the ranges, saved and loaded units, clusters."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from riskframe.operators import clusters as C
from riskframe.operators import features as FE
from riskframe.operators import training as ML
from riskframe.plans import q_training as Q
from riskframe.session import keep, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark):
    """Rows whose label follows the price, prepared and with folds."""
    data, model = Q.prepared(spark, SF, Q.REVENUE)
    return keep(data, "planted"), model


def test_trials_find_a_planted_signal(spark, planted):
    rows = Q._fit_rows(planted[0])
    reg, log = ML.search(rows, ("XGB",), 1)
    r = reg.first()
    assert r["score"] > 0.9 and log.count() == 1
    assert ML.XGB_SPACE["maxDepth"].low <= int(r["params"]["maxDepth"]) <= ML.XGB_SPACE["maxDepth"].high
    folds = ML.fold_scores(ML.make_estimator("XGB", validation_col="is_val"), {"maxDepth": 4}, rows).collect()
    assert [f["fold"] for f in folds] == [0, 1, 2, 3, 4] and all(f["roc_auc"] > 0.85 for f in folds)


def test_importances_carry_plain_names(spark, planted):
    data, unit = planted
    names = FE.unit_names(unit)
    assert names[:4] == [f"l_linenumber_{i}" for i in (1, 2, 3, 4)] and "l_linestatus_F" in names and names[-1] == "l_tax"
    m = ML.make_estimator("GBT").setMaxIter(5).fit(Q._fit_rows(data))
    top = ML.feature_importance(m, names).first()
    assert top["feature"].startswith("l_extendedprice_")


def test_negative_numbers_sort_before_others(spark):
    from riskframe.config import FeatureGroup
    df = spark.createDataFrame([(v,) for v in (10, -2, 0, 2, -1, -10)], "x int")
    unit = FE.feature_unit((FeatureGroup("g", ("x",), -50, 50, None),)).fit(df)
    assert FE.unit_names(unit) == ["x_-10", "x_-2", "x_-1", "x_0", "x_2", "x_10"]


def test_unit_with_clusters_is_saved_and_loaded(spark, tmp_path):
    d = Q.split_labelled(spark, SF)
    model = FE.fit_feature_unit(Q.unit(), d.where("split = 'train'"), ks=range(2, 6))
    ML.save_unit(model, str(tmp_path / "unit"))
    a, b = (m.transform(d).select(F.hash("features", "cluster").alias("h")).groupBy().sum("h").first()[0]
            for m in (model, ML.load_unit(str(tmp_path / "unit"))))
    assert a == b


def test_cluster_cost_falls_and_knee_is_inside(spark):
    e = keep(Q.prepared(spark, SF)[0].select("features"), "vectors")
    _, k, costs = FE.fit_segments(e, "features", ks=range(2, 8))
    assert 2 <= k <= 7 and costs[-1][1] < costs[0][1]


def test_train_job_saves_a_working_unit(spark):
    rows = E.queries()["ml14_train_job"](spark, SF).collect()
    for r in rows:
        assert r["same_scores"] and r["test_accuracy"] >= 0.7 and r["scored_rows"] > 1000
    assert len(rows) == 1


def test_routed_rows_keep_their_number(spark):
    assert E.queries()["ml12_segment_models"](spark, SF).count() == table(spark, SF, "lineitem").count()


def test_request_scoring_splits_rows(spark):
    out = E.queries()["sco3_request_scoring"](spark, SF)
    assert out.where("(predicted IS NULL) = (violations IS NOT NULL)").count() == table(spark, SF, "lineitem").count()


def test_discriminant_matches_numpy_with_and_without_shrinkage(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.4).astype(int)
    x = rng.normal(0, [1, 5, 0.1], (400, 3)) + y[:, None] * [1.0, 2.0, 0.05] + [1e5, 0, 0]
    df = spark.createDataFrame([(int(k), *map(float, r)) for k, r in zip(y, x)], "label int, a double, b double, c double")
    f = ["a", "b", "c"]
    stats = ML.lda_statistics(df, f).collect()
    for fourth in (None, ML.lda_fourth_moments(df, f, stats)):
        parts = [x[y == k] - x[y == k].mean(0) for k in (0, 1)]
        if fourth is None:
            S = sum(p.T @ p for p in parts) / (len(x) - 2)
        else:
            S = np.zeros((3, 3))
            for p in parts:  # Ledoit-Wolf on the standardised class, scaled back
                sd = p.std(0)
                z = p / sd
                C = z.T @ z / len(z)
                mu = np.trace(C) / 3
                spread = ((C - mu * np.eye(3)) ** 2).sum()
                noise = sum(((np.outer(r, r) - C) ** 2).sum() for r in z) / len(z) ** 2
                a = min(noise, spread) / spread
                S += len(p) / len(x) * ((1 - a) * C + a * mu * np.eye(3)) * np.outer(sd, sd)
        w = np.linalg.solve(S + 1e-9 * np.eye(3), x[y == 1].mean(0) - x[y == 0].mean(0))
        assert ML.lda_fit(stats, f, fourth=fourth)["weights"] == pytest.approx(list(w), rel=1e-5)


def test_discriminant_search_covers_its_choices(spark):
    rows = {r["shrinkage"]: r["score"] for r in E.queries()["ml3_lda_search"](spark, SF).collect()}
    assert set(rows) == {"none", "auto"} and all(0.4 < v <= 1 for v in rows.values())  # the features hardly tell


def test_scratch_is_cleared(spark):
    from riskframe.session import clear_scratch, scratch_path
    path = scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert clear_scratch(spark) >= 1
    from riskframe.sources.files import path_exists
    assert not path_exists(spark, path)


def test_encoder_and_clusters_are_fitted_on_the_whole_train_part(spark, monkeypatch):
    monkeypatch.setattr(Q, "FIT_ROWS", 1)
    fitted, units, fit = [], [], FE.fit_segments
    segments = lambda df, features, k=None, **a: fitted.append(df.count()) or fit(df, features, k=k or 2)
    for module in (FE, Q):
        monkeypatch.setattr(module, "fit_segments", segments)
    save = ML.save_unit
    monkeypatch.setattr(ML, "save_unit", lambda m, path: units.append(m) or save(m, path))
    train = Q.split_labelled(spark, SF).where("split = 'train'").count()
    Q.fe10_feature_unit(spark, SF)
    Q.snk6_model_unit(spark, SF)
    assert fitted == [train]
    size = [u.transform(Q.split_labelled(spark, SF)).select("features").first()[0].size for u in units]
    assert size[0] == size[1]  # no category is missing from the unit whose classifier saw five rows
    monkeypatch.setattr(Q, "FIT_ROWS", 400)
    Q.ml12_segment_models(spark, SF)
    assert fitted[1] == train


def test_unit_scores_without_reading_the_train_part_again(spark, monkeypatch):
    from pyspark.ml import Estimator
    seen = []

    class Spy(Estimator):
        def _fit(self, df):
            seen.append(df)
            return ML.make_estimator("GBT").setMaxIter(1).fit(df)

    train = Q.split_labelled(spark, SF).where("split = 'train'")
    ML.fit_unit([*Q.unit().getStages(), Spy()], train, ML.fit_sample(train, "k", 1000))
    assert [len(d.inputFiles()) for d in seen] == [1] and "Join" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    assert len(Q._fit_rows(Q.prepared(spark, SF)[0]).inputFiles()) == 1


def test_equal_rows_are_counted_before_vectors_are_made(spark):
    data, model = Q.prepared(spark, SF)
    counted = FE.counted_rows(model, data)
    whole, few = C.weighted_rows(data, "features").collect(), C.weighted_rows(counted, "features", "weight").collect()
    assert counted.count() < data.count() and sorted((r.x, r.w) for r in whole) == sorted((r.x, r.w) for r in few)


def test_packed_rows_iterate_as_single_ones(spark, monkeypatch):
    import numpy as np
    rng = np.random.default_rng(4)
    points = [(p.tolist(), float(w)) for p, w in zip(rng.normal(0, 1, (3000, 3)) + rng.integers(0, 3, (3000, 1)) * 9, rng.integers(1, 4, 3000))]
    rows = spark.createDataFrame(points, "x array<double>, w double").repartition(3)
    packed, starts = C.packed_rows(rows), {k: np.array([p for p, _ in points[:k]]) for k in (2, 3)}
    assert packed.count() < 10
    for k, (weight, sums, cost) in C._step(rows, starts).items():
        again, plain = C._step(packed, starts)[k], C._step(packed, starts, costs=False)[k]
        assert np.allclose(weight, again[0]) and np.allclose(sums, again[1]) and cost == pytest.approx(again[2])
        assert np.allclose(sums, plain[1]) and plain[2] == 0
    local = C.lloyd(rows, starts)
    monkeypatch.setattr(C, "LOCAL_CELLS", 0)
    for k, (centres, cost) in C.lloyd(rows, starts).items():
        assert np.allclose(centres, local[k][0]) and cost == pytest.approx(local[k][1])


def test_statistics_of_the_other_folds_are_merged(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    data = [(int(y), int(f), *(None if v < -3 else float(v) for v in x)) for y, f, x in
            zip(rng.random(600) < 0.4, rng.integers(0, 3, 600), rng.normal(0, 1, (600, 2)))]
    df = spark.createDataFrame([(y, f, a and a + y, b) for y, f, a, b in data] + [(None, 0, 1.0, 1.0)], "label int, fold int, a double, b double")
    stats = ML._other_folds(df, ["a", "b"], "label", "fold", 3)
    for i in range(3):
        alone = {r.label: r for r in ML.lda_statistics(df.where(f"fold <> {i} and label is not null"), ["a", "b"]).collect()}
        for r in stats[i]:
            want = alone[r["label"]]
            assert r["n"] == want.n and r["means"] == pytest.approx(want.means) and r["scatter"] == pytest.approx(want.scatter)
