"""Edge-case frames (bins, nulls, unseen categories, ties, empty reference, gates)."""

import math

import pytest
from pyspark.sql import functions as F

from riskframe.config import CREDIT_FEATURE_GROUPS, MetricConfig
from riskframe.functions import scalars as S
from riskframe.operators import features as FE
from riskframe.operators import merge as M
from riskframe.operators import metrics as EV
from riskframe.operators import selection as SEL
from riskframe.operators import split as SP
from riskframe.operators.aggregates import pivot_counts

GROUPS = {g.name: g for g in CREDIT_FEATURE_GROUPS}


def _one_col(spark, values, dtype="int"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")


def _prepared_labels(spark, group, values, dtype="int"):
    g = GROUPS[group]
    df = _one_col(spark, values, dtype)
    x = S.clip("x", g.lower_bound, g.upper_bound)
    out = df.select("i", S.cut_label(x, g.bins).alias("label")).orderBy("i")
    return [r["label"] for r in out.collect()]


def test_cut_age_clip_then_right_closed(spark):
    got = _prepared_labels(spark, "Age", [19, 20, 21, 25, 26, 80, 95, None])
    assert got == [None, None, "(20, 25]", "(20, 25]", "(25, 30]", "(60, 80]", "(60, 80]", None]


def test_cut_pay_amt(spark):
    got = _prepared_labels(spark, "pay_amt", [-1, 0, 1, 25000, 25001])
    assert got == [None, "(-1, 0]", "(0, 25000]", "(0, 25000]", "(25000, 50000]"]


def test_cut_bill_amt(spark):
    got = _prepared_labels(spark, "bill_amt", [-350000, -1, 0, 3000000])
    assert got == [None, "(-350000, -1]", "(-1, 0]", "(200000, 2000000]"]


def test_clip_pay_keeps_null(spark):
    g = GROUPS["pay_x"]
    df = _one_col(spark, [-5, -2, 4, 8, None])
    got = [r[0] for r in df.orderBy("i").select(S.clip("x", g.lower_bound, g.upper_bound)).collect()]
    assert got == [-2, -2, 4, 4, None]


def test_null_label_text(spark):
    df = _one_col(spark, [10, 30])
    got = [r[0] for r in df.orderBy("i").select(S.cut_label("x", (20, 25, 30), null_label="nan")).collect()]
    assert got == ["nan", "(25, 30]"]


def test_one_hot_unseen_and_null_are_all_zero(spark):
    fit = _one_col(spark, [-2, -1, 0])
    model = FE.OneHotModel.fit(fit, ["x"])
    assert model.feature_names() == ["x_-2", "x_-1", "x_0"]
    out = model.transform(_one_col(spark, [-1, 7, None]), "v").orderBy("i").collect()
    vecs = [r["v"].toArray().tolist() for r in out]
    assert vecs == [[0.0, 1.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]]


def test_one_hot_numeric_order(spark):
    fit = _one_col(spark, [10, 2, 1])
    assert FE.OneHotModel.fit(fit, ["x"]).feature_names() == ["x_1", "x_2", "x_10"]


def test_insert_if_new(spark):
    ref = spark.createDataFrame([(1,), (2,), (3,)], "ID int")
    new = spark.createDataFrame([(2,), (3,), (4,)], "ID int")
    assert [r.ID for r in M.rows_to_insert(new, ref, "ID").collect()] == [4]
    assert M.rows_to_insert(spark.createDataFrame([(1,), (2,)], "ID int"), ref, "ID").isEmpty()
    merged = M.insert_if_new(ref, new, "ID")
    assert sorted(r.ID for r in merged.collect()) == [1, 2, 3, 4]
    # idempotent: merging the same batch again adds nothing
    assert sorted(r.ID for r in M.insert_if_new(merged, new, "ID").collect()) == [1, 2, 3, 4]


def test_stratified_split_exact_counts(spark):
    rows = [(i, 0) for i in range(10)] + [(100 + i, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "ID int, default int")
    s = SP.stratified_split(df, "default", "ID", 0.2, seed=1961)
    counts = {(r["default"], r["split"]): r["count"] for r in s.groupBy("default", "split").count().collect()}
    assert counts[(0, "test")] == 2 and counts[(1, "test")] == 1
    assert counts[(0, "train")] == 8 and counts[(1, "train")] == 4


def test_keep_best_registry(spark):
    reg = spark.createDataFrame([("k", 0.70, 0)], "key string, score double, seq int")
    for score, seq, expect_seq in ((0.70, 1, 0), (0.69, 2, 0), (0.71, 3, 3)):
        new = spark.createDataFrame([("k", score, seq)], "key string, score double, seq int")
        reg = SEL.keep_best(reg, new, "key", "score")
        assert reg.collect()[0]["seq"] == expect_seq


def _metric_rows(spark, rows):
    return spark.createDataFrame(rows, "model string, seq int, split string, accuracy double, roc_auc double")


def test_best_model_later_wins_tie_and_floor(spark):
    m = _metric_rows(spark, [
        ("A", 0, "train", 0.90, 0.80), ("A", 0, "test", 0.87, 0.77),
        ("B", 1, "train", 0.90, 0.80), ("B", 1, "test", 0.87, 0.77),
        ("C", 2, "train", 0.60, 0.70), ("C", 2, "test", 0.61, 0.71)])
    best = SEL.best_model(m, "accuracy", 0.05, 0.805).collect()
    assert [r["model"] for r in best] == ["B"]


def test_best_model_none(spark):
    m = _metric_rows(spark, [("A", 0, "train", 0.90, 0.8), ("A", 0, "test", 0.70, 0.7)])
    assert SEL.best_model(m, "accuracy", 0.05, 0.805).isEmpty()


def test_gate(spark):
    df = spark.createDataFrame([(0.805,), (0.806,)], "test_score double")
    got = [(r["accepted"], r["new_threshold"]) for r in SEL.gate(0.805, df).collect()]
    assert got == [(False, 0.805), (True, 0.806)]


def test_request_rules(spark):
    df = spark.createDataFrame([(20, 0), (21, 0), (100, 0), (30, 10)], "AGE int, PAY_0 int")
    rules = {"age_range": (F.col("AGE") > 20) & (F.col("AGE") < 100), "pay_0": F.col("PAY_0") < 10}
    got = [len(r[0]) == 0 for r in df.select(S.rule_violations(rules)).collect()]
    assert got == [False, True, False, False]


def test_auc_all_ties_is_half(spark):
    df = spark.createDataFrame([(t, 0.3) for t in (0, 1, 1, 0, 1)], "target int, prediction double")
    assert EV.roc_auc(df).collect()[0]["roc_auc"] == pytest.approx(0.5)


def test_pivot_share_missing_cell_is_null(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "k string, t int")
    out = {r["k"]: r for r in pivot_counts(df, "k", "t", [0, 1]).collect()}
    assert out["b"]["n_1"] is None and out["b"]["share_1"] is None
    assert out["b"]["share_0"] == pytest.approx(1.0)


def test_golden_confusion_counts_reproduce_report(spark):
    """Counts derived for the published test split reproduce its rates to all printed digits."""
    rows = [(1, 0.9)] * 260 + [(0, 0.9)] * 103 + [(1, 0.1)] * 1067 + [(0, 0.1)] * 4570
    df = spark.createDataFrame(rows, "target int, prediction double")
    q = EV.quality(df, [], MetricConfig()).collect()[0]
    assert q["accuracy"] == pytest.approx(0.805, abs=1e-15)
    assert q["precision"] == pytest.approx(0.7162534435261708, abs=1e-15)
    assert q["recall"] == pytest.approx(0.19593067068575734, abs=1e-15)
    assert q["f1"] == pytest.approx(0.3076923076923077, abs=1e-15)
    assert q["tnr"] == pytest.approx(0.9779584849133319, abs=1e-15)
    assert q["fpr"] == pytest.approx(0.022041515086668094, abs=1e-15)
    assert q["fnr"] == pytest.approx(0.8040693293142427, abs=1e-15)
    assert q["tpr"] + q["fnr"] == pytest.approx(1.0)
    assert not math.isnan(q["log_loss"])


def test_label_encode_matches_dense_rank(spark):
    from pyspark.sql import Window
    words = ["b", "a", "ab", "", "zz", "b", "Ä", "a"]
    df = spark.createDataFrame([(i, w, (i * 7) % 5) for i, w in enumerate(words)] + [(99, None, None)],
                               "i int, w string, n int")
    for c in ("w", "n"):
        got = {r["i"]: r[f"{c}_code"] for r in FE.label_encode(df, c).collect()}
        d = df.select(c).where(F.col(c).isNotNull()).distinct().withColumn(
            "want", F.dense_rank().over(Window.orderBy(c)) - 1)
        want = {r["i"]: r["want"] for r in df.join(d, c, "left").collect()}
        assert got == want
