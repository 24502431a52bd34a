"""Invariants and plan-shape checks on the driver tables (sf0.001) and small fixtures."""

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskframe.operators import drift as DR
from riskframe.operators import metrics as EV
from riskframe.operators import split as SP
from riskframe.operators.aggregates import value_shares
from riskframe.operators.prefix import running_sums
from riskframe.session import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def preds(spark):
    li = table(spark, SF, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"),
                     (F.col("l_returnflag") == "R").cast("int").alias("target"),
                     ((F.col("l_quantity") / 50 + F.col("l_discount") * 10) / 2).alias("prediction"))


def test_split_disjoint_complete(spark):
    o = table(spark, SF, "orders")
    s = SP.stratified_split(o, "o_orderstatus", "o_orderkey")
    assert s.count() == o.count()
    assert s.select("o_orderkey").distinct().count() == o.count()


def test_folds_balanced(spark):
    o = table(spark, SF, "orders")
    f = SP.stratified_folds(o, "o_orderstatus", "o_orderkey", k=5)
    sizes = [r["count"] for r in f.groupBy("o_orderstatus", "fold").count().collect()]
    per = f.groupBy("o_orderstatus", "fold").count().groupBy("o_orderstatus").agg(
        (F.max("count") - F.min("count")).alias("spread")).collect()
    assert all(r["spread"] <= 1 for r in per) and sum(sizes) == o.count()


def test_shares_sum_to_one(spark):
    s = value_shares(table(spark, SF, "orders"), "o_orderpriority")
    assert s.agg(F.sum("share")).first()[0] == pytest.approx(1.0)


def test_auc_complement(spark, preds):
    # scores on a 1/64 grid, so 1 - p is exact and keeps the tie structure
    g = preds.withColumn("prediction", F.round(F.col("prediction") * 64) / 64)
    a = EV.roc_auc(g).first()["roc_auc"]
    b = EV.roc_auc(g.withColumn("prediction", 1 - F.col("prediction"))).first()["roc_auc"]
    assert a + b == pytest.approx(1.0, abs=1e-12)


def test_auc_matches_rank_statistic(spark, preds):
    """Brute force on the small fixture: Mann-Whitney U with average ranks for ties."""
    pdf = preds.toPandas()
    ranks = pdf["prediction"].rank(method="average")
    pos = pdf["target"] == 1
    n1, n0 = int(pos.sum()), int((~pos).sum())
    expected = (ranks[pos].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    assert EV.roc_auc(preds).first()["roc_auc"] == pytest.approx(expected, abs=1e-12)


def test_running_sums_match_global_window(spark, preds):
    c = EV.score_counts(preds, [])
    r = running_sums(c, [], "score", ["pos"], buckets=8).orderBy("score").collect()
    total = 0
    for row in r:
        total += row["pos"]
        assert row["cum_pos"] == total


def test_ks_identical_sides_is_zero(spark):
    li = table(spark, SF, "lineitem")
    n = DR.numeric_drift(li, li, ["l_quantity", "l_discount"]).collect()
    assert all(r["ks_statistic"] == 0 and r["wasserstein"] == 0 for r in n)
    c = DR.categorical_drift(li, li, ["l_returnflag"]).collect()
    assert all(r["js_distance"] == 0 and r["chi2_statistic"] == 0 for r in c)


def test_js_symmetric(spark):
    li = table(spark, SF, "lineitem")
    a, b = li.where("l_linestatus = 'F'"), li.where("l_linestatus = 'O'")
    x = DR.categorical_drift(a, b, ["l_returnflag"]).first()["js_distance"]
    y = DR.categorical_drift(b, a, ["l_returnflag"]).first()["js_distance"]
    assert x == pytest.approx(y, abs=1e-12)


def test_planted_signal_gbt(spark):
    rows = [(float(i % 2), float(i % 2) * 2 + (i % 7) * 0.01) for i in range(400)]
    df = spark.createDataFrame(rows, "label double, x double")
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    m = GBTClassifier(maxIter=5, maxDepth=2, seed=1).fit(df)
    from riskframe.operators.scoring import score
    s = score(m, df, ["label"]).withColumn("target", F.col("label").cast("int"))
    assert EV.roc_auc(s).first()["roc_auc"] > 0.9


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_single_partition_over_rows(spark, preds):
    """Curves and exact splits must not funnel unaggregated rows into one task: a
    single-partition exchange may only move the output of an aggregation (bucket totals)."""
    for df in (EV.curve_points(preds, []), SP.stratified_split(preds.withColumn("s", F.lit(1)), "s", "k")):
        lines = [ln.strip(" :+-") for ln in _plan(df).splitlines()]
        for i, ln in enumerate(lines):
            if ln.startswith("Exchange SinglePartition"):
                assert lines[i + 1].startswith("HashAggregate"), "\n".join(lines)


def test_scan_prunes_columns(spark):
    o = table(spark, SF, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey")
    plan = _plan(o)
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan
    assert "o_totalprice" not in plan


def test_segment_linear_models_match_numpy(spark):
    """Brute force on the small fixture: per-segment lstsq on the raw rows."""
    import numpy as np
    from riskframe.operators.training import segment_linear_models
    li = table(spark, SF, "lineitem")
    feats = ["l_quantity", "l_discount", "l_tax"]
    got = {r["l_returnflag"]: r for r in segment_linear_models(li, "l_returnflag", feats, "l_extendedprice").collect()}
    pdf = li.select("l_returnflag", *feats, "l_extendedprice").toPandas()
    for seg, g in pdf.groupby("l_returnflag"):
        X = np.column_stack([np.ones(len(g)), g[feats].to_numpy()])
        w, *_ = np.linalg.lstsq(X, g["l_extendedprice"].to_numpy(), rcond=None)
        r = got[seg]
        assert r["rows"] == len(g)
        assert [r["intercept"], *[r[f"w_{f}"] for f in feats]] == pytest.approx(list(w), rel=1e-6, abs=1e-6)


def test_running_max_before_matches_window(spark):
    """Two-phase running maximum equals the plain per-key window (brute force, small fixture),
    including a key that holds most of the rows."""
    from pyspark.sql import Window
    from riskframe.operators.prefix import running_max_before
    o = table(spark, SF, "orders").select(
        F.when(F.col("o_orderstatus") == "F", F.lit(0)).otherwise(F.col("o_custkey")).alias("key"),
        "o_orderkey", "o_totalprice")
    got = running_max_before(o, ["key"], "o_orderkey", "o_totalprice", buckets=8, name="m")
    w = Window.partitionBy("key").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    want = o.withColumn("m", F.max("o_totalprice").over(w))
    a = sorted(tuple(r) for r in got.select("key", "o_orderkey", "m").collect())
    b = sorted(tuple(r) for r in want.select("key", "o_orderkey", "m").collect())
    assert a == b


def test_exact_quantiles_match_percentile(spark):
    """Distributed exact quantiles equal Spark's interpolated percentile (brute force per group),
    with ties, nulls, a one-row group and a group holding most rows."""
    from riskframe.operators.aggregates import quantiles
    rows = [("big", float(i % 37)) for i in range(700)] + [("one", 5.0), ("nul", None), ("nul", 2.0), ("nul", 2.0)]
    rows += [("mid", float(v)) for v in (3, 1, 4, 1, 5, 9, 2, 6)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
    got = {(r["g"], r["p"]): r["value"] for r in quantiles(df, ["x"], probs, groups=["g"], exact=True, buckets=8).collect()}
    want = df.groupBy("g").agg(F.percentile("x", F.lit(list(probs))).alias("q")).collect()
    for r in want:
        for p, v in zip(probs, r["q"]):
            assert got[(r["g"], p)] == pytest.approx(v, abs=1e-12)


def test_hold_out_and_folds_move_rows_at_most_once(spark, preds):
    for df in (SP.stratified_split(preds, "target", "k"), SP.stratified_folds(preds, "target", "k")):
        assert _plan(df).count("Exchange hashpartitioning") == 1
    split = SP.stratified_split(preds, "target", "k", 0.3, prefix=1)  # the limits lie inside a bucket
    hashes = split.groupBy("target", "split").agg(F.count("k").alias("n"), F.min(SP.seeded_hash("k", 1961)).alias("low"),
                                                  F.max(SP.seeded_hash("k", 1961)).alias("high"))
    part = {(r.target, r.split): r for r in hashes.collect()}
    for t in (0, 1):
        n = preds.where(F.col("target") == t).count()
        assert part[t, "test"].n == round(0.3 * n) and part[t, "train"].n == n - round(0.3 * n)
        assert part[t, "test"].high <= part[t, "train"].low  # keys repeat
