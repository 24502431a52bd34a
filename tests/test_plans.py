"""Plan shape and edge results of curves, drift and numbering: one scan, no cross join."""

import re

import pytest
from pyspark.sql import functions as F

from riskframe.operators import drift as DR
from riskframe.operators import metrics as EV
from riskframe.operators import selection as SEL
from riskframe.operators import training as ML
from riskframe.operators.aggregates import box_stats, describe
from riskframe.operators.features import OneHotModel, label_encode
from riskframe.operators.prefix import running_max_before
from riskframe.operators.scoring import route_models
from riskframe.session import table

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def preds(spark):
    li = table(spark, SF, "lineitem")
    return li.select((F.col("l_returnflag") == "R").cast("int").alias("target"), "l_linestatus",
                     ((F.col("l_quantity") / 50 + F.col("l_discount") * 10) / 2).alias("prediction"))


def test_no_cross_joins_with_and_without_groups(no_broadcast, preds):
    li = table(no_broadcast, SF, "lineitem")
    for groups in ([], ["l_linestatus"]):
        for df in (EV.curve_points(preds, groups, buckets=7), EV.roc_auc(preds, groups), EV.pr_table(preds, groups, buckets=7),
                   EV.quality(preds, groups), box_stats(li, groups, "l_quantity", exact=True)):
            assert not re.search("CartesianProduct|NestedLoop", plan_of(df))
            assert "lineitem" not in plan_of(df)  # every branch reads the written counts
    for c in ("l_quantity", "l_shipmode" if "l_shipmode" in li.columns else "l_returnflag"):
        assert not re.search("CartesianProduct|NestedLoop", plan_of(label_encode(li, c, buckets=5)))
    sides = li.where("l_linestatus = 'F'"), li.where("l_linestatus = 'O'")
    t = DR.drift_table(*sides, ["l_quantity", "l_tax"], ["l_returnflag"])
    assert not re.search("CartesianProduct|NestedLoop", plan_of(t)) and "lineitem" not in plan_of(t)
    assert "lineitem" not in plan_of(describe(li, ["l_quantity", "l_tax"], exact=True))


def test_rows_without_score_are_not_measured(spark):
    p = spark.createDataFrame([(1, None), (1, 0.9), (0, 0.1), (None, 0.5)], "target int, prediction double")
    q = EV.quality(p).first()
    assert (q["n"], q["accuracy"], q["tp"] + q["fp"] + q["fn"] + q["tn"]) == (2, 1.0, 2)
    empty = EV.quality(p.limit(0)).first()
    assert empty["n"] == 0 and empty["accuracy"] is None and empty["roc_auc"] is None


def test_drift_verdicts_are_never_null(spark):
    ref = spark.createDataFrame([(1.7e9 + i, 1.0, None, "a") for i in range(10)], "big double, const double, none double, t string")
    cur = spark.createDataFrame([(1.7e9 + i + 20, 99.0, None, None) for i in range(10)], "big double, const double, none double, t string")
    t = {r["column"]: r for r in DR.drift_table(ref, cur, ["big", "const", "none"], ["t"]).collect()}
    assert {c: r["drifted"] for c, r in t.items()} == {"big": True, "const": True, "none": False, "t": True}
    assert t["big"]["statistic"] == pytest.approx(20 / 8.25 ** 0.5)
    for a, b in ((ref, cur.limit(0)), (ref.limit(0), cur), (ref.limit(0), cur.limit(0))):
        rows = DR.drift_table(a, b, ["big", "const", "none"], ["t"]).collect()
        assert len(rows) == 4 and all(r["drifted"] is not None for r in rows)


def test_chi_square_p_values(spark):
    known = [(3.841458820694124, 1.0, 0.05), (9.21034037197618, 2.0, 0.01), (0.0, 3.0, 1.0), (16.918977604620448, 9.0, 0.05)]
    df = spark.createDataFrame(known, "chi2_statistic double, chi2_dof double, p double")
    for r in DR.with_chi2_pvalue(df).collect():
        assert r["chi2_pvalue"] == pytest.approx(r["p"], abs=1e-9)


def test_order_columns_keep_their_type(spark):
    rows = [("k", 2 ** 53 + i, float(10 - i), f"2024-01-0{i + 1}", f"same-prefix-{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "key string, seq long, score double, day string, name string").withColumn("day", F.to_date("day"))
    for order in ("seq", "day", "name"):
        for buckets in (1, 3):
            got = running_max_before(df, ["key"], order, "score", buckets=buckets, name="m").orderBy(order).collect()
            assert [r["m"] for r in got] == [None, 10.0, 10.0, 10.0]


def test_nan_never_wins(spark):
    c = spark.createDataFrame([("a", 1, float("nan")), ("a", 2, 0.7), ("a", 3, 0.6)], "key string, seq int, score double")
    assert [r["accepted"] for r in SEL.gate_history(c, "key", "seq", "score").orderBy("seq").collect()] == [False, True, False]
    best = SEL.keep_best(c.where("seq = 2"), c.where("seq <> 2"), "key", "score").collect()
    assert [r["score"] for r in best] == [0.7]
    assert not SEL.gate(0.5, c.where("seq = 1"), "score").first()["accepted"]


def test_encoder_has_no_size_limit_and_keeps_order(spark):
    df = spark.range(3000).select((F.col("id") % 1500).alias("n"), F.concat(F.lit("Customer#"), F.col("id") % 1200).alias("t"))
    m = OneHotModel.fit(df, ["n", "t"])
    names = m.feature_names()
    assert len(names) == 2700 and names[:3] == ["n_0", "n_1", "n_2"] and names[1500:1502] == ["t_Customer#0", "t_Customer#1"]
    out = m.transform(df.limit(1).unionByName(spark.createDataFrame([(None, "?")], "n long, t string"))).collect()
    assert sorted(len(r["features"].indices) for r in out) == [0, 2] and out[0]["features"].size == 2700
    codes = label_encode(df, "t", buckets=9).select("t", "t_code").distinct().orderBy("t").collect()
    assert [r["t_code"] for r in codes] == list(range(1200))


def test_rows_without_a_model_stay(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, s string")
    out = route_models(df, "s", {}, ["k"]).orderBy("k").collect()
    assert [(r["k"], r["predicted"]) for r in out] == [(1, None), (2, None), (3, None)]


def test_search_spaces_and_bound(spark):
    for family, space in ML.SPACES.items():
        for p in ML.sample_params(space, 50, 3):
            for k, v in p.items():
                r = space[k]
                assert v in r.choices if r.choices else r.low <= float(v) <= r.high, (family, k, v)
    assert ML.sample_params(ML.SPACES["XGB"], 1, 1961) != ML.sample_params(ML.SPACES["GBT"], 1, 1961)
    assert {float(p["minInfoGain"]) % 5 for p in ML.sample_params(ML.LGBM_SPACE, 30, 1)} == {0.0}
    d = spark.range(10_000).withColumnRenamed("id", "k")
    assert 800 < ML.fit_sample(d, "k", 1000).count() < 1200 and ML.fit_sample(d, "k", 20_000).count() == 10_000


def test_segment_models_match_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    x = rng.normal(1e6, 1, (300, 2))  # a large offset: raw cross products would cancel
    y = 3 + x @ [2.0, -1.0] + rng.normal(0, 0.1, 300)
    df = spark.createDataFrame([(int(i % 3), float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))],
                               "s int, a double, b double, y double")
    for r in ML.segment_linear_models(df, "s", ["a", "b"], "y").collect():
        pick = np.arange(300) % 3 == r["s"]
        centred = x[pick] - x[pick].mean(0)
        w = np.linalg.lstsq(centred, y[pick] - y[pick].mean(), rcond=None)[0]
        assert [r["w_a"], r["w_b"]] == pytest.approx(list(w), rel=1e-6) and r["rows"] == 100
        assert r["intercept"] == pytest.approx(y[pick].mean() - x[pick].mean(0) @ w, rel=1e-5)


def test_only_large_groups_are_split_and_sums_stay_exact(spark, monkeypatch):
    from pyspark.sql import Window
    from riskframe.operators import prefix
    monkeypatch.setattr(prefix, "ROWS_PER_BUCKET", 40)
    o = table(spark, SF, "orders").select(F.when(F.col("o_orderkey") < 500, F.lit("large")).otherwise(
        F.col("o_custkey").cast("string")).alias("g"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    laid, groups = prefix.lay_out(o, ["g"], "k", None, 10000)
    buckets = {r["g"]: r["n"] for r in laid.groupBy("g").agg(F.count_distinct("_bk").alias("n")).collect()}
    assert buckets["large"] > 5 and {n for g, n in buckets.items() if g != "large"} == {1}
    for descending in (False, True):
        got = prefix.running_sums(o, ["g"], "k", ["v"], descending=descending, with_next=True, totals=True)
        order = F.desc("k") if descending else F.asc("k")
        w = Window.partitionBy("g").orderBy(order)
        want = o.select("g", "k", F.sum("v").over(w).alias("c"), F.lead("k").over(w).alias("nx"),
                        F.sum("v").over(Window.partitionBy("g")).alias("t"))
        bad = got.join(want, ["g", "k"]).where("abs(cum_v - c) > 1e-6 or not (next_k <=> nx) or abs(all_v - t) > 1e-6")
        assert bad.count() == 0 and got.count() == o.count()


def test_binary_search_counts_limits_below(spark):
    from riskframe.operators.prefix import count_below
    limits = [1, 3, 3, 7]
    df = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 7, 8, None)], "x int")
    t = F.array(*[F.lit(v) for v in limits])
    got = df.select("x", count_below(t, 4, F.col("x")).alias("a"), count_below(t, 4, F.col("x"), True).alias("b")).collect()
    for r in got:
        x = r["x"]
        assert (r["a"], r["b"]) == ((0, 0) if x is None else (sum(v < x for v in limits), sum(v <= x for v in limits)))
