"""Cross products: exact against numpy with nulls, groups and large offsets; 135 columns; rank and table measures."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import gram as G
from riskframe.operators import quality as Q
from riskframe.operators import training as ML


def test_moments_against_pandas(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(1e8, [1, 5, 1e-2, 3], (500, 4))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 3] = np.where(rng.random(500) < 0.99, np.nan, x[:, 3])
    by = [None if i % 3 == 0 else f"g{i % 3}" for i in range(500)]
    rows = [(g, *[None if math.isnan(v) else float(v) for v in r]) for g, r in zip(by, x)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, d double").repartition(7)
    got = {r["by"]: r for r in G.cross_moments(df, list("abcd"), "g").collect()}
    assert set(got) == {None, "g1", "g2"}
    for g, r in got.items():
        mine = pd.DataFrame(x[[b == g for b in by]], columns=list("abcd"))
        n, cov = (np.array(r[k]).reshape(4, 4) for k in ("n", "cov"))
        for i, a in enumerate("abcd"):
            for j, b in enumerate("abcd"):
                both = mine[[a, b]].dropna() if i != j else mine[[a]].dropna()
                assert n[i, j] == len(both)
                if len(both):
                    want = ((both.iloc[:, 0] - both.iloc[:, 0].mean()) * (both.iloc[:, -1] - both.iloc[:, -1].mean())).sum()
                    assert cov[i, j] == pytest.approx(want, rel=1e-6, abs=1e-5)
    pairs = {(r.column_a, r.column_b): r.pearson for r in Q.correlations(df, list("abcd")).collect()}
    want = pd.DataFrame(x, columns=list("abcd")).corr()
    assert len(pairs) == 6 and all(v == pytest.approx(want.loc[k], rel=1e-6, abs=1e-6) for k, v in pairs.items() if not math.isnan(want.loc[k]))


def test_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (1.0, 3.0, None)], "a double, b double, c double")
    assert {r.pearson for r in Q.correlations(df, ["a", "b", "c"]).collect()} == {None}  # constant or unknown
    assert [r.pearson for r in Q.correlations(df.limit(0), ["a", "b"]).collect()] == [None]
    assert Q.correlations(df, ["a"]).count() == 0
    assert G.cross_moments(df.limit(0), ["a"]).count() == 0
    nan = spark.createDataFrame([(1.0, float("nan")), (2.0, 1.0)], "a double, b double")
    assert math.isnan(Q.correlations(nan, ["a", "b"]).first().pearson)


def test_many_groups_pass_a_small_state(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id % 500 g", "double(id % 7) a", "double(id % 11) b")
    run = G._fold(2)  # in this process, with a state of three groups
    monkeypatch.setattr(G, "STATE_BYTES", 3 * 8 * 4 * 4)
    few = G._fold(2)
    table = df.select(F.col("g").alias("by"), F.array("a", "b").alias("x")).toArrow()
    parts = [list(f(iter(table.to_batches()))) for f in (run, few)]
    assert max(b.num_rows for b in parts[1]) == 3 and sum(b.num_rows for b in parts[0]) <= sum(b.num_rows for b in parts[1])
    merged = {}
    for b in parts[1]:
        for i, g in enumerate(b.column("by").to_pylist()):
            m = G.Moments(*[b.column(p)[i].values.to_numpy().reshape(2, 2) for p in ("n", "mean", "var", "cov")])
            if g in merged:
                merged[g].add(m)
            else:
                merged[g] = m
    assert len(merged) == 500 and all(m.n[0, 1] == 6 for m in merged.values())


def test_135_features(spark):
    """As wide as the account table after encoding; wide rows only ever become one matrix per task."""
    names = [f"f{i}" for i in range(135)]
    df = spark.range(100_000, numPartitions=8).withColumn("label", (F.col("id") % 3 == 0).cast("int")).select(
        "label", *[(F.rand(i) + F.col("label") * (i % 5) / 10).alias(n) for i, n in enumerate(names)])
    start = time.time()
    stats = ML.lda_statistics(df, names).collect()
    assert {r["n"] for r in stats} == {33_334, 66_666} and len(stats[0]["scatter"]) == 135 ** 2
    fit = ML.lda_fit(stats, names, fourth=ML.lda_fourth_moments(df, names, stats))
    assert time.time() - start < 120
    w = np.array(fit["weights"])
    assert np.corrcoef(w, np.arange(135) % 5)[0, 1] > 0.99
    assert Q.correlations(df.select(*names), names).count() == 135 * 134 // 2


def test_segments_of_135_features(spark):
    rng = np.random.default_rng(4)
    names, w = [f"f{i}" for i in range(135)], rng.normal(size=135)
    x = rng.normal(size=(600, 135)).round(3)
    rows = [(int(i % 2), float(r @ w + i % 2), *map(float, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "s int, y double, " + ", ".join(f"{n} double" for n in names))
    for r in ML.segment_linear_models(df, "s", names, "y").collect():
        assert r["rows"] == 300 and r["intercept"] == pytest.approx(r["s"], abs=1e-6)
        assert [r[f"w_{n}"] for n in names] == pytest.approx(list(w), abs=1e-6)


def test_rank_correlation_and_association_edges(spark):
    rng = np.random.default_rng(2)
    x = pd.DataFrame({"a": rng.integers(0, 6, 400).astype(float), "b": rng.normal(size=400).round(1), "c": rng.integers(0, 3, 400).astype(float)})
    x["b"] += x["a"]
    x.loc[::17, "a"] = np.nan
    x.loc[::23, "c"] = np.nan
    rows = [tuple(None if math.isnan(v) else float(v) for v in r) for r in x.itertuples(index=False)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    want = x.dropna().corr(method="spearman")
    for r in Q.rank_correlations(df, ["a", "b", "c"]).collect():
        assert r.spearman == pytest.approx(want.loc[r.column_a, r.column_b], abs=1e-9)
    same = df.selectExpr("a", "a * 10 as twin", "1 as one", "cast(null as string) as gone")
    got = {(r.column_a, r.column_b): r.cramers_v for r in Q.associations(same, ["a", "twin", "one", "gone"]).collect()}
    assert got[("a", "twin")] == pytest.approx(1) and got[("a", "one")] is None and got[("twin", "gone")] is None
    assert Q.rank_correlations(df.limit(0), ["a", "b"]).first().spearman is None
