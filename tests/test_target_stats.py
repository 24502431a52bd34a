"""Ordered target statistics: row by row, no leakage, rows to score."""

import hashlib

import pytest

from riskframe.operators import prefix as P
from riskframe.operators import target_stats as T


@pytest.mark.parametrize("rows_per_bucket", [200_000, 20])
def test_row_by_row(spark, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(P, "ROWS_PER_BUCKET", rows_per_bucket)
    data = [(k, k * 7 % 3 % 2, "hot" if k % 2 else None if k % 5 == 0 else f"c{k % 4}", k % 3) for k in range(300)]
    df = spark.createDataFrame(data, "k long, y int, a string, b int").repartition(4)
    got = {r.k: (r.a_ts, r.b_ts) for r in T.ordered_target_means(df, "k", "y", ["a", "b"], seed=5, weight=2.0).collect()}
    prior = sum(r[1] for r in data) / len(data)
    seen = {}
    for k, y, a, b in sorted(data, key=lambda r: hashlib.md5(f"5:{r[0]}".encode()).hexdigest()):
        for i, c in enumerate((("a", a), ("b", b))):
            s, n = seen.get(c, (0, 0))
            assert got[k][i] == pytest.approx((s + 2 * prior) / (n + 2))
            seen[c] = (s + y, n + 1)
    # a row's own label does not change its own statistic
    flipped = spark.createDataFrame([(k, 1 - y if k == 17 else y, a, b) for k, y, a, b in data] , "k long, y int, a string, b int")
    own = T.ordered_target_means(flipped, "k", "y", ["a", "b"], seed=5, weight=0.001).where("k = 17").first()
    old = T.ordered_target_means(df, "k", "y", ["a", "b"], seed=5, weight=0.001).where("k = 17").first()
    assert own.a_ts == pytest.approx(old.a_ts, abs=1e-2)


def test_rows_to_score(spark):
    train = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (3, 1, None), (4, 0, "y")], "k long, y int, c string")
    fitted = T.fit_target_means(train, "y", ["c"])
    new = spark.createDataFrame([(10, "x"), (11, None), (12, "unseen")], "k long, c string")
    got = {r.k: r.c_ts for r in T.apply_target_means(new, "k", ["c"], fitted).collect()}
    assert got == pytest.approx({10: 1.5 / 3, 11: 1.5 / 2, 12: 0.5})
    twice = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (1, 1, "z"), (2, 1, "x")], "k long, y int, c string")
    out = T.ordered_target_means(twice, "k", "y", ["c"], seed=1)
    assert out.count() == 4 and out.where("k = 1 and c = 'x'").select("c_ts").distinct().count() == 1
    assert T.apply_target_means(new.limit(0), "k", ["c"], fitted).count() == 0
    assert T.ordered_target_means(train.limit(0), "k", "y", ["c"]).count() == 0


def test_rows_move_once_for_all_columns(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_BUCKET", 50)
    df = spark.createDataFrame([(k, k % 2, f"c{k % 4}", k % 3, k % 5) for k in range(200)], "k long, y int, a string, b int, c int")
    out = T.ordered_target_means(df, "k", "y", ["a", "b", "c"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_rows_without_key_or_label(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_BUCKET", 2)
    rows = [(None, 1, "x"), (None, 0, "x"), (1, None, "x"), (2, 1, "x"), (3, 0, "y")]
    df = spark.createDataFrame(rows, "k long, y int, c string").repartition(3)
    got = {(r.k, r.y): r.c_ts for r in T.ordered_target_means(df, "k", "y", ["c"], seed=1).collect()}
    assert len(got) == 5 and got[None, 1] is None and got[None, 0] is None and got[1, None] is None
    earlier = [1, 0, *([None] if hashlib.md5(b"1:1").hexdigest() < hashlib.md5(b"1:2").hexdigest() else [])]  # rows without a key come first
    assert got[2, 1] == pytest.approx((1 + 0.5) / (len(earlier) + 1)) and got[3, 0] == pytest.approx(0.5)
