"""Order statistics of text: buckets from the values themselves, results as one global order gives them."""

import random

import pytest
from pyspark.sql import functions as F

from riskframe.operators import features as FE
from riskframe.operators import prefix as P


def sizes(d):
    return [r[0] for r in d.groupBy("_bk").count().orderBy("_bk").select("count").collect()]


def test_text_with_a_common_start_spreads_like_numbers(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_BUCKET", 500)
    df = spark.range(5000).select("id", F.format_string("Customer#%09d", "id").alias("name"))
    by_number, by_text = (sizes(P.lay_out(df, [], c, None, 10000)[0]) for c in ("id", "name"))
    assert len(by_number) == 10 and 8 <= len(by_text) <= 10 and max(by_text) < 1000
    d, _ = P.lay_out(df, [], "name", None, 10000)
    spans = [(r.a, r.b) for r in d.groupBy("_bk").agg(F.min("name").alias("a"), F.max("name").alias("b")).orderBy("_bk").collect()]
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))  # ranges follow each other


def test_running_sums_over_text(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_BUCKET", 40)
    rng = random.Random(1)
    names = sorted({"id-" + "".join(rng.choices("abé漢zZ0", k=rng.randint(0, 6))) for _ in range(900)}, key=str.encode)
    rows = [(g, n, rng.randint(1, 9)) for g in ("x", None, "y") for n in names[:None if g == "x" else 30]]
    df = spark.createDataFrame(rows, "g string, name string, n int").repartition(5)
    for down in (False, True):
        got = {(r.g, r.name): r.cum_n for r in P.running_sums(df, ["g"], "name", ["n"], descending=down).collect()}
        for g in ("x", None, "y"):
            total = 0
            for _, name, n in sorted((r for r in rows if r[0] == g), key=lambda r: r[1].encode(), reverse=down):
                total += n
                assert got[(g, name)] == total


def test_label_codes_and_dictionary_of_text(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_BUCKET", 50)
    df = spark.range(700).select((F.col("id") / 4).alias("v"), F.format_string("same start %04d", F.col("id") % 333).alias("t"))
    codes = {r.t: r.t_code for r in FE.label_encode(df, "t").select("t", "t_code").distinct().collect()}
    assert codes == {t: i for i, t in enumerate(sorted(codes))}
    names = FE.category_dictionary(df, ["t", "v"]).orderBy("feature_index").collect()
    assert [r.feature_index for r in names] == list(range(333 + 700))
    assert [r.value for r in names[:333]] == sorted(codes) and [r.value_num for r in names[333:]] == [i / 4 for i in range(700)]


@pytest.mark.parametrize("buckets", [1, 2, 7])
def test_given_buckets_and_equal_or_null_values(spark, buckets):
    df = spark.createDataFrame([("a", 1)] + [(None, 2)] + [(f"k{i}", 1) for i in range(30)], "v string, n int")
    got = [r.cum_n for r in P.running_sums(df, [], "v", ["n"], buckets=buckets).orderBy("v").collect()]
    assert got == [2 + i for i in range(32)]
