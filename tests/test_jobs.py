"""Validate-then-merge job: first run stores, drift stops the job, clean batches merge new keys only."""

import pytest
from pyspark.sql import functions as F

from riskframe.operators.merge import insert_if_new, known_key_count, rows_to_insert
from riskframe.plans.validation import DataDriftError, validate_and_merge
from riskframe.session import scratch_path, table
from riskframe.sources import files
from riskframe.sources.versions import VersionedStore

SF = "/root/testdata/sf0.001"
DECLARED = {"o_orderkey": "bigint", "o_totalprice": "double", "o_orderpriority": "string"}


def _parts(df):
    return {"train": df, "test": df.limit(0)}


def test_first_run_then_merge_then_drift(spark):
    store = scratch_path(spark, "job-store")
    o = table(spark, SF, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    early = o.where(F.col("o_orderkey") < 1000)
    first = validate_and_merge(_parts(early), store, DECLARED, "o_orderkey", ["o_totalprice"], ["o_orderpriority"])
    assert first.first_run and first.schema_ok
    # same distribution, overlapping keys: only unseen keys are added, twice in a row
    res = validate_and_merge(_parts(o), store, DECLARED, "o_orderkey", ["o_totalprice"], ["o_orderpriority"])
    assert res.inserted == {"train": o.count() - early.count(), "test": 0} and res.suite_passed
    again = validate_and_merge(_parts(o), store, DECLARED, "o_orderkey", ["o_totalprice"], ["o_orderpriority"])
    assert again.inserted == {"train": 0, "test": 0}
    # a batch whose prices moved far away drifts: the job stops and the store is unchanged
    shifted = o.withColumn("o_totalprice", F.col("o_totalprice") * 10 + 1e6)
    with pytest.raises(DataDriftError):
        validate_and_merge(_parts(shifted), store, DECLARED, "o_orderkey", ["o_totalprice"], ["o_orderpriority"])
    assert VersionedStore(spark, store).snapshot().rows("train") == o.count()


def test_schema_of_every_part_counts(spark):
    store = scratch_path(spark, "job-store")
    o = table(spark, SF, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    bad = {"train": o, "test": o.limit(5).withColumn("o_totalprice", F.lit("n/a"))}
    res = validate_and_merge(bad, store, DECLARED, "o_orderkey", ["o_totalprice"], ["o_orderpriority"])
    assert not res.schema_ok and VersionedStore(spark, store).snapshot() is None


def test_null_keys_are_known_keys(spark):
    ref = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    new = spark.createDataFrame([(None, "c"), (2, "d"), (1, "e")], "k int, v string")
    assert [r.v for r in rows_to_insert(new, ref, "k").collect()] == ["d"]
    assert known_key_count(new, ref, "k").first()["known"] == 2
    once = insert_if_new(ref, new, "k")
    assert insert_if_new(once, new, "k").count() == once.count() == 3


def test_corrupt_lines_do_not_depend_on_the_projection(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\nx,3\n4,5,6\n7\n")
    r = files.read_csv(spark, str(tmp_path), "a int, b int, bad string", corrupt_col="bad")
    for cols in (["bad"], ["b", "bad"], ["a", "b", "bad"]):
        assert r.select(*cols).where("bad is not null").count() == 3
    assert [(x.a, x.b) for x in r.where("bad is null").collect()] == [(1, 2)]
