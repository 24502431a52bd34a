"""Key filter and hot keys of the merge: same rows as the plain anti join, and a plan that splits."""

from pyspark.sql import functions as F

from riskframe.operators import merge as M
from riskframe.session import keep


def test_filter_never_misses_a_known_key(spark):
    known = spark.range(4000).select((F.col("id") * 3).alias("k"))
    new = spark.range(20_000).withColumnRenamed("id", "k")
    marked = M.maybe_known(new, known, "k", 4000)
    got = {r.k: r._maybe for r in marked.collect()}
    assert len(got) == 20_000 and all(got[3 * i] for i in range(4000))
    assert sum(got.values()) < 4000 + 0.15 * 16_000  # about one in sixteen of the others
    assert marked.columns == ["k", "_maybe"]


def test_rows_equal_the_plain_join(spark, monkeypatch):
    ref = spark.createDataFrame([(i % 50, f"v{i % 3}") for i in range(200)] + [(None, "n"), (7, None)], "a int, b string")
    new = spark.createDataFrame([(i % 90, f"v{i % 5}", i) for i in range(600)] + [(None, "n", 1), (None, None, 2), (7, None, 3)],
                                "a int, b string, x int")
    want = sorted(map(str, new.exceptAll(new.join(ref.distinct(), new.a.eqNullSafe(ref.a) & new.b.eqNullSafe(ref.b), "left_semi")).collect()))
    for bits in (M.FILTER_BITS, 1 << 15):
        monkeypatch.setattr(M, "FILTER_BITS", bits)
        out = M.rows_to_insert(new, ref, ["a", "b"])
        assert sorted(map(str, out.collect())) == want
        assert M.known_key_count(new, ref, ["a", "b"]).first().known == new.count() - len(want)
    assert M.rows_to_insert(new, ref.limit(0), ["a", "b"]).count() == new.count()
    assert M.rows_to_insert(new.limit(0), ref, ["a", "b"]).count() == 0
    assert M.known_keys(new, ref.limit(0), ["a", "b"]).count() == 0


def test_hot_key_is_split(spark):
    """Half of the batch has one known key: Spark splits it, and rows with new keys are not shuffled."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c, None) for c in conf}
    for c, v in conf.items():
        spark.conf.set(c, v)
    try:
        new = keep(spark.range(400_000, numPartitions=8).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"),
                                               F.md5(F.col("id").cast("string")).alias("v")), "batch")
        ref = spark.range(0, 60_000).withColumnRenamed("id", "k")
        out = M.rows_to_insert(new, ref, "k")
        rows = out.collect()
        assert len(rows) == 200_000 - 30_000 and all(r.k >= 60_000 for r in rows)
        # the plan that collect() ran
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
