"""Insert-if-new on Spark's state store: restarts, late keys, bounded state."""

from pyspark.sql import functions as F

from riskframe.plans.registry import ORACLES, QUERIES, load_all
from riskframe.session import scratch_path
from riskframe.streaming import jobs as ST
from tools.oracle_check import duck, frame_hash

SCHEMA = "k long, at timestamp, v string"


def _run(spark, folders, rows, reference=None):
    path, out, ckpt = folders
    df = spark.createDataFrame([(k, f"2024-01-{d:02d} {h:02d}:00:00", v) for k, d, h, v in rows], "k long, at string, v string")
    df.select("k", F.col("at").cast("timestamp"), "v").coalesce(1).write.mode("append").parquet(path)
    reference = reference if reference is not None else spark.createDataFrame([], "k long")
    q = ST.insert_new_within_watermark(ST.file_stream(spark, path, SCHEMA), reference, "k", "at", "6 hours", out, ckpt)
    q.awaitTermination()
    return q


def _found(spark, out, name):
    return sorted((r.k, r.v) for r in spark.read.schema("k long, at timestamp, v string, batch int").parquet(f"{out}/{name}").collect())


def test_late_keys_once_and_restarts(spark):
    folders = [scratch_path(spark, n) for n in ("landing", "out", "ckpt")]
    ref = spark.createDataFrame([(100,), (None,)], "k long")
    _run(spark, folders, [(1, 1, 0, "a"), (1, 1, 1, "b"), (2, 1, 2, "c"), (100, 1, 2, "ref"), (None, 1, 2, "null")], ref)
    accepted = _found(spark, folders[1], "accepted")
    assert [k for k, _ in accepted] == [1, 2]
    # known to the state: not again; a new key in time; the watermark moves on to day 4
    _run(spark, folders, [(2, 1, 3, "again"), (3, 1, 2, "d"), (4, 4, 12, "e")], ref)
    assert [k for k, _ in _found(spark, folders[1], "accepted")] == [1, 2, 3, 4] and _found(spark, folders[1], "late") == []
    # late and never seen: set aside; late but accepted or in the reference: nothing
    _run(spark, folders, [(5, 1, 5, "late"), (5, 1, 6, "late twice"), (1, 1, 9, "old"), (100, 1, 9, "ref")], ref)
    late = _found(spark, folders[1], "late")
    assert [k for k, _ in late] == [5]
    # the same late key in a later micro-batch is not set aside again, a new late one is
    _run(spark, folders, [(5, 1, 7, "late again"), (6, 1, 7, "late too"), (7, 4, 13, "f")], ref)
    assert [k for k, _ in _found(spark, folders[1], "late")] == [5, 6] and late[0] in _found(spark, folders[1], "late")
    assert [k for k, _ in _found(spark, folders[1], "accepted")] == [1, 2, 3, 4, 7]


def test_state_is_bounded_and_in_rocksdb(spark):
    folders = [scratch_path(spark, n) for n in ("landing", "out", "ckpt")]
    sizes = []
    for day in range(1, 7):
        q = _run(spark, folders, [(day * 100 + i, day, 1 + i % 4, "x") for i in range(40)])
        state = [s for p in q.recentProgress for s in p["stateOperators"]]
        sizes.append(state[-1]["numRowsTotal"])
        assert any("rocksdb" in k for k in state[-1]["customMetrics"])
    assert max(sizes) <= 80 and sizes[-1] <= 80 and len(_found(spark, folders[1], "accepted")) == 240
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != ST.ROCKSDB


def test_query_and_oracle(spark):
    load_all()
    sf = "/root/testdata/sf0.01"
    out = QUERIES["str2_stream_insert_state"](spark, sf)
    res = duck(sf).execute(ORACLES["str2_stream_insert_state"])
    columns, want = [d[0] for d in res.description], res.fetchall()
    rows = [tuple(r) for r in out.collect()]
    late = [r for r in want if r[columns.index("late")]]
    assert len(rows) == len(want) and 0 < len(late) < len(want)
    assert frame_hash(out.columns, rows)[0] == frame_hash(columns, want)[0]
