"""k-d shards: near-equal bytes, whole groups, gapless slots."""

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd

from riskframe.llm import queries
from riskframe.llm.sharding import GROUP_SHARE, kd_shards


def check(got, texts, shards):
    """got: rows (id, size, crc, shard, slot); texts: the input rows (id, text)."""
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == want
    slots, sizes = defaultdict(list), np.zeros(shards)
    for _, size, _, shard, slot in got:
        slots[shard].append(slot)
        sizes[shard] += size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))
    return sizes


def test_query_balances_bytes(spark):
    sf = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    out = queries.QUERIES["op1_kd_shards"](spark, sf)
    got = out.collect()
    sizes = check([(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got],
                  zip(docs.doc_id, docs.text, strict=True), 40)
    biggest = docs.text.str.len().max()
    assert abs(sizes - sizes.mean()).max() <= biggest
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_even_rows_balance_closely_and_groups_stay_whole(spark):
    rng = np.random.default_rng(0)
    data = []
    for i in range(6000):
        n = int(rng.integers(20, 60))
        data.append((i, "x" * n + str(rng.integers(10**9)), str(rng.integers(4)), f"s{rng.integers(9)}", n))
    data += [(10**6 + i, f"copy {i % 50}", "a", f"s{i % 9}", i) for i in range(300)]     # 50 groups of 6
    data += [(2 * 10**6 + i, "hot " * 10, "a", "s1", 40) for i in range(3000)]           # a third of all rows
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = kd_shards(df, "doc_id", "text", ["lang", "source", "n_chars"], shards=7).collect()
    sizes = check([tuple(r) for r in got], [(d[0], d[1]) for d in data], 7)
    assert sizes.max() / sizes.mean() < 1 + GROUP_SHARE and sizes.min() / sizes.mean() > 1 - GROUP_SHARE
    shard = {r.id: r.shard for r in got}
    for g in range(50):
        assert len({shard[10**6 + i] for i in range(g, 300, 50)}) == 1
    again = kd_shards(df, "doc_id", "text", ["lang", "source", "n_chars"], shards=7).collect()
    assert {(r.id, r.shard) for r in again} == {(r.id, r.shard) for r in got}


def test_target_bytes_and_edge_rows(rows):
    data = [(1, None, None, None), (1, None, None, None), (None, "", "x", 3), (4, "é" * 100_000, None, -5), (5, "a", "y", None)]
    df = rows("doc_id long, text string, size string, p0 long", *data)
    got = kd_shards(df, "doc_id", "text", ["size", "p0"], shards=3).collect()
    check([tuple(r) for r in got], [d[:2] for d in data], 3)
    assert kd_shards(df.limit(0), "doc_id", "text", ["size", "p0"], shards=3).count() == 0
    one = kd_shards(df, "doc_id", "text", ["size"], target_bytes=1 << 30).collect()
    assert {r.shard for r in one} == {0}
    many = kd_shards(df, "doc_id", "text", ["size"], target_bytes=1000).collect()
    assert len(many) == 5


def test_plan_has_no_python(spark):
    df = queries.QUERIES["op1_kd_shards"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
