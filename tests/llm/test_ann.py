"""Neighbour search: recall against brute force, exact scores, edge rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riskframe.llm import queries
from riskframe.llm.ann import beam_search, build_graph, nearest


def test_query_recall_and_order(spark):
    sf = "/root/testdata/sf0.1"
    t = pd.read_parquet(f"{sf}/embeddings.parquet").sort_values("vec_id")
    ids, x = t.vec_id.to_numpy(), np.array(t.embedding.tolist(), np.float64)
    got = queries.QUERIES["op10_neighbours"](spark, sf).toPandas()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and mine.vec_id.is_unique
        dist = dict(zip(ids, d, strict=True))
        assert np.allclose([dist[v] for v in mine.vec_id], mine.score, rtol=1e-12, atol=1e-12)
        assert sorted(zip(mine.score, mine.vec_id, strict=True)) == list(zip(mine.score, mine.vec_id, strict=True))
        hits += len(set(mine.vec_id) & set(ids[order]))
        total += 10
    assert hits / total >= 0.95


def test_recall_of_a_full_shard():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4096, 64)).astype(np.float32)
    graph, start = build_graph(x)
    queries_ = x[:100]
    found, _ = beam_search(x, graph, start, queries_, 160)
    true = np.argsort(((x[None] - queries_[:, None]) ** 2).sum(2), 1)[:, :10]
    assert np.mean([len(set(f[:10]) & set(t)) / 10 for f, t in zip(found, true, strict=True)]) >= 0.9


def test_copies_ties_and_bad_vectors(rows):
    data = [(100, [0.0, 1.0]), (1, [0.0, 1.0]), *[(200 + i, [5.0, 5.0]) for i in range(1, 40)], (7, [1e30, 0.0]),
            (300, None), (400, [0.0, 0.0]), (500, [float("nan"), 1.0]), (600, [1.0]), (None, [0.0, 1.0]), (8, []),
            (1, [0.0, 1.0]), (9, [None, 1.0])]
    df = rows("vec_id long, embedding array<double>, score int", *[(i, v, 1) for i, v in data])
    got = nearest(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0).collect()
    assert {r.query_id for r in got} == {100}
    mine = sorted((r["rank"], r.vec_id, r.score) for r in got)
    far = float(np.sqrt(25.0 + 16.0))
    assert mine == [(1, 1, 0.0)] + [(k + 2, 201 + k, far) for k in range(9)]
    assert nearest(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 100 == 0).count() == 0
    few = nearest(df.where("vec_id in (100, 1)"), "vec_id", "embedding", F.col("vec_id") % 100 == 0).collect()
    assert [(r["rank"], r.vec_id) for r in few] == [(1, 1)]


def test_repeated_rows_do_not_use_up_the_ids_of_a_vector(rows):
    data = [(5, [1.0, 2.0])] * 11 + [(i, [1.0, 2.0]) for i in range(6, 21)] * 2 + [(100, [1.0, 3.0])]
    df = rows("vec_id long, embedding array<double>", *data)
    got = nearest(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(i + 1, 5 + i, 1.0) for i in range(10)]


def test_a_huge_vector_as_row_and_as_query_spoils_no_other(rows):
    rng = np.random.default_rng(4)
    x = {i: rng.standard_normal(4).tolist() for i in range(1, 900)} | {950: [1e30, 0.0, 0.0, 0.0], 1000: [1e30, 1e30, 0.0, 0.0]}
    df = rows("vec_id long, embedding array<double>", *x.items())
    got = nearest(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0).collect()
    hits = total = 0
    for q in (i for i in x if i % 100 == 0):
        d = {i: float(np.sqrt(((np.array(v) - np.array(x[q])) ** 2).sum())) for i, v in x.items() if i != q}
        want = sorted((s, i) for i, s in d.items())[:10]
        mine = sorted((r.score, r.vec_id) for r in got if r.query_id == q)
        if q == 1000:
            assert [i for _, i in mine] == [i for _, i in want]
        hits, total = hits + len({i for _, i in mine} & {i for _, i in want}), total + 10
    assert hits / total >= 0.95


def test_shards_grow_and_neither_index_nor_queries_are_copied(spark, tmp_path, monkeypatch):
    from riskframe.llm import ann
    monkeypatch.setattr(ann, "SHARD", 16)  # many shards, several files and blocks of queries, two lengths
    rng = np.random.default_rng(6)
    data = [(i, rng.standard_normal(8 if i % 3 else 5).tolist()) for i in range(1500)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    scratch, plans, keep = ann.Scratch(spark, "neighbours"), [], ann.Scratch.keep
    monkeypatch.setattr(ann.Scratch, "keep", lambda self, d, what, *a: plans.append(d) or keep(self, d, what, *a))
    index = ann.build_index(df, "vec_id", "embedding", 3, scratch)
    per = index.groupBy("dims", "shard").count().groupBy("dims").agg(F.count("*").alias("shards"), F.sum("count").alias("n")).collect()
    assert {(r.dims, r.shards, r.n) for r in per} == {(8, 2, 1000), (5, 2, 500)}  # 506 and 358 vectors, not 16, in a shard
    got = ann.search(index, df, "vec_id", "embedding", 3, scratch).collect()
    assert all("Join" not in d._jdf.queryExecution().executedPlan().toString() for d in plans[-2:])
    assert len(got) == 3 * len(data) and len({(r.query_id, r["rank"]) for r in got}) == len(got)
    x, hits = dict(data), 0
    for q in range(0, 1500, 50):
        want = sorted((float(np.sqrt(((np.array(v) - np.array(x[q])) ** 2).sum())), i) for i, v in x.items() if i != q and len(v) == len(x[q]))[:3]
        hits += len({i for _, i in want} & {r.vec_id for r in got if r.query_id == q})
    assert hits / 90 >= 0.95
