"""SimHash groups against a brute-force version."""

import re

import numpy as np
import pandas as pd
import xxhash

from riskframe.llm import queries
from riskframe.llm.simhash import blocks_for, close_pairs, simhash_groups

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, bits=3):
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= bits and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_query_matches_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    fps = [brute_fingerprint(t) for t in docs.text]
    want = list(zip(docs.doc_id, [f"{f:016x}" for f in fps], brute_components(list(docs.doc_id), fps), strict=True))
    got = queries.QUERIES["op5_simhash"](spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_edge_rows(rows):
    long = " ".join(f"w{i}" for i in range(200_000))
    df = rows("doc_id long, text string, component_id string, a int, fp int",
              (1, None, "x", 1, 1), (2, "", "x", 1, 1), (3, " \n", None, None, None), (4, "one", "x", 1, 1),
              (4, "one", "x", 1, 1), (None, "one", "x", 1, 1), (6, "ONE", "x", 1, 1), (7, long, "x", 1, 1),
              (None, long + "\n", "x", 1, 1), (9, "two x é", "x", 1, 1))
    got = simhash_groups(df, "doc_id", "text").collect()
    assert len(got) == 10
    by = sorted(((r.id, r.component_id, r.fp) for r in got), key=str)
    assert [x[:2] for x in by if x[2] == 0] == [(1, 1), (2, 1), (3, 1)]
    assert sorted((x[:2] for x in by if x[1] == 4), key=str) == [(4, 4), (4, 4), (6, 4), (None, 4)]
    assert sorted((x[:2] for x in by if x[1] == 7), key=str) == [(7, 7), (None, 7)]
    assert {x[2] & (2**64 - 1) for x in by if x[0] == 7} == {brute_fingerprint(long)}
    assert simhash_groups(df.limit(0), "doc_id", "text").count() == 0


def test_every_block_count_and_chunking_gives_the_same_components(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    fps = {int(b) ^ sum(1 << int(x) for x in rng.integers(0, 63, rng.integers(0, 7))) for b in base for _ in range(6)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = brute_components(fps, [f & (2**64 - 1) for f in fps])
    for n, chunk in ((10, 2048), (10, 5), (1 << 20, 2048), (1 << 34, 3)):
        links = [tuple(r) for r in close_pairs(df, n, 3, chunk).collect()]
        label = {f: f for f in fps}
        for _ in range(len(fps)):
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
            if all(label[a] == label[b] for a, b in links):
                break
        assert [label[f] for f in fps] == want
    assert [blocks_for(n, 3) for n in (10, 1 << 20, 1 << 30, 1 << 34)] == [4, 5, 6, 7]


def test_python_gets_only_the_texts(spark):
    from pyspark.sql import functions as F

    from riskframe.llm.simhash import fingerprints
    df = spark.createDataFrame([(1, "a b c d", "x"), (2, None, "y")], "doc_id long, text string, lang string")
    out = fingerprints(df, "text", 3, doc=F.struct("*"), id=F.col("doc_id"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    assert {(r.id, r.doc.lang, r.fp == 0) for r in out.collect()} == {(1, "x", False), (2, "y", True)}
