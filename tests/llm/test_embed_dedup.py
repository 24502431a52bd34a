"""Embedding links against brute force."""

import numpy as np
import pandas as pd

from riskframe.llm import queries
from riskframe.llm.embed_dedup import near_duplicates, plan


def brute(ids, vecs, least=0.95):
    """id -> (n_links, component, kept) for distinct ids."""
    unit = [None if v is None or len(v) == 0 or any(x is None for x in v) or not np.isfinite(np.array(v, float)).all()
            or not np.any(v) else np.array(v, float) / np.abs(np.array(v, float)).max() for v in vecs]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    links = [[j for j in range(len(ids)) if j != i and unit[i] is not None and unit[j] is not None
              and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= least] for i in range(len(ids))]
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            low = min([label[i], *(label[j] for j in links[i])])
            if low != label[i]:
                label[i], changed = low, True
    return {ids[i]: (len(links[i]), label[i], label[i] == ids[i]) for i in range(len(ids))}


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    t = pd.read_parquet(f"{sf}/embeddings.parquet").sort_values("vec_id")
    x = np.array(t.embedding.tolist(), np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    ids = label = t.vec_id.to_numpy()
    while True:
        new = np.where(near, label[None], label.max()).min(1)
        if (new == label).all():
            break
        label = new
    want = list(zip(ids, near.sum(1) - 1, label, label == ids, strict=True))
    got = queries.QUERIES["op2_embedding_dedup"](spark, sf).orderBy("vec_id").collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in got] == want


def test_planted_groups(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 48))
    vecs = [b + rng.standard_normal(48) * rng.choice([0.05, 0.15, 0.22, 0.3]) for b in base for _ in range(8)]
    vecs += [base[0]] * 40 + [base[1] * 7.5, base[1] * 1e-30, -base[1]]            # copies, scaled, opposite
    vecs += [list(rng.standard_normal(16)) for _ in range(5)] + [[1.0], [2.0], [-3.0]]  # other lengths
    vecs += [None, [], [0.0] * 48, [None] * 48, [float("nan")] + [1.0] * 47, [float("inf")] + [1.0] * 47]
    data = [(i * 3, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, h int")
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df, "vec_id", "embedding").collect()}
    assert got == brute([d[0] for d in data], [d[1] for d in data])


def test_repeated_rows_null_ids_and_empty(rows):
    df = rows("vec_id long, embedding array<float>", (1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (None, None))
    got = sorted((tuple(r) for r in near_duplicates(df, "vec_id", "embedding").collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, False)], key=str)
    assert near_duplicates(df.limit(0), "vec_id", "embedding").count() == 0


def test_tables_grow_slowly():
    for n in (10, 10**4, 10**6):
        bits, width, tables = plan(n, 0.95)
        assert 2**bits * 2 >= n / 4 and tables < 700
