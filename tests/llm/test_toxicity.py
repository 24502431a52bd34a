"""Toxicity: the machine learns interactions, held-out quality, edge rows."""

import zlib

import numpy as np
import pandas as pd

from riskframe.llm import common, queries, toxicity


def test_machine_learns_an_interaction_that_weights_cannot():
    rng = np.random.default_rng(0)
    rows, label = [], []
    for _ in range(4000):  # toxic if and only if exactly both or none of two terms are there
        a, b = rng.random(2) < 0.5
        rows.append([i for i, x in ((0, a), (1, b)) if x] + [2 + int(rng.integers(20))])
        label.append(float(a == b))
    label = np.array(label)
    bias, w, v = toxicity.fit_machine(*toxicity._flat(rows), label, 22)
    score = toxicity.ToxicityModel(bias, list(range(22)), w, v).logits(rows)
    assert ((score > 0) == (label == 1)).mean() > 0.97


def test_logits_are_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = toxicity.ToxicityModel(0.3, list(range(6)), rng.normal(size=6), rng.normal(size=(6, toxicity.FACTORS)))
    rows = [[], [2], [0, 3, 5], list(range(6))]
    want = [0.3 + sum(m.weight[i] for i in r) + sum(m.factor[i] @ m.factor[j] for i in r for j in r if i < j) for r in rows]
    assert np.allclose(m.logits(rows), want)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.QUERIES["op8_toxicity"](spark, sf).toPandas()
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    assert len(out) == len(pd.read_parquet(f"{sf}/documents.parquet", columns=["doc_id"]))
    assert out.score.between(0, 1).all() and ((out.score >= 0.5).astype(int) == out.predicted).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    held = out[out.held_out].merge(labels, on="doc_id")
    rank = held.score.rank()
    pos = held.toxic == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.97
    assert ((held.predicted == 1) & ~pos).sum() <= 0.01 * (~pos).sum()


def test_edge_rows(rows):
    docs = rows("doc_id long, text string, score int", *[(i, "you idiot scum" if i % 4 == 0 else "a calm note", 1) for i in range(200)])
    labels = rows("doc_id long, toxic int", *[(i, int(i % 4 == 0)) for i in range(200)], (None, 1), (3, None), (5, 7))
    model = toxicity.train(docs, "doc_id", "text", labels, "doc_id", "toxic")
    long = "calm " * 300_000 + "idiot scum"
    df = rows("doc_id long, text string, score int", (1, None, 1), (2, "", 1), (2, "", 1), (None, "IDIOT, scum!", 1), (4, long, 1), (5, "note", 1))
    got = {(r.id, r.score >= 0.5) for r in toxicity.score(df, "doc_id", "text", model).collect()}
    assert got == {(1, False), (2, False), (None, True), (4, True), (5, False)}
    assert toxicity.score(df.limit(0), "doc_id", "text", model).count() == 0
    for some, share in ((labels.where("toxic = 1"), True), (labels.where("toxic = 0"), False), (labels.limit(0), False)):
        one = toxicity.train(docs, "doc_id", "text", some, "doc_id", "toxic")
        assert {r.score >= 0.5 for r in toxicity.score(df, "doc_id", "text", one).collect()} == {share}


def test_fit_bound_is_kept_with_repeated_ids(rows):
    """Also where one id stands on half of all documents, or twice among the labels."""
    docs = rows("doc_id long, text string", *[(i if i < 200 else 7, f"w{i % 2}") for i in range(400)])
    labels = rows("doc_id long, toxic int", *[(i, i % 2) for i in range(200)], (7, 0))
    for most in (1, 30, 150):
        sample = common.lowest(common.labelled_sample(docs, "doc_id", "text", labels, "doc_id", "toxic", most), most)
        assert most // 2 <= sample.count() <= most
    assert common.labelled_sample(docs, "doc_id", "text", labels, "doc_id", "toxic", 10_000).count() == 199 + 2 * 201
    few = rows("doc_id long, toxic int", (7, 1), (8, 0), (9, 0), (10, 0))
    assert common.lowest(common.labelled_sample(docs, "doc_id", "text", few, "doc_id", "toxic", 4), 4).count() <= 4


def test_train_learns_an_interaction_of_terms_that_tell_nothing_alone(rows):
    rng = np.random.default_rng(0)
    docs, labels = [], []
    for i in range(4000):  # toxic if and only if both or none of two terms are there
        a, b = i % 2, i // 2 % 2
        docs.append((i, " ".join(["group"] * a + ["harm"] * b + [f"w{x}" for x in rng.integers(0, 60, 6)])))
        labels.append((i, int(a == b)))
    df = rows("doc_id long, text string", *docs)
    model = toxicity.train(df, "doc_id", "text", rows("doc_id long, toxic int", *labels), "doc_id", "toxic")
    score = {r.id: r.score for r in toxicity.score(df, "doc_id", "text", model).collect()}
    assert np.mean([(score[i] >= 0.5) == (t == 1) for i, t in labels]) > 0.97


def test_texts_without_a_label_are_not_shuffled(spark):
    from riskframe.llm.common import labelled_sample
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 4000, 4)], "doc_id long, toxic int")
    out = labelled_sample(docs, "doc_id", "text", labels, "doc_id", "toxic", 100)
    assert 60 < out.count() < 190 and out.where("cast(id as int) % 4 <> 0").isEmpty()
    assert "_maybe" in out._jdf.queryExecution().toString()  # ruled out by a filter before the join
