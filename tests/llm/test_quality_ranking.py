"""Quality ranking: features against plain Python, pairs, the planted order, held-out quality, edge rows."""

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa

from riskframe.llm import quality_ranking as Q
from riskframe.llm import queries


def plain(text):
    """FEATURES of one text, byte by byte."""
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    lines = [x for x in data.split(b"\n") if x]
    kind = {k: sum(Q._CLASS[c] == k for c in data) for k in range(7)}

    def count(w, k):
        return sum(Q._CLASS[c] == k for c in w)

    flags = {"symbol_words": [count(w, Q._SYMBOL) > 0 for w in words],
             "bare_words": [count(w, Q._UPPER) + count(w, Q._LETTER) == 0 for w in words],
             "shout_words": [count(w, Q._SHOUT) > 0 for w in words],
             "capital_words": [count(w, Q._UPPER) > 1 and count(w, Q._LETTER) <= count(w, Q._UPPER) for w in words],
             "short_words": [len(w) <= 3 for w in words]}
    n = max(len(words) // Q.WINDOW_WORDS, 1)
    cuts = [slice(i * Q.WINDOW_WORDS, None if i == n - 1 else (i + 1) * Q.WINDOW_WORDS) for i in range(n)]
    div = lambda a, b: a / max(b, 1)
    out = {k: div(sum(f), len(words)) for k, f in flags.items()}
    out |= {"worst_" + k: (min if k == "short_words" else max)(div(sum(f[c]), len(f[c])) for c in cuts) for k, f in flags.items()}
    distinct = [div(len(set(words[c])), len(words[c])) for c in cuts]
    out |= {"distinct_words": sum(distinct) / n, "worst_distinct_words": min(distinct), "distinct_lines": div(len(set(lines)), len(lines)),
            "line_words": np.log1p(div(len(words), len(lines))), "words": np.log1p(len(words)),
            "word_bytes": np.log1p(div(sum(map(len, words)), len(words))),
            "capitals": div(kind[Q._UPPER], kind[Q._UPPER] + kind[Q._LETTER]), "digits": div(kind[Q._DIGIT], len(data)) ** 0.5,
            "symbols": div(kind[Q._SYMBOL], len(data)) ** 0.5, "marks": div(kind[Q._MARK], len(words)),
            "shouts": div(kind[Q._SHOUT], len(words))}
    return [out[k] for k in Q.FEATURES]


def test_features_of_whole_texts():
    rng = np.random.default_rng(3)
    letters = list("abAB é1!.#|  \n\t漢")
    texts = ["", None, " \n ", "x", "\n", *["".join(rng.choice(letters, int(k))) for k in rng.integers(1, 900, 60)], "", "ab ab\nab ab"]
    texts += [" ".join(rng.choice(["The", "a", "###", "GO!!", "12"], 700)), "w" * 50_000 + " w"]
    got = Q.text_features(pa.array(texts))
    assert np.allclose(got, [plain(t) for t in texts])
    assert np.allclose(Q.text_features(pa.array(texts).slice(3, 9)), got[3:12])
    assert Q.text_features(pa.array([], pa.string())).shape == (0, len(Q.FEATURES))


def test_hashes_do_not_depend_on_the_place(monkeypatch):
    monkeypatch.setattr(Q, "_SEGMENT", 8)
    Q._powers.cache_clear()
    data = np.frombuffer(b"ab cde ab a long word of abcdefghij and abcdefghij ab", np.uint8)
    start, end = Q._runs(data != 32, np.r_[True, np.zeros(len(data) - 1, bool)])
    words = bytes(data).split()
    h = Q._hashes(data, start, end)
    Q._powers.cache_clear()
    assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))


def test_every_document_meets_others(rows):
    sample = rows("label int, nr long, x array<double>", *[(1, i, [1.0, float(i)]) for i in range(7)], *[(0, i, [0.0, 0.0]) for i in range(3)])
    pairs = Q.preference_pairs(sample, 3, 7, 4).collect()
    assert len(pairs) == 28 and all(abs(r.d[0]) == 1 and (r.d[0] > 0) == (r.first == 1) for r in pairs)
    met = pd.Series([abs(r.d[1]) for r in pairs]).value_counts()
    assert len(met) == 7 and (met == 4).all()
    assert {r.first for r in pairs} == {0.0, 1.0}
    swapped = rows("label int, nr long, x array<double>", *[(0, i, [0.0, float(i)]) for i in range(7)], *[(1, i, [1.0, 0.0]) for i in range(3)])
    met = pd.Series([abs(r.d[1]) for r in Q.preference_pairs(swapped, 7, 3, 4).collect()]).value_counts()
    assert len(met) == 7 and met.max() == 4


def test_weights_follow_the_preference_model(rows):
    """Documents whose label is drawn from sigmoid differences are ranked by the planted weights."""
    rng = np.random.default_rng(1)
    planted = np.r_[2.0, -1.0, 0.5]
    x = rng.normal(size=(3000, 3))
    label = (x @ planted + rng.logistic(size=3000) > 1).astype(int)
    found = rows("id long, x array<double>", *[(i, v.tolist()) for i, v in enumerate(x)])
    labels = rows("id long, label int", *[(i, int(y)) for i, y in enumerate(label)])
    w = np.array(Q.train(found, labels, "id", "label").weight)
    assert np.corrcoef(x @ w, x @ planted)[0, 1] > 0.995


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.QUERIES["op13_quality"](spark, sf).toPandas()
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    assert len(out) == len(pd.read_parquet(f"{sf}/documents.parquet", columns=["doc_id"]))
    assert out.score.between(0, 1).all() and ((out.score >= 0.3).astype(int) == out.predicted).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    held = out[out.held_out].merge(labels, on="doc_id")
    pos = held.quality == 1
    rank = held.score.rank()
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.995
    assert ((held.predicted == 0) & pos).sum() <= 0.01 * pos.sum()
    assert ((held.predicted == 1) & ~pos).sum() <= 0.05 * (~pos).sum()


def test_edge_rows(rows):
    docs = rows("doc_id long, text string, score int", *[(i, "### *** ### ***" if i % 4 == 0 else f"a calm note number {i} of many.", 1) for i in range(200)])
    labels = rows("doc_id long, quality int", *[(i, int(i % 4 != 0)) for i in range(200)], (None, 1), (3, None), (5, 7), (6, 0), (6, 1))
    long = "a calm note " * 300_000
    more = rows("doc_id long, text string, score int", (None, "*** ### ***", 1), (1000, None, 1), (1000, None, 1), (1001, "", 1), (1002, long, 1))
    got = {(r.id, r.score >= 0.3) for r in Q.rank_documents(docs.unionAll(more), "doc_id", "text", labels, "doc_id", "quality").collect()}
    assert {(None, False), (4, False), (1, True)} <= got
    empty = Q.rank_documents(more, "doc_id", "text", labels, "doc_id", "quality").collect()
    assert len(empty) == 5 and {r.score for r in empty} == {0.0}
    assert Q.rank_documents(docs.limit(0), "doc_id", "text", labels, "doc_id", "quality").count() == 0
    for some, share in ((labels.where("quality = 1"), 1.0), (labels.where("quality = 0"), 0.0)):
        assert {r.score for r in Q.rank_documents(docs, "doc_id", "text", some, "doc_id", "quality").collect()} == {share}


def test_fit_bound_holds_with_repeated_ids(rows):
    found = rows("id long, x array<double>", *[(i % 4, [float(i % 2), float(i)]) for i in range(4000)])
    assert Q.bounded_draw(found, 50, 4000).count() <= 50
    assert Q.bounded_draw(found.limit(30), 50, 30).count() == 30
