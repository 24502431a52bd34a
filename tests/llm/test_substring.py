"""Substring de-duplication against a brute-force version."""

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from riskframe.llm import queries, substring
from riskframe.llm.substring import Parse, remove_repeats, word_hashes

SF = "/root/testdata/sf0.001"


def brute(texts, window=35):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(d[i:i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = [False] * len(d)
        for i in range(len(d) - window + 1):
            if seen[tuple(d[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((len(d), sum(gone), " ".join(w for w, g in zip(d, gone, strict=True) if not g)))
    return out


def test_query_matches_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    want = [(i, n, r, hashlib.sha256(k.encode()).hexdigest())
            for i, (n, r, k) in zip(docs.doc_id, brute(docs.text), strict=True)]
    got = queries.QUERIES["op6_substring"](spark, SF).orderBy("doc_id")
    assert [tuple(r) for r in got.collect()] == want
    assert sum(w[2] for w in want) > 0


@pytest.mark.parametrize("many", [1, 3, substring.MANY])
def test_planted_passages(rows, many, monkeypatch):
    monkeypatch.setattr(substring, "MANY", many)
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage, line = word(60), word(20)
    texts = [word(50) + passage + word(50) for _ in range(4)]          # shared passage, other surroundings
    texts += [passage[:35] + word(9), word(3) + passage[25:], passage[1:35]]  # its ends; one word too short
    texts += [word(10) + line + word(40) + line, line * 5]               # short line; repeats inside a document
    texts += [["a"] * 100, ["b"] * 35, ["c"] * 36, word(34)]             # periodic; overlapping windows
    overlap = word(80)
    texts += [overlap[:50] + word(20), word(20) + overlap[30:], overlap]  # two factors that overlap
    texts = [" ".join(t) for t in texts] + [None, "", "  ", "\n".join(passage)]
    df = rows("doc_id long, text string, kept int, size string, key string",
              *[(i, t, 1, "x", "y") for i, t in enumerate(texts)])
    got = remove_repeats(df, "doc_id", "text").orderBy("id").collect()
    assert [(r.n_words, r.n_removed, r.kept) for r in got] == brute(texts)
    for r, t in zip(got, texts, strict=True):
        words = (t or "").split()
        for s in reversed(r.spans):
            del words[s.start:s.start + s.length]
        assert " ".join(words) == r.kept


def test_repeated_rows_null_ids_and_empty(rows):
    text = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"x{i}" for i in range(100_000))
    df = rows("doc_id long, text string", (1, text), (1, text), (None, "short one"), (3, long))
    got = sorted(((r.id, r.n_words, r.n_removed) for r in remove_repeats(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(1, 40, 40), (1, 40, 40), (None, 2, 0), (3, 100_000, 0)], key=str)
    assert remove_repeats(df.limit(0), "doc_id", "text").count() == 0


def test_every_window_has_its_anchor():
    rng = np.random.default_rng(0)
    docs = [word_hashes(" ".join(map(str, rng.integers(0, 5, n))).encode()) for n in (0, 3, 35, 36, 500, 34, 90)]
    p = Parse(docs, 35)
    for k, d in enumerate(docs):
        pos = p.positions()[p.doc == k]
        for s in range(len(d) - 34):
            assert ((pos >= s) & (pos <= s + 35 - 12)).any()
        if len(d) < 35:
            assert not len(pos)


def test_windows_that_no_mask_can_hold_are_refused(rows):
    text = " ".join(f"w{i}" for i in range(90))
    df = rows("doc_id long, text string", (1, text), (2, text))
    most = substring.GRAM + 63
    assert {r.n_removed for r in remove_repeats(df, "doc_id", "text", window=most).collect()} == {90}
    with pytest.raises(ValueError):
        remove_repeats(df, "doc_id", "text", window=most + 1)
