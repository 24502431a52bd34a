"""Collocations: brute force on small corpora, blocks, edge rows, the query against its SQL (test_oracles)."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from riskframe.llm import collocations as C

UP = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, longest=5, share=100, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UP)):
            words = tuple(w for w in re.split("[ \t]+", piece) if w)
            n[lang] += len(words)
            f.update((lang, words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in found.items():
        if any(len(q) > len(words) and x == lang and 100 * b >= share * a
               and any(q[i:i + len(words)] == words for i in range(len(q))) for (x, q), b in found.items()):
            continue
        cut = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
        k = cut[1]
        out.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n[lang], cut[0]))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i, *r[1:]) for i, r in enumerate(mine[:top], 1)]
    return sorted(ranked)


def got(df, **more):
    return sorted(tuple(r) for r in C.collocations(df, "text", "lang", **more).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, docs=120, alphabet=6):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(alphabet)] + ["é", "ß", "of the"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!", "?", ";", ":", "\r", "\x0b"]
    out = []
    for _ in range(docs):
        text = "".join(w + rng.choice(marks) for w in rng.choices(words, k=rng.randint(0, 40)))
        out.append((rng.choice(["en", "fr", None]), text))
    return out


@pytest.mark.parametrize("least,share,words,bucket", [(3, 100, 1 << 20, 1 << 22), (12, 100, 50, 100), (3, 60, 7, 9), (10 ** 6, 100, 50, 9)])
def test_against_brute_force(rows, monkeypatch, least, share, words, bucket):
    monkeypatch.setattr(C, "BUCKET_WORDS", bucket)
    data = corpus(least)
    df = rows("lang string, text string", *data).repartition(5)
    assert got(df, least=least, share=share, block_words=words) == brute(data, least, share=share)


def test_edge_rows(rows):
    data = [(None, None), ("en", ""), ("en", " \t .!? \n"), ("en", "a b"), ("en", "a b"), ("en", "A\tB c. a b"), ("fr", "a b")]
    data += [("de", "x y " * 400_000 + "z.x y")]
    df = rows("lang string, text string, rank int, n int, id int", *[(*r, 1, 1, 1) for r in data])
    assert got(df, least=3, top=3) == brute(data, 3, top=3)
    assert got(df.limit(0), least=3) == []
    assert got(rows("lang string, text string", (None, None)), least=1) == []


def test_slices_cut_between_words(monkeypatch):
    text = "Ab cd\tef.gh  ij\nkl mn" * 5
    whole = C._Encoder()
    whole.add(text.encode())
    monkeypatch.setattr(C, "SLICE", 4)
    cut = C._Encoder()
    cut.add(text.encode())
    assert [w == c for w, c in zip(whole.row()[0], cut.row()[0], strict=True)] and (whole.row()[2] == cut.row()[2]).all()


def test_scores_pass_64_bits(rows):
    """1000 * a * n beyond 2^63 stays exact."""
    spark = rows("a int", (1,)).sparkSession
    a, n, l, r = 4 * 10 ** 11, 9 * 10 ** 12, 5 * 10 ** 11, 7 * 10 ** 11
    for a, n, l, r in ((a, n, l, r), (1, 9, 7, 1)):
        df = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
        assert df.select(C._score()).first()[0] == 1000 * a * n // (l * r)


def test_packed_numbers_come_back():
    for x in ([], [0], [-1, 2 ** 31 - 1, 5], list(range(1000))):
        assert C._unpack(C._pack(np.array(x, np.int32))).tolist() == x
