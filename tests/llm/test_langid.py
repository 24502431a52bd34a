"""Language models: Kneser-Ney against a direct version, held-out accuracy, edge rows."""

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.llm import langid, queries


def direct(texts, symbol_count=1 << langid.SYMBOL_BITS):
    """Interpolated Kneser-Ney probability of (context, symbol) from plain dictionaries."""
    counts = {langid.ORDER: Counter()}
    for t in texts:
        s = "".join(c if c.isalpha() else " " for c in t.lower())
        s = " " * (langid.ORDER - 1) + " ".join(s.split(" ")).strip() + " "
        while "  " in s[langid.ORDER - 1:]:
            s = s[:langid.ORDER - 1] + s[langid.ORDER - 1:].replace("  ", " ")
        for i in range(langid.ORDER - 1, len(s)):
            counts[langid.ORDER][s[i - langid.ORDER + 1:i + 1]] += 1
    for n in range(langid.ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount, total, types = {}, {}, {}
    for n, c in counts.items():
        levels = Counter(c.values())
        discount[n] = levels[1] / (levels[1] + 2 * levels[2]) if levels[1] and levels[2] else 0.5
        total[n], types[n] = defaultdict(int), defaultdict(int)
        for g, k in c.items():
            total[n][g[:-1]] += k
            types[n][g[:-1]] += 1

    def p(g):
        if not g:
            return 1 / symbol_count
        n, d = len(g), discount[len(g)]
        low = p(g[1:])
        if not total[n][g[:-1]]:
            return low
        return (max(counts[n][g] - d, 0) + d * types[n][g[:-1]] * low) / total[n][g[:-1]]

    return p


def key_of(g):
    key = 0
    for c in g:
        key = key << langid.SYMBOL_BITS | (ord(c) if c != " " else 0)
    return key


def test_model_equals_direct_kneser_ney(spark):
    texts = ["the cat sat on the mat", "the dog, the hat! and the cat", "a cat and a dog", "on and on the dog sat"]
    df = spark.createDataFrame([(t, "en") for t in texts] + [("der hund und die katze", "de")], "text string, lang string")
    model = langid.train(df, "text", "lang")
    p = direct(texts)
    for g in (" the ", "the c", "e cat", "    t", "zzzzz", "the z", "xythe", "at   "[:5], "d the"):
        want = p(g)
        got = float(np.exp(model.log_probs("en", np.array([key_of(g)]))[0]))
        assert got == pytest.approx(want, rel=1e-9), g
    # probabilities of all continuations of a context add up to one
    symbols = np.arange(1 << langid.SYMBOL_BITS, dtype=np.int64)
    for c in ("the ", "    ", "zzzz"):
        assert np.exp(model.log_probs("en", (key_of(c) << langid.SYMBOL_BITS) | symbols)).sum() == pytest.approx(1, abs=1e-6)


def test_held_out_accuracy_and_rejection(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.QUERIES["op7_language"](spark, sf).toPandas()
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    both = out.merge(docs, on="doc_id")
    assert len(out) == len(docs) and out.score.between(0, 1).all()
    import zlib
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]).all()
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert both.rejected.mean() < 0.01


def test_edge_rows(spark, rows):
    train = rows("text string, lang string", *[("the cat sat on the mat and the dog", "en")] * 3,
                 *[("der hund und die katze auf der matte", "de")] * 3, (None, "en"), ("le chat", None), ("", "fr"))
    model = langid.train(train, "text", "lang")
    assert model.langs == ["de", "en"]  # an empty text teaches no language
    long = "the cat " * 200_000
    df = rows("doc_id long, text string, lang int, score string", (1, None, 1, "x"), (2, "", 1, "x"), (3, " 12 -- 👍", 1, "x"),
              (4, "THE CAT", 1, "x"), (None, "die katze", 1, "x"), (4, "THE CAT", 1, "x"), (6, long, 1, "x"),
              (7, "qxzjvkq wxqzjk vvqxw jqxz", 1, "x"))
    got = sorted((tuple(r) for r in langid.identify(df, "doc_id", "text", model).collect()), key=str)
    by = {g[0]: g for g in got}
    assert len(got) == 8
    assert all(by[i][1:] == ("und", 0.0, None, True) for i in (1, 2, 3))
    assert by[4][1] == by[6][1] == "en" and by[None][1] == "de" and not by[6][4]
    assert by[7][4] and not by[4][4]
    nothing = langid.train(train.limit(0), "text", "lang")
    assert {r.lang for r in langid.identify(df, "doc_id", "text", nothing).collect()} == {"und"}
    assert langid.identify(df.limit(0), "doc_id", "text", model).count() == 0


def test_pruned_model_still_sums_to_one(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdef  "), 400)) for _ in range(20)]
    df = spark.createDataFrame([(t, "x") for t in texts], "text string, lang string")
    model = langid.train(df, "text", "lang", max_grams=60)
    assert all(len(o.keys) <= 60 for o in model.orders["x"])
    symbols = np.arange(1 << langid.SYMBOL_BITS, dtype=np.int64)
    total = np.exp(model.log_probs("x", (key_of("abab") << langid.SYMBOL_BITS) | symbols)).sum()
    assert total == pytest.approx(1, abs=0.2)


def test_model_keeps_every_gram_and_grows_with_the_input(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrst "), 50_000)) for _ in range(4)]
    sizes = []
    for n in (2, 4):
        df = spark.createDataFrame([(t, "x") for t in texts[:n]], "text string, lang string")
        model = langid.train(df, "text", "lang")
        want = np.unique(langid.grams(texts[:n])[0])
        assert (model.orders["x"][-1].keys == want).all()
        sizes.append(len(want))
    assert 60_000 < sizes[0] < sizes[1]


def test_dropped_mass_goes_to_the_back_off(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdef  "), 400)) for _ in range(20)]
    df = spark.createDataFrame([(t, "x") for t in texts], "text string, lang string")
    symbols = np.arange(1 << langid.SYMBOL_BITS, dtype=np.int64)
    for most in (6, 60, 300):
        model = langid.train(df, "text", "lang", max_grams=most)
        assert all(len(o.keys) <= most for o in model.orders["x"])
        for c in ("abab", "    ", "fa b", "zzzz"):
            total = np.exp(model.log_probs("x", (key_of(c) << langid.SYMBOL_BITS) | symbols)).sum()
            assert total == pytest.approx(1, abs=1e-9)


def test_every_training_row_counts_for_the_rejection_limit(spark):
    rng = np.random.default_rng(3)
    words = lambda letters, n: [" ".join("".join(rng.choice(list(letters), 4)) for _ in range(8)) for _ in range(n)]
    small = ["qxzj qxzj qxzj qxzj"] * 9 + words("qxzjvkwy", 3)
    df = spark.createDataFrame([(t, "big") for t in words("abcdefgh", 3000)], "text string, lang string")
    df = df.crossJoin(spark.range(100)).drop("id")  # 12 rows of the other language beside 300,000
    model = langid.train(df.union(spark.createDataFrame([(t, "small") for t in small], df.schema)), "text", "lang")
    lang, _, entropy, _ = model.predict(small)
    own = sorted(e for e, x in zip(entropy, lang, strict=True) if x == "small")
    mid, high = own[-(-len(own) // 2) - 1], own[-(-95 * len(own) // 100) - 1]
    uniform = np.log(len(model.orders["small"][0].keys))
    assert len(own) == 12 and mid + langid.REJECT_FACTOR * (high - mid) > uniform
    assert model.limits["small"] == pytest.approx(max(uniform, mid + langid.REJECT_FACTOR * (high - mid)), rel=1e-9)
    assert set(model.limits) == {"big", "small"}
