"""Packing: every token once, no bin too full, near-optimal on small cases."""

from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from riskframe.llm import queries
from riskframe.llm.packing import LENGTHS, best_fit, cost, pack

SF = "/root/testdata/sf0.001"


def check(out, n_tokens, lengths):
    """out: rows (id, piece, start, length, bin_id, capacity, offset)."""
    by_row = defaultdict(list)
    bins = defaultdict(list)
    for i, piece, start, length, b, capacity, offset in out:
        by_row[i].append((piece, start, length))
        bins[b].append((offset, length, capacity))
    assert {i: sum(p[2] for p in x) for i, x in by_row.items()} == n_tokens
    for b in bins.values():
        assert len({c for _, _, c in b}) == 1
        end = 0
        for offset, length, _ in sorted(b):
            assert offset == end and length > 0
            end += length
        assert b[0][2] == min(c for c in lengths if c >= end)  # shrunk to its contents
    return bins


def test_query_packs_every_document(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    tokens = {i: len((t or "").encode().split()) + 1 for i, t in zip(docs.doc_id, docs.text, strict=True)}
    out = [tuple(r) for r in queries.QUERIES["op4_packing"](spark, SF).collect()]
    bins = check(out, tokens, LENGTHS)
    used, room = sum(tokens.values()), sum(b[0][2] for b in bins.values())
    assert used / room > 0.9


@pytest.mark.parametrize("seed", range(5))
def test_groups_pack_tightly(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(np.minimum(rng.lognormal(5, 1.2, 3000).astype(int) + 1, LENGTHS[-1]))[::-1]
    bins, offset, capacity = best_fit(sizes)
    fill = np.bincount(bins, sizes)
    assert (fill <= capacity[np.unique(bins, return_index=True)[1]]).all()
    assert sizes.sum() / sum(capacity[np.unique(bins, return_index=True)[1]]) > 0.97
    total = sum(cost(int(c)) for c in capacity[np.unique(bins, return_index=True)[1]])
    for one in LENGTHS:  # jointly no dearer than first-fit decreasing with any single length that fits
        if one >= sizes[0]:
            room = []
            for s in sizes.tolist():
                k = next((k for k, r in enumerate(room) if r >= s), None)
                if k is None:
                    room.append(one - s)
                else:
                    room[k] -= s
            assert total <= len(room) * cost(one) * 1.02


def test_edge_rows(rows):
    long = "w " * 20_000
    df = rows("doc_id long, text string, bin_id int, group int, length string",
              (1, None, 1, 1, "x"), (2, "", 1, 1, "x"), (3, "a b", 1, 1, "x"), (3, "a b", 1, 1, "x"),
              (None, long, 1, 1, "x"), (5, " \n\t\x0b\x0c\r", 1, 1, "x"))
    for group_tokens in (2_000_000, 50):
        out = [tuple(r) for r in pack(df, "doc_id", "text", group_tokens=group_tokens).collect()]
        check(out, {1: 1, 2: 1, 3: 6, None: 20_001, 5: 1}, LENGTHS)
        assert max(r[3] for r in out) == 8192
    assert pack(df.limit(0), "doc_id", "text").count() == 0
    assert best_fit([])[0].size == 0
