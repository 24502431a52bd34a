"""Conversation repair: brute force over all edits, chunk joins, edge rows, the query itself."""

import hashlib
import itertools
import random
import re
import zlib

import pandas as pd
import pytest

from riskframe.llm import conversations as C
from riskframe.llm import queries

WHITE = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """(cost, audit, repaired) of all edits by trying them; rows: (role, text, fault)."""
    best = None
    for gaps in itertools.product(range(3), repeat=len(rows) + 1):  # inserts before each turn and at the end
        if 5 * sum(gaps) > 2 * len(rows):
            continue
        for ops in itertools.product("DKR", repeat=len(rows)):
            if any(o != "D" and r[2] in "bd" for o, r in zip(ops, rows)):
                continue
            base = 5 * sum(gaps) + sum({"D": 2, "K": 0, "R": 1}[o] + 5 * (o != "D" and r[2] == "t") for o, r in zip(ops, rows))
            if best and base > best[0]:
                continue
            audit = "".join("I" * g + o for g, o in zip(gaps, (*ops, "")))
            at = iter(rows)
            turns = [(e, None if e == "I" else next(at)) for e in audit]
            left = [(e, t) for e, t in turns if e != "D"]
            system = len(left) % 2
            if system and (left[0][0] != "K" or left[0][1][0][:1] != "s" or len(left) == 1):
                continue
            target = ["s"] * system + ["u", "a"] * (len(left) // 2)
            if any(e == "K" and t[0][:1] != x for (e, t), x in zip(left, target)):
                continue
            name = {"u": "user", "a": "assistant"}
            fixed = [(t[0] if e == "K" else name[x], "" if e == "I" else t[1]) for (e, t), x in zip(left, target)]
            if best is None or (base, audit) < best[:2]:
                best = base, audit, fixed
    return best


def through_chunks(rows, size):
    """The operator's own functions over chunks of ``size`` turns."""
    parts = [rows[i:i + size] for i in range(0, len(rows), size)]
    aligned = [C.align_chunk("".join(r[0][:1] or "-" for r in p), "".join(r[2] for r in p)) for p in parts]
    enters, pairs, total, ending = C.fold([a[0] for a in aligned], [a[2] for a in aligned])
    fixed = []
    for p, a, e, i in zip(parts, aligned, enters, pairs):
        fixed += C.apply_edits([{"role": r[0], "text": r[1]} for r in p], a[1][i], e)
    fixed += [("assistant" if len(ending) == 1 or i else "user", "") for i in range(len(ending))]
    return total, "".join(a[1][i] for a, i in zip(aligned, pairs)) + ending, fixed


@pytest.mark.parametrize("size", [1, 2, 3, 9])
def test_edits_against_brute_force(size):
    rng = random.Random(size)
    for _ in range(150):
        rows = [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), f"t{i}", rng.choice("   tbd"))
                for i in range(rng.randint(1, 5))]
        assert through_chunks(rows, size) == cheapest(rows), rows


def test_chunks_agree_on_long_conversations():
    rng = random.Random(5)
    for n in (40, 300):
        rows = [(rng.choice(["user", "assistant", "user", "assistant", "system"]), str(i), rng.choice("       tbd")) for i in range(n)]
        assert through_chunks(rows, n) == through_chunks(rows, 7) == through_chunks(rows, 64)


def reference(rows):
    """One conversation's report, row by row; rows after damage in order: (turn, role, text)."""
    seen, faults = set(), []
    for _, role, text in rows:
        letters = WHITE.findall(text)
        fault = "b" if not letters else "d" if (role, text) in seen else " " if letters[-1] in ".!?" else "t"
        seen.add((role, text))
        faults.append(fault)
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, fixed = through_chunks([(r[1], r[2], f) for r, f in zip(rows, faults)], 10 ** 6) if rows else (0, "", [])
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"),
            faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())


def damaged(rows):
    """rows: (conv, turn, role, text) of one conversation."""
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return {(conv, *reference(damaged(g))) for conv, g in groups.items()}


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query_against_rows_one_by_one(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op11_conversations"](spark, sf).select("conv_id", *NAMES).collect()
    rows = pd.read_parquet(f"{sf}/conversations.parquet")[["conv_id", "turn", "role", "text"]].itertuples(index=False)
    assert {tuple(r) for r in got} == expected([tuple(r) for r in rows])
    assert len(got) == len({r.conv_id for r in got})


def test_edge_rows_and_long_conversations(rows):
    rng = random.Random(2)
    data = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, None, None), (1, None, "system", "Be good."), (1, None, "", "x"),
            (None, 3, "assistant", "a!"), (None, 1, "user", "q?"), (2, None, None, None), (3, 5, "user", "w" * 300_000 + "?")]
    data += [(4, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "No.", f"{t}", ""])) for t in range(60)]
    data += [(5, 7, "user", "same.")] * 9
    df = rows("conv_id long, turn long, role string, text string, n int, fault string", *[(*r, 1, "x") for r in data])
    report = C.repair_report(df.repartition(7), "conv_id", "turn", "role", "text", chunk=4)
    assert {tuple(r) for r in report.select("conv", *NAMES).collect()} == expected(data)
    assert C.repair_report(df.limit(0), "conv_id", "turn", "role", "text").count() == 0


def test_repaired_turns_follow_the_grammar(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    whole, pieces = C.repair(C.damage(df, "conv_id", "turn", "role", "text"), "conv", "turn", "role", "text")
    found = {}
    for r in C.repaired_turns(pieces).orderBy("conv", "part", "seq", "pos").collect():
        found.setdefault(r.conv, []).append(r.role[0])
    ends = {r.conv: r.ending for r in whole.collect()}
    for conv, initials in found.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(initials) + {"": "", "I": "a", "II": "ua"}[ends[conv]])
