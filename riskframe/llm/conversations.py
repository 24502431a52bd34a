"""Repair of conversation structure by alignment with the alternating grammar.

A conversation should read ``(s?(ua)+)?``: an optional system turn, then user and
assistant in turn.  ``repair`` finds the cheapest edits to that form and, among
equally cheap ones, the ASCII-least string of edit initials:

* K(eep) costs 0, R(erole) to user or assistant 1, D(elete) 2, I(nsert) an empty user or
  assistant turn 5; a truncated turn that stays costs 5 more; blank and duplicate
  turns must be deleted.

*Faults* are native expressions: a turn is blank (no character beyond space and
``\\x09-\\x0D``), else a duplicate (same role and text earlier in the conversation), else
truncated (last such character not ``.!?``).  Equal rows are counted before anything
is shuffled; "earlier" is a partial minimum per (conversation, role, text).

*Alignment* is Wagner and Fischer's, of the turns against every feasible length of
the target.  Targets are anchored at their end, so that one table holds them all:
cell (i, r) is the cost of turning turns i.. into the last r target symbols.  Ukkonen's
band keeps the cells that can be part of an alignment of the incumbent cost; a found
alignment that is cheaper than the band's bound is final, a dearer one becomes
the incumbent of a wider band.  The best lengths are backtraced and their audits compared.

*Long conversations* are cut into chunks of at most ``CHUNK`` turns, whatever task
their rows are in (rows are range-partitioned by conversation, turn, role, text, so one huge
conversation spreads over many tasks).  A chunk is aligned once for each pair of grammar
states at its two ends (nothing yet, after the system turn, user expected, assistant
expected); inserts belong to the chunk of the turn that follows them.  Only the costs of
those pairs and the order of their audits, a few integers a chunk, are then folded per
conversation to choose each chunk's states; the chosen audits join the chunks again.

Result cases: null role or text counts as one space; a null conversation id is a
conversation of its own; null turns come first; rows with equal turn are ordered by role and
text; repeated rows are duplicates; a conversation without rows does not appear; an
empty table gives an empty result.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: turns and text bytes of a chunk
CHUNK, CHUNK_BYTES = 512, 4 << 20
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: grammar states: nothing yet, after the system turn, user expected, assistant expected
FRESH, SYSTEM, USER, ASSISTANT = range(4)
PAIRS = [(FRESH, FRESH), (FRESH, SYSTEM), (FRESH, ASSISTANT), (FRESH, USER), (SYSTEM, SYSTEM), (SYSTEM, ASSISTANT),
         (SYSTEM, USER), (USER, ASSISTANT), (USER, USER), (ASSISTANT, ASSISTANT), (ASSISTANT, USER)]
#: edits after the last turn that complete the grammar, by state
ENDING = {FRESH: "", SYSTEM: "II", USER: "", ASSISTANT: "I"}
BLANKS = " \t\n\x0b\x0c\r"
_NEVER = 1 << 40

_CHUNK_SCHEMA = ("conv {conv}, part int, seq int, turns array<struct<role:string,text:string>>, audits array<string>, "
                 "costs array<long>, ranks array<int>, blank long, duplicate long, truncated long, illegal long, "
                 "first string, last string, low long, high long, distinct long")


def _align(initials: str, must_go: np.ndarray, cut: np.ndarray, end: int, bound: int) -> tuple[np.ndarray, list]:
    """Suffix costs of one chunk against targets that leave the grammar in state ``end``
    (USER or ASSISTANT), and the band of each row; cells of cost above ``bound`` may be missing."""
    n = len(initials)
    width = n + bound // INSERT + 2
    cost = np.full((n + 1, width), _NEVER, np.int64)
    cost[n, 0] = 0
    odd = np.arange(width) % 2 == 1
    # symbol at r from the end: the assistant's at odd r if the chunk ends after one
    is_a = odd if end == USER else ~odd
    stay = [{"u": np.where(is_a, REROLE, 0), "a": np.where(is_a, 0, REROLE)}.get(c, np.full(width, REROLE)) for c in "uax"]
    kind = {"u": 0, "a": 1}
    ramp = INSERT * np.arange(width)
    for i in range(n - 1, -1, -1):
        left = n - i
        low, high = max(0, left - bound // DELETE), min(width, left + bound // INSERT + 1)
        row = cost[i + 1, low:high] + DELETE
        if not must_go[i]:
            at = max(low, 1)
            keep = cost[i + 1, at - 1:high - 1] + stay[kind.get(initials[i], 2)][at:high] + TRUNCATED * cut[i]
            row[at - low:] = np.minimum(row[at - low:], keep)
        cost[i, low:high] = np.minimum.accumulate(row - ramp[low:high]) + ramp[low:high]
    return cost, is_a


def _backtrace(cost: np.ndarray, is_a: np.ndarray, initials: str, must_go, cut, i: int, r: int) -> str:
    """ASCII-least edits among the cheapest ones from cell (i, r)."""
    out, n = [], len(initials)
    while i < n:
        here = cost[i, r]
        if cost[i + 1, r] + DELETE == here:
            out.append("D")
            i += 1
        elif r and cost[i, r - 1] + INSERT == here:
            out.append("I")
            r -= 1
        else:
            out.append("K" if initials[i] == ("a" if is_a[r] else "u") else "R")
            i, r = i + 1, r - 1
    return "".join(out)


@lru_cache(maxsize=50_000)
def _align_short(initials: str, faults: str) -> tuple:
    return align_chunk(initials, faults)


def align_chunk(initials: str, faults: str) -> tuple[tuple[int, ...], tuple[str, ...], tuple[int, ...]]:
    """Cost, audit and audit order of each pair of states; faults: b(lank), d(uplicate), t(runcated) or space."""
    n = len(initials)
    must_go = np.array([f in "bd" for f in faults], bool)
    cut = np.array([f == "t" for f in faults], bool)
    bound = DELETE * int(must_go.sum() + cut.sum()) + 2 * INSERT
    most = DELETE * n + 2 * INSERT  # inserts before the first turn and deletes give every pair
    while True:
        best = _pairs(initials, must_go, cut, bound)
        incumbent = max(c for (c, _), (_, leave) in zip(best, PAIRS, strict=True) if leave in (USER, ASSISTANT))
        if incumbent <= bound or bound >= most:
            break
        bound = min(incumbent, 4 * bound, most)
    audits = tuple(a for _, a in best)
    order = sorted(range(len(PAIRS)), key=audits.__getitem__)
    return tuple(c for c, _ in best), audits, tuple(order.index(i) for i in range(len(PAIRS)))


def _pairs(initials: str, must_go: np.ndarray, cut: np.ndarray, bound: int) -> list[tuple[int, str]]:
    n = len(initials)
    tables = {end: _align(initials, must_go, cut, end, bound) for end in (USER, ASSISTANT)}
    systems = [i for i in range(n) if initials[i] == "s" and not must_go[i]]
    out = []
    for enter, leave in PAIRS:
        ways = []  # (cost, edits before, first turn and length of the aligned rest)
        if enter == leave and enter in (FRESH, SYSTEM):
            ways.append((DELETE * n, "D" * n, n, 0))
        if (enter, leave) == (FRESH, SYSTEM):
            ways += [(DELETE * (n - 1) + TRUNCATED * int(cut[i]), "D" * i + "K" + "D" * (n - i - 1), n, 0) for i in systems]
        if leave in tables:
            cost, is_a = tables[leave]
            first_a = enter == ASSISTANT
            lengths = np.flatnonzero(is_a == first_a)
            lengths = lengths[lengths > 0]
            if enter == leave:
                lengths = np.r_[0, lengths]
            ways += [(int(cost[0, r]), "", 0, int(r)) for r in lengths if cost[0, r] < _NEVER]
            if enter == FRESH:
                for i in systems:
                    before = DELETE * i + TRUNCATED * int(cut[i])
                    rest = cost[i + 1, lengths]
                    ways += [(before + int(c), "D" * i + "K", i + 1, int(r))
                             for c, r in zip(rest, lengths, strict=True) if c < _NEVER and c == rest.min()]
        least = min((w[0] for w in ways), default=_NEVER)
        texts = [w[1] + (_backtrace(*tables[leave], initials, must_go, cut, w[2], w[3]) if w[2] < n else "")
                 for w in ways if w[0] == least and least < _NEVER]
        out.append((least, min(texts, default="")))
    return out


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns to chunks of one conversation each (``most`` turns), with their alignment."""
    part = TaskContext.get().partitionId()
    key, rows, size, seq, out = None, [], 0, 0, []

    def close() -> None:
        nonlocal rows, size, seq
        if rows:
            out.append(_chunk_row(key[0], part, seq, rows))
            seq += 1
        rows, size = [], 0

    kind = None
    for b in batches:
        kind = b.schema.field("conv").type
        columns = [b.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "n", "fault")]
        for conv, turn, role, text, n, fault in zip(*columns, strict=True):
            if key is None or key[0] != conv:
                close()
                key = (conv,)
            for i in range(n):
                if len(rows) >= most or size > CHUNK_BYTES:
                    close()
                rows.append((turn, role, text, "d" if i and fault != "b" else fault))
                size += len(text)
        if len(out) >= 256:
            yield _chunk_batch(out, kind)
            out = []
    close()
    if out:
        yield _chunk_batch(out, kind)


def _chunk_row(conv, part: int, seq: int, rows: list) -> tuple:
    initials = "".join(r[1][:1] or "-" for r in rows)
    faults = "".join(r[3] for r in rows)
    costs, audits, ranks = (_align_short if len(rows) <= 24 else align_chunk)(initials, faults)
    turns = [r[0] for r in rows if r[0] is not None]
    return (conv, part, seq, [{"role": r[1], "text": r[2]} for r in rows], audits, costs, ranks, faults.count("b"),
            faults.count("d"), faults.count("t"), illegal(initials), rows[0][1][:1], rows[-1][1][:1],
            min(turns, default=None), max(turns, default=None), len(set(turns)))


def illegal(initials: str) -> int:
    return sum(initials[i:i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


def _chunk_batch(rows: list, kind: pa.DataType) -> pa.RecordBatch:
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    types = [kind, pa.int32(), pa.int32(), pa.list_(turn), pa.list_(pa.string()), pa.list_(pa.int64()),
             pa.list_(pa.int32()), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3]
    names = ["conv", "part", "seq", "turns", "audits", "costs", "ranks", "blank", "duplicate", "truncated", "illegal",
             "first", "last", "low", "high", "distinct"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


_FOLD = ("conv {conv}, part array<int>, seq array<int>, enter array<int>, pair array<int>, gaps long, blank long, "
         "duplicate long, truncated long, illegal long, cost long, ending string")


def fold(costs: list, ranks: list) -> tuple[list[int], list[int], int, str]:
    """Choose the states between the chunks of one conversation: the pair of each
    chunk, the total cost and the edits after the last turn."""
    rest = [INSERT * len(ENDING[s]) for s in range(4)]
    after = []
    for cost in reversed(costs):
        after.append(rest)
        new = [_NEVER] * 4
        for p, (enter, leave) in enumerate(PAIRS):
            new[enter] = min(new[enter], cost[p] + rest[leave])
        rest = new
    total, state, enters, pairs = rest[FRESH], FRESH, [], []
    for cost, rank, rest in zip(costs, ranks, reversed(after), strict=True):
        pair = min((p for p, (enter, _) in enumerate(PAIRS) if enter == state),
                   key=lambda p: (cost[p] + rest[PAIRS[p][1]], rank[p]))
        enters.append(state)
        pairs.append(pair)
        state = PAIRS[pair][1]
    return enters, pairs, total, ENDING[state]


def _fold_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk summaries sorted by conversation, part and seq to one row per conversation."""
    names = ["conv", "part", "seq", "costs", "ranks", "blank", "duplicate", "truncated", "illegal", "first", "last",
             "low", "high", "distinct", "low_again"]
    key, mine, out, kind = None, [], [], None

    def close() -> None:
        nonlocal mine
        if mine:
            out.append(_conversation(key[0], mine))
        mine = []

    def batch() -> pa.RecordBatch:
        types = [kind, *[pa.list_(pa.int32())] * 4, *[pa.int64()] * 6, pa.string()]
        heads = [f.split()[0] for f in _FOLD.format(conv="").split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], heads)

    for b in batches:
        kind = b.schema.field("conv").type
        for row in zip(*[b.column(c).to_pylist() for c in names[:-1]], strict=True):
            if key is None or key[0] != row[0]:
                close()
                key = (row[0],)
            mine.append(row)
        if len(out) >= 4096:
            yield batch()
            out.clear()
    close()
    if out:
        yield batch()


def _conversation(conv, rows: list) -> tuple:
    enters, pairs, total, ending = fold([r[3] for r in rows], [r[4] for r in rows])
    faults = [sum(r[c] for r in rows) for c in (5, 6, 7)]
    bad = sum(r[8] for r in rows) + sum(illegal((a[10] or "-") + (b[9] or "-")) for a, b in zip(rows, rows[1:], strict=False))
    seen = [r for r in rows if r[11] is not None]
    distinct = sum(r[13] for r in seen) - sum(a[12] == b[11] for a, b in zip(seen, seen[1:], strict=False))
    gaps = seen[-1][12] - seen[0][11] + 1 - distinct if seen else 0
    return (conv, [r[1] for r in rows], [r[2] for r in rows], enters, pairs, gaps, *faults, bad, total, ending)


def apply_edits(turns: list, audit: str, state: int) -> list:
    """Turns after the edits, entered in a grammar state: (role, text)."""
    out, at = [], 0
    for edit in audit:
        keeps = edit == "K"
        if edit != "I":
            turn = turns[at]
            at += 1
        if edit == "D":
            continue
        system = keeps and state == FRESH and turn["role"][:1] == "s"
        wanted = "assistant" if state == ASSISTANT else "user"
        out.append((turn["role"] if keeps else wanted, "" if edit == "I" else turn["text"]))
        state = SYSTEM if system else USER if state == ASSISTANT else ASSISTANT
    return out


def _edited(turns: Column, audit: Column, state: Column) -> Column:
    """Repaired turns of each chunk."""
    @F.arrow_udf("array<struct<role:string,text:string>>")
    def edited(turns: pa.Array, audit: pa.Array, state: pa.Array) -> pa.Array:
        rows = zip(turns.to_pylist(), audit.to_pylist(), state.to_pylist(), strict=True)
        return pa.array([[{"role": r, "text": t} for r, t in apply_edits(*x)] for x in rows],
                        pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
    return edited(turns, audit, state)


def faulted(df: DataFrame, conv: str, turn: str, role: str, text: str, scratch: Scratch) -> DataFrame:
    """Distinct turns with their number of rows and the fault of the first one."""
    space = F.lit(" ")
    trimmed = F.rtrim("text", F.lit(BLANKS))
    rows = scratch.keep(
        df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, space).alias("role"),
                  F.coalesce(text, space).alias("text"))
        .groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("state", F.when(trimmed == "", "b").when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), " ").otherwise("t")),
        "turns")
    # only texts that occur at several turns of a conversation have something earlier; usually few
    again = scratch.keep(rows.where("state <> 'b'").groupBy("conv", "role", "text")
                         .agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("turns"))
                         .where("turns > 1").select(*[F.col(c).alias("r_" + c) for c in ("conv", "role", "text")], "first"),
                         "again")
    same = [F.col(c).eqNullSafe(F.col("r_" + c)) for c in ("conv", "role", "text")]
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return (rows.join(again, same[0] & same[1] & same[2], "left")
            .select("conv", "turn", "role", "text", "n", F.when(later, "d").otherwise(F.col("state")).alias("fault")))


def repair(df: DataFrame, conv: str, turn: str, role: str, text: str, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(conversations, pieces): one row per conversation with gaps, blank, duplicate,
    truncated, illegal, cost and the edits after its last turn; and its chunks in order
    (conv, part, seq, audit, repaired turns), without that ending."""
    scratch = Scratch(df.sparkSession, "conversations")
    kind = df.schema[conv].dataType.simpleString()
    chunks = scratch.keep(faulted(df, conv, turn, role, text, scratch)
                          .repartitionByRange("conv", "turn", "role", "text")
                          .sortWithinPartitions("conv", "turn", "role", "text")
                          .mapInArrow(lambda batches: _chunks(batches, chunk), _CHUNK_SCHEMA.format(conv=kind)), "chunks")
    whole = scratch.keep(chunks.drop("turns", "audits").repartition("conv").sortWithinPartitions("conv", "part", "seq")
                         .mapInArrow(_fold_rows, _FOLD.format(conv=kind)), "folded")
    chosen = whole.select(F.explode(F.arrays_zip("part", "seq", "enter", "pair")).alias("c")).select("c.*")
    pieces = (chunks.select("conv", "part", "seq", "turns", "audits").join(chosen, ["part", "seq"])
              .select("conv", "part", "seq", F.col("audits")[F.col("pair")].alias("audit"), "enter", "turns")
              .withColumn("repaired", _edited(F.col("turns"), F.col("audit"), F.col("enter"))).drop("turns", "enter"))
    return whole.drop("part", "seq", "enter", "pair"), pieces


def repaired_turns(pieces: DataFrame) -> DataFrame:
    """(conv, part, seq, pos, role, text): the turns that stay, in order."""
    return pieces.select("conv", "part", "seq", F.posexplode("repaired").alias("pos", "t")).select(
        "conv", "part", "seq", "pos", "t.role", "t.text")


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to (conv, audit, sha256 of the repaired turns), one conversation after the other."""
    key, audit, sha, first, out, kind = None, [], None, True, [], None

    def close() -> None:
        if key is not None:
            out.append((key[0], "".join(audit), sha.hexdigest()))

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True),
                                           (kind, pa.string(), pa.string()), strict=True)], ["conv", "audit", "repaired_sha256"])

    for b in batches:
        kind = b.schema.field("conv").type
        for conv, edits, turns in zip(*[b.column(c).to_pylist() for c in ("conv", "audit", "repaired")], strict=True):
            if key is None or key[0] != conv:
                close()
                key, audit, sha, first = (conv,), [], hashlib.sha256(), True
            audit.append(edits)
            for t in turns:
                sha.update((("" if first else "\n") + f"{t['role']}:{t['text']}").encode())
                first = False
        if len(out) >= 4096:
            yield batch()
            out.clear()
    close()
    if out:
        yield batch()


def digests(whole: DataFrame, pieces: DataFrame) -> DataFrame:
    """One row per conversation with its full audit and the SHA-256 of its repaired
    ``role:text`` lines; the texts pass through a task as a sorted stream."""
    kind = whole.schema["conv"].dataType.simpleString()
    ends = whole.select("conv", F.lit(1 << 30).alias("part"), F.lit(0).alias("seq"), F.col("ending").alias("audit"),
                        F.when(F.col("ending") == "", F.array()).when(F.col("ending") == "I", _empty("assistant"))
                        .otherwise(_empty("user", "assistant")).cast("array<struct<role:string,text:string>>").alias("repaired"))
    stream = pieces.select(*ends.columns).unionByName(ends).repartition("conv").sortWithinPartitions("conv", "part", "seq")
    found = stream.mapInArrow(_digest_rows, f"conv {kind}, audit string, repaired_sha256 string")
    return whole.drop("ending").withColumnRenamed("conv", "w").join(
        found, F.col("w").eqNullSafe(F.col("conv"))).drop("w")


def _empty(*roles: str) -> Column:
    return F.array(*[F.struct(F.lit(r).alias("role"), F.lit("").alias("text")) for r in roles])


def damage(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Planted faults, by crc32 of ``conv:turn`` modulo 20 (nulls count as one space):
    0 drops the row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it the user's."""
    space = F.lit(" ")
    of = [F.coalesce(F.col(c).cast("string"), space) for c in (conv, turn)]
    k = F.pmod(F.crc32(F.concat(of[0], F.lit(":"), of[1]).cast("binary")), F.lit(20))
    body = F.coalesce(F.col(text), space)
    return (df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), k.alias("k"), body.alias("text"),
                      F.coalesce(F.col(role), space).alias("role"))
            .where("k <> 0")
            .select("conv", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
            .drop("copy"))


def repair_report(df: DataFrame, conv: str, turn: str, role: str, text: str, chunk: int = CHUNK) -> DataFrame:
    """Every conversation of ``df`` after damage and repair: conv, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256.  One that damage leaves no row of: zeros, empty audit."""
    report = digests(*repair(damage(df, conv, turn, role, text), "conv", "turn", "role", "text", chunk))
    every = df.select(F.col(conv).alias("every")).distinct()
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(report, F.col("every").eqNullSafe(F.col("conv")), "left").select(
        F.col("every").alias("conv"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
