"""Best-fit packing into sequences of several permitted lengths.

A text becomes ``words + 1`` tokens (its whitespace-separated words and an end
mark); texts longer than the largest permitted length are cut into pieces of that
length and a rest.  Pieces are dealt to groups of about ``GROUP_TOKENS`` tokens by
a hash of the row (salted, so that neither one id nor null ids pile up), and each
group is packed on its own by variable-capacity best fit:

* longest piece first; it goes into the open bin it fills best;
* if it fits in none, a bin is opened with the permitted length of least cost per
  token it can be expected to hold (what is left of the group fills the rest);
* in the end each bin shrinks to the smallest permitted length that holds its
  contents.

The cost of a sequence of length c is ``OVERHEAD + c + c * c / ATTENTION`` (a fixed
part, a linear and an attention part), so neither the longest nor the shortest
length wins always.  A group loses at most a few half-empty bins, whatever the
number of groups.

Null and empty texts are one token (the end mark), so every input row is packed;
repeated rows are packed as often as they occur; an empty table gives no bins.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LENGTHS = (512, 1024, 2048, 4096, 8192)
GROUP_TOKENS = 2_000_000
OVERHEAD = 256.0
ATTENTION = 65_536.0


def cost(length: int) -> float:
    return OVERHEAD + length + length * length / ATTENTION


def best_fit(sizes: Iterable[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, capacity) of each piece; sizes in falling order, none above
    the largest length."""
    sizes = np.asarray(sizes, np.int64)
    lengths = tuple(sorted(lengths))
    # total[c]: cost of a sequence, by permitted length
    price = [(c, cost(c)) for c in lengths]
    room: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]  # open bins by free room
    rooms = 0  # bit r is set if room[r] is not empty
    bins, offsets, used = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    rest = int(sizes.sum())
    for i, size in enumerate(sizes.tolist()):
        rest -= size
        fit = rooms >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                rooms ^= 1 << free
        else:
            free = min((p / min(c, size + rest), c) for c, p in price if c >= size)[1]
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        free -= size
        if free:
            if not room[free]:
                rooms |= 1 << free
            room[free].append(b)
    shrunk = np.array(lengths, np.int64)[np.searchsorted(lengths, used)] if used else np.zeros(0, np.int64)
    return bins, offsets, shrunk[bins] if len(bins) else bins


def pieces(df: DataFrame, id_col: str, text_col: str, longest: int) -> DataFrame:
    """(id, piece, start, length, spread): pieces of at most ``longest`` tokens."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return (df.select(F.col(id_col).alias("id"), (words + 1).alias("n"),
                      F.xxhash64(F.col(id_col), F.col(text_col), F.monotonically_increasing_id() % 4096).alias("spread"))
            .select("id", "n", "spread", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1,
                                                                 F.lit(longest).cast("long"))).alias("piece", "start"))
            .select("id", "piece", "start", F.least(F.lit(longest), F.col("n") - F.col("start")).alias("length"),
                    F.xxhash64("spread", "piece").alias("spread")))


def pack(df: DataFrame, id_col: str, text_col: str, lengths: tuple[int, ...] = LENGTHS,
         group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """(id, piece, start, length, bin_id, capacity, offset): every token of every
    row in exactly one bin; a bin's pieces lie end to end from offset 0."""
    # written: what is spread at random must not change between the two reads or in a task that runs again
    cut = Scratch(df.sparkSession, "packing").keep(pieces(df, id_col, text_col, max(lengths)), "pieces")
    total = cut.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-int(total) // group_tokens))
    id_type = cut.schema["id"].dataType.simpleString()

    def run(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "spread", "start"], ascending=[False, True, True], kind="stable")
        bins, offsets, capacity = best_fit(part["length"], lengths)
        return part.assign(bin_id=(int(key[0]) << 32) + bins, capacity=capacity, offset=offsets)[
            ["id", "piece", "start", "length", "bin_id", "capacity", "offset"]]

    return (cut.withColumn("group", F.pmod("spread", F.lit(groups)).cast("int")).groupBy("group")
            .applyInPandas(run, f"id {id_type}, piece int, start long, length long, bin_id long, "
                                "capacity int, offset int"))
