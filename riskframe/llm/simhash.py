"""SimHash near-duplicate groups (pigeonhole blocks).

1. Every text gets a 64-bit fingerprint: words ``[^\\x20\\x09-\\x0D]+`` after
   lower-casing A-Z, shingles of ``shingle`` words (repeats count; fewer words:
   the whole sequence; none: fingerprint zero), XXH64 (seed 42) of each; a bit
   is 1 if it is set in more than half of the hashes.
2. Equal fingerprints collapse to one class before anything is compared, so a
   group of copies that holds a third of all rows is one row from here on.
3. A fingerprint is cut into ``blocks`` blocks.  Two fingerprints that differ in
   at most d bits agree on at least ``blocks - d`` whole blocks, so every close
   pair meets in one of the C(blocks, d) tables keyed by such a choice of blocks.
   ``blocks`` grows with the number of classes (see ``blocks_for``), which keeps
   buckets small; the result is the same for every choice.
4. Each bucket is verified by Hamming distance with XOR and bit counts.  A bucket
   beyond ``chunk`` fingerprints is dealt out as pairs of chunks, so no task
   holds more than two chunks of it; a task returns a spanning forest of the
   verified links, never all pairs.
5. Connected components of the links give the groups.

Null or empty text: fingerprint zero, linked like any other.  Null ids never
become a component's id while it has another; repeated rows each get a result.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, slices
from .components import connected_components

BITS = 64
#: shingle hashes unpacked to bits at a time
HASHES_AT_ONCE = 1 << 16


def text_fingerprint(text: bytes | None, shingle: int) -> int:
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n < shingle:
        return digest(b" ".join(words), 42)
    ones = np.zeros(BITS, np.int64)
    total = n - shingle + 1
    for at in range(0, total, HASHES_AT_ONCE):
        part = words[at:at + HASHES_AT_ONCE + shingle - 1]
        runs = zip(*(part[i:] for i in range(shingle)), strict=False)
        h = np.fromiter((digest(b" ".join(s), 42) for s in runs), np.uint64, min(HASHES_AT_ONCE, total - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text_col: str, shingle: int = 3, **keep) -> DataFrame:
    """The columns ``keep`` of each row and ``fp``, the fingerprint of its whole text as a signed long."""

    @F.arrow_udf("long")
    def fingerprint(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            fp = [text_fingerprint(t, shingle) for b in slices([pa.RecordBatch.from_arrays([column], ["text"])], "text")
                  for t in as_bytes(b.column("text"))]
            yield pa.array(np.array(fp, np.uint64).view(np.int64))

    # Python only gets the texts; the other columns stay with Spark
    return df.select(*[c.alias(n) for n, c in keep.items()], fingerprint(F.col(text_col)).alias("fp"))


def blocks_for(n: int, max_bits: int) -> int:
    """Smallest block count whose table keys have at least log2(n) bits."""
    blocks = max_bits + 1
    while BITS // blocks * (blocks - max_bits) < math.log2(max(n, 2)) and blocks < max_bits + 5:
        blocks += 1
    return blocks


def _table_keys(fp, blocks: int, max_bits: int):
    """Array of (table, key) structs: one per choice of blocks that may agree."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - max_bits)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(signed)).alias("key")))
    return F.array(*keys)


def _forest(fp: np.ndarray, max_bits: int) -> tuple[list, list]:
    """Links of a spanning forest of 'differs in at most max_bits bits'."""
    a, b = [], []
    left = fp
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= max_bits
            if near.any():
                found = left[near]
                a.extend([int(x)] * len(found))
                b.extend(found.tolist())
                front.extend(found)
                left = left[~near]
    return a, b


def bucket_links(max_bits: int):
    """mapInArrow body: rows sorted by (t, key, lo, hi) -> verified links."""

    def links(t, fp) -> pa.RecordBatch:
        # t: group number of each row, ascending
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        sizes = np.diff(np.r_[starts, len(t)])
        a, b = [], []
        two = starts[sizes == 2]
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits
        a.extend(fp[two[near]].tolist())
        b.extend(fp[two[near] + 1].tolist())
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            x, y = _forest(np.unique(fp[s:s + n]), max_bits)
            a += x
            b += y
        return pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64)),
                                           pa.array(np.array(b, np.uint64).view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            cols = [np.asarray(batch.column(c)) for c in ("t", "key", "lo", "hi", "fp")]
            if rest is not None:
                cols = [np.concatenate(p) for p in zip(rest, cols, strict=True)]
            n = len(cols[0])
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in cols[:4]:
                new[1:] |= c[1:] != c[:-1]
            number = np.cumsum(new)
            last = int(np.flatnonzero(number == number[-1])[0])
            rest = [c[last:] for c in cols]  # the last group may go on in the next batch
            if last:
                yield links(number[:last], cols[4][:last].view(np.uint64))
        if rest is not None:
            yield links(np.zeros(len(rest[0]), np.int64), rest[4].view(np.uint64))

    return run


def close_pairs(classes: DataFrame, n_classes: int, max_bits: int = 3, chunk: int = 2048) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fp`` differing in at
    most ``max_bits`` bits (a spanning forest per bucket, every link verified)."""
    blocks = blocks_for(n_classes, max_bits)
    keyed = (classes.select("fp", F.explode(_table_keys(F.col("fp"), blocks, max_bits)).alias("k"))
             .select("fp", "k.t", "k.key"))
    sizes = (keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
             .select("t", "key", F.ceil(F.col("n") / chunk).cast("int").alias("s")))
    dealt = (keyed.join(sizes, ["t", "key"])
             .withColumn("c", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
             .select("t", "key", "fp", "c", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("o"))
             .select("t", "key", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"), "fp"))
    return (dealt.repartition("t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi")
            .mapInArrow(bucket_links(max_bits), "a long, b long"))


def _groups(rows: DataFrame, max_bits: int, scratch: Scratch) -> DataFrame:
    """(fp, least, label, component_id) of each distinct fingerprint of ``rows`` (id, fp): its smallest
    id, the fingerprint that names its component, the component's smallest id."""
    classes = scratch.keep(rows.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    links = close_pairs(classes, classes.count(), max_bits)
    member = connected_components(links, "a", "b", scratch)
    labelled = (classes.join(member, classes.fp == member.node, "left")
                .select("fp", "least", F.coalesce("component", "fp").alias("label")))
    ids = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    return labelled.join(ids, "label")


def simhash_groups(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(id, fp, component_id) per input row: fingerprint (signed long) and the
    smallest id reachable over links of at most ``max_bits`` differing bits."""
    scratch = Scratch(df.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(df, text_col, shingle, id=F.col(id_col)), "fingerprints")
    groups = _groups(rows, max_bits, scratch)
    return rows.join(groups.select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def keep_one(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``df`` (all its columns) without near-duplicates: of each group the row with
    the smallest id, one of its repeated rows; a group without any id keeps one row."""
    scratch = Scratch(df.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(df, text_col, shingle, doc=F.struct("*"), id=F.col(id_col)), "tagged")
    groups = _groups(rows.select("id", "fp"), max_bits, scratch)
    keeper = F.col("least").eqNullSafe(F.col("component_id")) & (F.col("least").isNotNull() | (F.col("fp") == F.col("label")))
    first = groups.where(keeper).select("fp", "component_id")
    kept = rows.join(first, "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    return kept.dropDuplicates(["fp", "id"]).select("doc.*")
