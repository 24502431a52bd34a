"""Embedding near-duplicates by collision counting over sorted projections.

All pairs of vectors with cosine >= ``least`` are found as follows:

1. Equal vectors collapse to one class (partial aggregation), so a vector that a
   third of all rows share is one row from here on.
2. Each class gets ``tables`` random one-dimensional projections.  A projection is
   sorted not as a whole but inside the buckets that further ``bits`` random
   hyperplanes cut the sphere into; ``bits`` grows with the logarithm of the number of
   classes, so that a window holds a few vectors at any size of the table.
3. In every sorted run a window of half-width ``w`` is centred on each vector; vectors
   in it collide with it once.  Collisions are counted per pair over all tables.
4. Pairs with at least ``COUNT`` collisions are verified by their cosine in double
   precision.  The number of tables is calibrated: it is the least one with which a
   pair exactly at the threshold gathers ``COUNT`` collisions with probability
   1 - ``MISS`` (closer pairs nearly surely do).
5. Links between classes, the class sizes and connected components give the result.

A bucket above ``CHUNK`` vectors is dealt out as pairs of chunks; nothing is capped.

Vectors that are null, empty, zero or hold null or non-finite components link with
nothing, and so do vectors of different length.  Rows without links are their own
component.  A null id counts as a link partner; it names no component unless all
ids of a component are null.  Repeated rows are linked with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components

#: collisions that make a pair a candidate
COUNT = 2
#: probability of missing a pair that lies exactly on the threshold
MISS = 1e-9
#: half-width of a window in distances of a threshold pair
WIDTH = 2.0
#: vectors that a bucket should hold
OCCUPANCY = 4
CHUNK = 2048
SEED = 20_117


def valid(vec: Column) -> Column:
    """A vector that can be compared: finite components, not all zero."""
    x = vec.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def plan(n: int, least: float) -> tuple[int, float, int]:
    """(bits, half-width, tables) for n vectors and a cosine threshold."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / OCCUPANCY)))
    angle = math.acos(least)
    width = WIDTH * math.sqrt(2 - 2 * least)
    p = (1 - angle / math.pi) ** bits * math.erf(WIDTH / math.sqrt(2))
    tables, missed = COUNT, 1.0
    while missed > MISS:
        tables += 1
        missed = sum(math.comb(tables, c) * p ** c * (1 - p) ** (tables - c) for c in range(COUNT))
    return bits, width, tables


def unit_rows(vectors: pa.Array) -> list[np.ndarray]:
    """Vectors of unit length in double precision."""
    out = []
    for v in vectors.to_pylist():
        x = np.array(v, np.float64)
        x /= np.abs(x).max()
        out.append(x / np.linalg.norm(x))
    return out


def _project(bits: int, tables: int):
    """mapInArrow body: (h, vec) -> (t, key, at, h) for all tables."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for s in range(0, big.num_rows, 1024):
                b = big.slice(s, 1024)
                h = np.asarray(b.column("h"))
                units = unit_rows(b.column("vec"))
                dims = np.array([len(u) for u in units])
                for d in np.unique(dims).tolist():
                    pick = np.flatnonzero(dims == d)
                    x = np.stack([units[i] for i in pick])
                    rng = np.random.default_rng([SEED, d])
                    for t in range(tables):
                        a = rng.standard_normal((d, bits + 1))
                        y = x @ a
                        key = np.full(len(pick), d, np.int64)  # vectors of other lengths never meet
                        for i in range(bits):
                            key = key * 2 + (y[:, i] > 0)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(pick), t, np.int32)), pa.array(key), pa.array(y[:, bits]),
                             pa.array(h[pick])], ["t", "key", "at", "h"])
    return run


def _collisions(width: float):
    """mapInArrow body: rows sorted by (t, key, lo, hi, at) -> colliding pairs (a < b)."""

    def pairs(group: np.ndarray, at: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(h)
        shift = 1
        alive = np.arange(n)
        while True:  # compare each row with the one `shift` places on, while any is in the window
            alive = alive[alive + shift < n]
            other = alive + shift
            alive = alive[(group[alive] == group[other]) & (at[other] - at[alive] <= width)]
            if not len(alive):
                return
            x, y = h[alive], h[alive + shift]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
            shift += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            cols = [np.asarray(batch.column(c)) for c in ("t", "key", "lo", "hi", "at", "h")]
            if rest is not None:
                cols = [np.concatenate(p) for p in zip(rest, cols, strict=True)]
            if not len(cols[0]):
                continue
            new = np.zeros(len(cols[0]), bool)
            for c in cols[:4]:
                new[1:] |= c[1:] != c[:-1]
            number = np.cumsum(new)
            last = int(np.searchsorted(number, number[-1]))
            rest = [c[last:] for c in cols]
            yield from pairs(number[:last], cols[4][:last], cols[5][:last])
        if rest is not None:
            yield from pairs(np.zeros(len(rest[0]), np.int64), rest[4], rest[5])

    return run


def candidate_pairs(classes: DataFrame, n: int, least: float, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of classes (h, vec) with enough collisions."""
    bits, width, tables = plan(n, least)
    keyed = scratch.keep(classes.select("h", "vec").repartition("h").mapInArrow(
        _project(bits, tables), "t int, key long, at double, h long"), "projections")
    large = scratch.keep(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(f"n > {CHUNK}")
                         .select("t", "key", F.ceil(F.col("n") / CHUNK).cast("int").alias("s")), "large")
    s = F.coalesce("s", F.lit(1))
    dealt = (keyed.join(large, ["t", "key"], "left")
             .withColumn("c", F.pmod(F.xxhash64("h", "t"), s).cast("int"))
             .select("t", "key", "at", "h", "c", F.explode(F.sequence(F.lit(0), s - 1)).alias("o"))
             .select("t", "key", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"), "at", "h"))
    met = (dealt.repartition("t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi", "at", "h")
           .mapInArrow(_collisions(width), "a long, b long"))
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met")).where(f"met >= {COUNT}").select("a", "b")


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def near_duplicates(df: DataFrame, id_col: str, vec_col: str, least: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, kept) per input row: other rows linked directly, the
    smallest id reachable by links, and whether that is the row's own."""
    scratch = Scratch(df.sparkSession, "embeddings")
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.withColumn("h", F.when(valid(F.col("vec")), F.xxhash64("vec")))
    classes = scratch.keep(rows.where("h is not null").groupBy("h")
                           .agg(F.first("vec").alias("vec"), F.min("id").alias("least"),
                                F.count(F.lit(1)).alias("n")), "classes")
    unit = classes.select("h", "n", F.transform("vec", lambda v: v / F.array_max(
        F.transform("vec", lambda w: F.abs(w)))).alias("x"))
    unit = unit.select("h", "n", "x", F.sqrt(_dot(F.col("x"), F.col("x"))).alias("norm"))
    side = lambda name: unit.select(*[F.col(c).alias(f"{name}_{c}") for c in unit.columns])
    near = candidate_pairs(classes, classes.count(), least, scratch)
    links = scratch.keep(
        near.join(side("l"), F.col("a") == F.col("l_h")).join(side("r"), F.col("b") == F.col("r_h"))
        .where(_dot(F.col("l_x"), F.col("r_x")) / (F.col("l_norm") * F.col("r_norm")) >= least)
        .select("a", "b", F.col("l_n").alias("n_a"), F.col("r_n").alias("n_b")), "verified")
    degree = (links.select(F.col("a").alias("h"), F.col("n_b").alias("k"))
              .unionAll(links.select(F.col("b").alias("h"), F.col("n_a").alias("k")))
              .groupBy("h").agg(F.sum("k").alias("k")))
    member = connected_components(links, "a", "b", scratch)
    labelled = (classes.select("h", "least", "n").join(member, F.col("h") == F.col("node"), "left")
                .select("h", "least", "n", F.coalesce("component", "h").alias("label")))
    ids = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    found = (labelled.join(ids, "label").join(degree, "h", "left")
             .select("h", "component_id", (F.coalesce("k", F.lit(0)) + F.col("n") - 1).alias("k")))
    out = rows.select("id", "h").join(found, "h", "left")
    component = F.when(F.col("h").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.coalesce("k", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
