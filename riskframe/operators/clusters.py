"""k-means for many numbers of clusters at once (FE7, FE10).

Equal rows are counted first.  One Lloyd iteration is one scan that serves every k: each task
assigns its rows to the centres of all k and hands on, per (k, centre), the count, the sum and
the cost; those are summed per centre, and the driver, which gets a row a centre, moves all of them.
Starts come from one k-means|| run for the largest k: candidates drawn in two rounds in
proportion to their distance, weighted by the rows nearest to them, from which each k
takes its start with k-means++.  A k rests once none of its centres moves by more than ``tol``; the
others go on.

Where the distinct rows are few (``LOCAL_CELLS`` numbers, counted first) a job per iteration would only
wait for Spark: then each k is one task that holds them all and runs its iterations, with the
same arithmetic and the same end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import keep

#: numbers (distinct rows x dimensions) up to which a task may hold all rows: 32 MB
LOCAL_CELLS = 1 << 22
#: rows whose distances to all centres are held at once
ROWS_AT_ONCE = 2048


def weighted_rows(df: DataFrame, features: str, weight: str | None = None) -> DataFrame:
    """(x, w): the distinct vectors as arrays and how often each stands (the sum of ``weight``, if given), written once."""
    times = F.sum(weight) if weight else F.count(F.lit(1))
    return keep(df.select(vector_to_array(features).alias("x"), *([weight] if weight else [])).groupBy("x")
                .agg(times.cast("double").alias("w")), "weighted-vectors")


def packed_rows(rows: DataFrame) -> DataFrame:
    """``rows`` written as blocks of up to ROWS_AT_ONCE rows, their numbers as bytes: an iteration
    need not turn every number from Parquet to Arrow again."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, w in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f8").tobytes()]), pa.array([w.astype("<f8").tobytes()])], ["x", "w"])

    return keep(rows.mapInArrow(pack, "x binary, w binary"), "packed-vectors")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        if b.num_rows and pa.types.is_binary(b.schema.field("x").type):
            for x, w in zip(b.column("x").to_pylist(), b.column("w").to_pylist(), strict=True):
                weight = np.frombuffer(w, "<f8")
                yield np.frombuffer(x, "<f8").reshape(len(weight), -1), weight
            continue
        for at in range(0, b.num_rows, ROWS_AT_ONCE):
            part = b.slice(at, ROWS_AT_ONCE)
            yield part.column("x").flatten().to_numpy().reshape(part.num_rows, -1), part.column("w").to_numpy()


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0.0)


def _step(rows: DataFrame, centres: dict[int, np.ndarray], costs: bool = True) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """One scan: per k the weights and sums of each centre's rows, and the cost (0 without ``costs``)."""
    ks = sorted(centres)
    stacked = np.concatenate([centres[k] for k in ks])
    edges = np.cumsum([0, *[len(centres[k]) for k in ks]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, sums, cost = np.zeros(len(stacked)), np.zeros_like(stacked), np.zeros(len(stacked))
        for x, w in _blocks(batches):
            d = _distances(x, stacked)
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                near = d[:, low:high].argmin(1)
                # the cost from the differences: the expanded form loses digits where a row lies on its centre
                if costs:
                    gap = x - stacked[low + near]
                    cost[low:high] += np.bincount(near, w * (gap * gap).sum(1), high - low)
                weight[low:high] += np.bincount(near, w, high - low)
                hit = np.zeros((high - low, len(x)))
                hit[near, np.arange(len(x))] = w
                sums[low:high] += hit @ x
        some = np.flatnonzero(weight)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(weight[some]), pa.array(cost[some]),
                                          pa.array(list(sums[some]), pa.list_(pa.float64()))], ["at", "weight", "cost", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for b in batches:
            sums = b.column("sums").flatten().to_numpy().reshape(b.num_rows, -1)
            for i, (at, w, c) in enumerate(zip(*[b.column(x).to_pylist() for x in ("at", "weight", "cost")], strict=True)):
                old = totals.get(at, (0.0, 0.0, 0.0))
                totals[at] = (old[0] + w, old[1] + c, old[2] + sums[i])
        if totals:
            w, c, v = zip(*totals.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array(w), pa.array(c),
                                              pa.array(v, pa.list_(pa.float64()))], ["at", "weight", "cost", "sums"])

    schema = "at long, weight double, cost double, sums array<double>"
    found = rows.mapInArrow(run, schema).repartition("at").mapInArrow(merge, schema).toArrow()  # a row a centre
    weight, cost, sums = np.zeros(len(stacked)), np.zeros(len(stacked)), np.zeros_like(stacked)
    at = found["at"].to_numpy()
    if len(at):
        weight[at], cost[at] = found["weight"].to_numpy(), found["cost"].to_numpy()
        sums[at] = found["sums"].combine_chunks().flatten().to_numpy().reshape(len(at), -1)
    return {k: (weight[low:high], sums[low:high], float(cost[low:high].sum()))
            for k, low, high in zip(ks, edges[:-1], edges[1:], strict=True)}


def _candidates(rows: DataFrame, most: int, seed: int, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """k-means|| candidates for ``most`` clusters and the weight of the rows nearest to each."""
    first = rows.orderBy(F.xxhash64("x", F.lit(seed))).limit(1).toArrow()
    found = np.array(first["x"].to_pylist(), float)
    for i in range(rounds):
        total = _step(rows, {0: found})[0][2]
        if total <= 0:
            break
        have, share = found, 2 * most / total

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
                d = np.concatenate([_distances(x[at:at + ROWS_AT_ONCE], have).min(1) for at in range(0, len(x), ROWS_AT_ONCE)])  # noqa: B023
                hit = b.column("u").to_numpy() < share * d * b.column("w").to_numpy()  # noqa: B023
                yield b.select(["x"]).filter(pa.array(hit))

        uniform = (F.pmod(F.xxhash64("x", F.lit(seed + i + 1)), F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("u")
        drawn = rows.select("x", "w", uniform).mapInArrow(draw, "x array<double>").toArrow()  # about 2 x most
        if drawn.num_rows:
            found = np.unique(np.concatenate([found, np.array(drawn["x"].to_pylist(), float)]), axis=0)
    return found, _step(rows, {0: found})[0][0]


def _plus_plus(points: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ among weighted candidates, refined by Lloyd steps among them."""
    rng = np.random.default_rng([seed, k])
    chosen = [points[rng.choice(len(points), p=weight / weight.sum())]]
    while len(chosen) < min(k, len(points)):
        d = weight * _distances(points, np.array(chosen)).min(1)
        if d.sum() <= 0:
            break
        chosen.append(points[rng.choice(len(points), p=d / d.sum())])
    centres = np.array(chosen)
    for _ in range(30):
        near = _distances(points, centres).argmin(1)
        hit = (near == np.arange(len(centres))[:, None]) * weight
        some = hit.sum(1) > 0
        new = np.where(some[:, None], hit @ points / np.maximum(hit.sum(1), 1e-300)[:, None], centres)
        if np.allclose(new, centres, rtol=0, atol=1e-12):
            break
        centres = new
    return centres


def _moved(weight: np.ndarray, sums: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """New centres; one without rows stays where it is."""
    return np.where(weight[:, None] > 0, sums / np.maximum(weight, 1e-300)[:, None], centres)


def _lloyd_rows(x: np.ndarray, w: np.ndarray, centres: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, float]:
    """Iterations over rows in memory."""
    def nearest(c: np.ndarray) -> np.ndarray:
        return np.concatenate([_distances(x[i:i + ROWS_AT_ONCE], c).argmin(1) for i in range(0, len(x), ROWS_AT_ONCE)])

    for _ in range(max_iter):
        near = nearest(centres)
        hit = np.zeros((len(centres), len(x)))
        hit[near, np.arange(len(x))] = w
        new = _moved(hit.sum(1), hit @ x, centres)
        shift, centres = ((new - centres) ** 2).sum(1).max(), new
        if shift <= tol * tol:
            break
    gap = x - centres[nearest(centres)]
    return centres, float((w * (gap * gap).sum(1)).sum())


def _lloyd_local(rows: DataFrame, starts: dict[int, np.ndarray], max_iter: int, tol: float) -> dict[int, tuple[np.ndarray, float]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            k = b.column("k").to_numpy()
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
            for one in np.unique(k).tolist():
                held.setdefault(one, []).append((x[k == one], b.column("w").to_numpy()[k == one]))
        for one, parts in held.items():
            centres, cost = _lloyd_rows(*[np.concatenate(p) for p in zip(*parts, strict=True)], starts[one], max_iter, tol)
            yield pa.RecordBatch.from_arrays([pa.array([one], pa.int32()), pa.array([centres.ravel().tolist()], pa.list_(pa.float64())),
                                              pa.array([cost])], ["k", "centres", "cost"])

    spread = rows.select(F.explode(F.array(*[F.lit(k) for k in starts])).alias("k"), "x", "w").repartition(len(starts), "k")
    found = spread.mapInArrow(run, "k int, centres array<double>, cost double").collect()  # a row a k
    return {r.k: (np.array(r.centres).reshape(len(starts[r.k]), -1), r.cost) for r in found}


def lloyd(rows: DataFrame, starts: dict[int, np.ndarray], max_iter: int = 300, tol: float = 1e-4) -> dict[int, tuple[np.ndarray, float]]:
    """Centres and cost for every k, from the given starts.  A centre without rows stays where it is."""
    if rows.count() * next(iter(starts.values())).shape[1] <= LOCAL_CELLS:
        return _lloyd_local(rows, starts, max_iter, tol)
    centres, moving, rows = dict(starts), set(starts), packed_rows(rows)
    for _ in range(max_iter):
        for k, (weight, sums, _) in _step(rows, {k: centres[k] for k in moving}, costs=False).items():
            new = _moved(weight, sums, centres[k])
            if ((new - centres[k]) ** 2).sum(1).max() <= tol * tol:
                moving.discard(k)
            centres[k] = new
        if not moving:
            break
    return {k: (centres[k], cost) for k, (_, _, cost) in _step(rows, centres).items()}


def kmeans_all(rows: DataFrame, ks: Sequence[int], seed: int = 42, max_iter: int = 300, tol: float = 1e-4) -> dict[int, tuple[np.ndarray, float]]:
    """Centres and training cost for each k in ``ks`` over (x, w) rows (``weighted_rows``)."""
    points, weight = _candidates(rows, max(ks), seed)
    return lloyd(rows, {k: _plus_plus(points, weight, k, seed) for k in ks}, max_iter, tol)


def model_of(spark: SparkSession, centres: np.ndarray, features: str, prediction: str) -> KMeansModel:
    """Spark's own, saveable model with the given centres (equal ones once)."""
    centres = np.unique(centres, axis=0)
    points = spark.createDataFrame([(c.tolist(),) for c in centres], "x array<double>").select(array_to_vector("x").alias(features))
    # as many clusters as points: each point is its own centre
    return KMeans(k=max(2, len(centres)), initMode="random", maxIter=1, seed=1, featuresCol=features,
                  predictionCol=prediction).fit(points)
