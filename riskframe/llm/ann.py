"""Approximate nearest neighbours over robust-pruned directed graphs, one per shard.

*Index.*  Distinct vectors are dealt to shards by a hash: about ``SHARD`` vectors in each, more
with the square root of all vectors of their length, up to ``SHARD_BYTES``, as every query looks into
every shard.  A task builds the graph of a shard: points enter in batches, a greedy beam search from
the medoid proposes neighbours, and relaxed distance pruning keeps the diverse ones (a
candidate goes if a chosen neighbour p* has ``ALPHA`` * d(p*, p') <= d(p, p')); back
edges are pruned the same way when a node overflows.  The graphs are written to the
shared folder, one row per vector, so that no row or batch grows with the shard.

*Search.*  The queries are written to the shared folder once.  A task gets the rows of a shard and reads
the queries there in blocks, so that neither index nor queries are copied for each other; it holds
one shard and one block.  Every shard is searched for every query by
beam search in double precision; distances of the nearest found are recomputed on the
original vectors, and the best of all shards are ranked, ties to the smaller id.
A query ``FAR`` times larger than a shard's vectors is compared with all of them.

Equal vectors are one node that carries its k + 1 smallest ids: more can never be among
the k nearest of a query, so no row is lost to a vector that many rows share.

Vectors that are null, empty, zero or hold null or non-finite components take no part;
neither do rows without id, and vectors are only compared with vectors of their length.
Rows with the query's own id are not its neighbours.  Repeated rows (same id and
vector) count once.  Recall is measured against brute force in the tests.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, file_system
from .embed_dedup import valid

#: vectors of a shard: so many, or so many times the square root of their number, while they have at most so many bytes
SHARD, GROWTH, SHARD_BYTES = 4096, 16, 32 << 20
#: queries searched at once, fewer in a shard of more than 16,384 vectors
BLOCK = 1024
DEGREE = 32
#: neighbours a node may gather before it is pruned again
SLACK = 48
ALPHA = 1.2
BUILD_BEAM = 64
SEARCH_BEAM = 160
#: a query so many times larger than a shard's vectors hardly tells them apart: it is compared with all of them
FAR = 1 << 20
#: nodes expanded at once
EXPAND = 4
BATCH = 256


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x (B, d) to its own rows of y (B, m, d)."""
    diff = y - x[:, None, :]
    return np.einsum("bmd,bmd->bm", diff, diff)


def beam_search(points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray,
                beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances), both (B, beam), nearest first; -1 where fewer were found.
    graph: (n, degree) neighbours, -1 for none."""
    b, n = len(queries), len(points)
    ids = np.full((b, beam), -1, np.int64)
    dist = np.full((b, beam), np.inf, points.dtype)
    ids[:, 0] = start
    dist[:, 0] = _distances(queries, np.broadcast_to(points[start], (b, 1, points.shape[1])))[:, 0]
    fresh = np.zeros((b, beam), bool)
    fresh[:, 0] = True
    seen = np.zeros((b, n), bool)
    seen[:, start] = True
    active = np.arange(b)
    while len(active):
        rank = np.cumsum(fresh[active], axis=1)
        chosen = fresh[active] & (rank <= EXPAND)
        row, col = np.nonzero(chosen)
        new = np.full((len(active), EXPAND, graph.shape[1]), -1, np.int64)
        new[row, rank[row, col] - 1] = graph[ids[active[row], col]]
        fresh[active[row], col] = False
        new = new.reshape(len(active), -1)
        # each neighbour once: not seen before, and the first of equal ones in this step
        order = np.sort(new, axis=1)
        first = np.ones_like(order, bool)
        first[:, 1:] = order[:, 1:] != order[:, :-1]
        ok = first & (order >= 0) & ~seen[active[:, None], order]
        r, c = np.nonzero(ok)
        found = order[r, c]
        seen[active[r], found] = True
        d = np.full(order.shape, np.inf, points.dtype)
        diff = points[found] - queries[active[r]]
        d[r, c] = np.einsum("nd,nd->n", diff, diff)
        all_ids = np.concatenate([ids[active], np.where(ok, order, -1)], 1)
        all_dist = np.concatenate([dist[active], d], 1)
        all_fresh = np.concatenate([fresh[active], ok], 1)
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(all_ids, best, 1)
        dist[active] = np.take_along_axis(all_dist, best, 1)
        fresh[active] = np.take_along_axis(all_fresh, best, 1)
        active = active[fresh[active].any(1)]
    return ids, dist


def robust_prune(points: np.ndarray, own: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """(B, DEGREE): pruned neighbours of the points ``own`` among the candidates (B, C), -1 for none."""
    cand = np.where(cand == own[:, None], -1, cand)
    order = np.sort(cand, axis=1)
    order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
    cand = order
    y = points[np.maximum(cand, 0)]
    d = np.where(cand >= 0, _distances(points[own], y), np.inf)
    sort = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, sort, 1), np.take_along_axis(d, sort, 1)
    y = np.take_along_axis(y, sort[:, :, None], 1)
    square = np.einsum("bmd,bmd->bm", y, y)
    among = np.maximum(square[:, :, None] + square[:, None, :] - 2 * y @ y.transpose(0, 2, 1), 0)
    alive = np.isfinite(d)
    out = np.full((len(own), DEGREE), -1, np.int64)
    rows = np.arange(len(own))
    for k in range(DEGREE):
        has = alive.any(1)
        if not has.any():
            break
        pick = alive.argmax(1)
        out[has, k] = cand[rows, pick][has]
        alive &= ~(ALPHA * ALPHA * among[rows, pick] <= d)
        alive[rows, pick] = False
    return out


def build_graph(points: np.ndarray, seed: int = 3) -> tuple[np.ndarray, int]:
    """(graph, start) of a shard's points."""
    n = len(points)
    graph = np.full((n, SLACK), -1, np.int64)
    middle = points.mean(0)
    start = int(((points - middle) ** 2).sum(1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.r_[start, order[order != start]]
    at = 1
    while at < n:
        batch = order[at:at + min(BATCH, max(1, at))]
        at += len(batch)
        near, _ = beam_search(points, graph, start, points[batch], BUILD_BEAM)
        chosen = robust_prune(points, batch, near)
        graph[batch, :DEGREE] = chosen
        _add_back(points, graph, np.repeat(batch, DEGREE), chosen.reshape(-1))
    return graph, start


def _add_back(points: np.ndarray, graph: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
    """Add the edges target -> source; nodes that overflow are pruned."""
    ok = target >= 0
    source, target = source[ok], target[ok]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, begin, count = np.unique(target, return_index=True, return_counts=True)
    used = (graph[nodes] >= 0).sum(1)
    fits = used + count <= SLACK
    place = np.arange(len(target)) - np.repeat(begin, count)
    whole = np.repeat(fits, count)
    graph[target[whole], (np.repeat(used, count) + place)[whole]] = source[whole]
    over = nodes[~fits]
    if not len(over):
        return
    most = int(count[~fits].max())
    extra = np.full((len(over), most), -1, np.int64)
    row = np.repeat(np.arange(len(over)), count[~fits])
    extra[row, place[~whole]] = source[~whole]
    for s in range(0, len(over), BATCH):
        part = over[s:s + BATCH]
        kept = robust_prune(points, part, np.concatenate([graph[part], extra[s:s + BATCH]], 1))
        graph[part] = -1
        graph[part, :DEGREE] = kept


def _excess(*arrays: np.ndarray) -> int:
    """Binary exponent by which the arrays must shrink so that squares stay finite; 0 for usual sizes."""
    return max(0, int(np.frexp(max(np.abs(a).max() for a in arrays))[1]) - 500)


def _stack(vectors: list) -> np.ndarray:
    return np.array(vectors, np.float64)


def _packed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _unpacked(column: pa.ChunkedArray, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).astype(np.float64, copy=False).reshape(-1, width)


INDEX = "dims int, shard int, pos int, start int, ids array<long>, point binary, edges binary"


def _build_rows(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
    """The index rows of a shard from its (h, ids, vec) rows."""
    part, dims = part.sort_by("h"), key[0].as_py()
    points = _matrix(part["vec"], dims)
    graph, start = build_graph(np.ldexp(points, -_excess(points)))
    n = len(points)
    same = lambda v: pa.array(np.full(n, v, np.int32))
    out = pa.table({"dims": same(dims), "shard": same(key[1].as_py()), "pos": pa.array(np.arange(n, dtype=np.int32)), "start": same(start),
                    "ids": part["ids"], "point": _packed(points), "edges": _packed(graph.astype(np.int32))})
    return pa.Table.from_batches(out.to_batches(max_chunksize=SHARD))


def _asked(paths: Sequence[str], dims: int, most: int) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, vectors) of the written queries of a length, about ``most`` at a time."""
    held: list = []

    def block():
        t = pa.Table.from_batches(held)
        held.clear()
        return t["q"].to_pylist(), _matrix(t["vec"], dims)

    for path in paths:
        fs, name = file_system(path)
        with fs.open_input_file(name) as f:
            for b in pq.ParquetFile(f).iter_batches(most, columns=["q", "dims", "vec"]):
                b = b.filter(pc.equal(b.column("dims"), dims))
                if held and sum(x.num_rows for x in held) + b.num_rows > most:
                    yield block()
                if b.num_rows:
                    held.append(b)
    if held:
        yield block()


def _search_shard(parts: list[pa.RecordBatch], paths: Sequence[str], k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of each query in a shard, given by its index rows in order."""
    t = pa.Table.from_batches(parts)
    parts.clear()
    dims, start, ids = t["dims"][0].as_py(), t["start"][0].as_py(), t["ids"].to_pylist()
    points, graph = _unpacked(t["point"], np.float64, dims), _unpacked(t["edges"], np.int32, SLACK)
    del t
    least = np.array([x[0] for x in ids])
    usual = np.median(np.abs(points).max(1))
    for own_ids, queries in _asked(paths, dims, max(1, min(BLOCK, (BLOCK << 14) // len(points)))):
        shrink = -_excess(points, queries)
        near, _ = beam_search(np.ldexp(points, shrink) if shrink else points, graph, start, np.ldexp(queries, shrink), SEARCH_BEAM)
        far = np.abs(queries).max(1) > FAR * usual
        q, v, s = [], [], []
        for j, own in enumerate(own_ids):
            nodes = near[j][near[j] >= 0]
            if far[j]:
                every = ((points - queries[j]) ** 2).sum(1)
                nodes = np.lexsort((least, every))[:k + 1]
            exact = np.sqrt(((points[nodes] - queries[j]) ** 2).sum(1))
            rows = sorted((float(d), x) for d, node in zip(exact, nodes, strict=True)
                          for x in ids[node] if x != own)[:k]
            q += [own] * len(rows)
            v += [x for _, x in rows]
            s += [d for d, _ in rows]
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()),
                                          pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])


def _search_rows(k: int, paths: Sequence[str]):
    """mapInArrow body: index rows, those of a shard one after the other -> the k nearest of each query found in each shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for b in batches:
            key = b.column("dims").to_numpy().astype(np.int64) << 32 | b.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), b.num_rows]
            for begin, end in zip(cuts, cuts[1:]):
                part = b.slice(begin, end - begin)
                if held and (held[0].column("dims")[0], held[0].column("shard")[0]) != (part.column("dims")[0], part.column("shard")[0]):
                    yield from _search_shard(held, paths, k)
                held.append(part)
        if held:
            yield from _search_shard(held, paths, k)
    return run


def build_index(df: DataFrame, id_col: str, vec_col: str, k: int, scratch: Scratch) -> DataFrame:
    """(dims, shard, pos, start, ids, point, edges): one row per distinct vector, written to the shared folder."""
    rows = (df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
            .where(F.col("id").isNotNull() & valid(F.col("vec"))).withColumn("h", F.xxhash64("vec")))
    # the smallest distinct ids of each vector; the limit on the rank acts in every task before the shuffle
    least = (rows.withColumn("r", F.dense_rank().over(Window.partitionBy("h").orderBy("id"))).where(f"r <= {k + 1}")
             .groupBy("h").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.first("vec").alias("vec")))
    nodes = scratch.keep(least.withColumn("dims", F.size("vec")), "nodes")
    # a row for each length of vectors
    most = F.greatest(F.lit(SHARD), F.least(F.floor(GROWTH * F.sqrt("n")), F.floor(F.lit(SHARD_BYTES) / (F.col("dims") * 8))))
    sizes = scratch.keep(nodes.groupBy("dims").agg(F.count(F.lit(1)).alias("n"))
                         .select("dims", F.ceil(F.col("n") / most).cast("int").alias("shards")), "sizes")
    shards = sizes.agg(F.sum("shards")).first()[0] or 1
    index = scratch.keep(
        nodes.join(F.broadcast(sizes), "dims").withColumn("shard", F.pmod(F.xxhash64("h"), F.col("shards")).cast("int"))
        .select("dims", "shard", "h", "ids", "vec")
        .repartition(2 * shards, "dims", "shard")  # small in bytes, long to build: a task each, as far as hashes allow
        .groupBy("dims", "shard").applyInArrow(_build_rows, INDEX), "index")
    scratch.drop(nodes)
    return index


def search(index: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int, scratch: Scratch) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of each query."""
    asked = scratch.keep(queries.select(F.col(id_col).cast("long").alias("q"), F.col(vec_col).cast("array<double>").alias("vec"))
                         .where(F.col("q").isNotNull() & valid(F.col("vec"))).dropDuplicates(["q", "vec"])
                         .withColumn("dims", F.size("vec")), "queries")
    shards = max(1, index.select("dims", "shard").distinct().count())
    held = index.repartition(2 * shards, "dims", "shard").sortWithinPartitions("dims", "shard", "pos")
    found = scratch.keep(held.mapInArrow(_search_rows(k, asked.inputFiles()), "query_id long, vec_id long, score double"), "found")
    scratch.drop(asked)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
            .withColumn("rank", rank).where(f"rank <= {k}")
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def nearest(df: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int = 10) -> DataFrame:
    """The k nearest rows of every row for which ``is_query`` holds."""
    scratch = Scratch(df.sparkSession, "neighbours")
    index = build_index(df, id_col, vec_col, k, scratch)
    found = search(index, df.where(is_query), id_col, vec_col, k, scratch)
    scratch.drop(index)
    return found
