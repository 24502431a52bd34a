"""Shards of near-equal bytes by a k-d tree over metadata (DataFrame functions only).

The tree starts with all rows and the number of shards wanted.  A node that stands
for k shards is split along its widest metadata dimension (range within the node
over range of the whole table) at the weighted quantile floor(k/2)/k, until each
leaf is one shard.  Weights are bytes.

*Distributed weighted medians.*  All nodes of a level are split together.  Each pass
sums the bytes of ``BUCKETS`` equal key ranges per node (partial aggregation, no row
is moved) and narrows every node's range to the bucket in which its quantile lies,
until that bucket is light or a single key.  Only one row per node reaches the
driver, and only the split table (at most one row per shard) is broadcast.

*Dimensions.*  Numbers are scaled to 31 bits between the table's extremes, texts are
placed by their CRC-32; null takes the lowest place.  Keys are (place, tie), the tie
being a hash of the text, so equal texts stay together; a group of equal texts above
``GROUP_SHARE`` of a shard is cut into chunks by a salted hash of its rows, so that it
neither unbalances a shard nor meets in one task.  A group's metadata are the
smallest of its rows.

*Slots* number the rows of a shard from 0 without gaps: rows are ranked inside hash
buckets of a shard and shifted by the row counts of the buckets before.

Null text: no bytes (weight ``ROW_BYTES``), CRC 0.  Null ids and repeated rows are
rows like any other.  Fewer rows than shards leave shards empty; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: bytes that a row counts besides its text
ROW_BYTES = 16
BUCKETS = 4096
#: largest part of a shard that a group of equal texts may be and stay whole
GROUP_SHARE = 0.1
#: bytes, as a part of a shard, below which a bucket is not narrowed further
LIGHT = 0.0005
SLOT_ROWS = 4096
PLACES = (1 << 31) - 1


def _places(df: DataFrame, dims: list[str]) -> tuple[list[Column], list]:
    """31-bit place of each dimension; numbers need the table's extremes (one pass)."""
    number = [d for d in dims if isinstance(df.schema[d].dataType, T.NumericType)]
    ends = df.agg(*[f(F.col(d).cast("double")) for d in number for f in (F.min, F.max)]).first() if number else []
    out = []
    for d in dims:
        if d in number:
            low, high = ends[2 * number.index(d)], ends[2 * number.index(d) + 1]
            span = (high - low) if low is not None and high > low else 1.0
            place = F.floor((F.col(d).cast("double") - F.lit(low or 0.0)) / F.lit(span) * F.lit(PLACES - 1)) + 1
        else:
            place = F.crc32(F.col(d).cast("string").cast("binary")) % PLACES + 1
        out.append(F.coalesce(place.cast("long"), F.lit(0).cast("long")))
    return out, ends


def _rows(df: DataFrame, id_col: str, text_col: str, dims: list[str], shards: int | None, target_bytes: int,
          scratch: Scratch) -> tuple[DataFrame, int]:
    """(node, id, size, crc, salt, tie, p0..): what the tree needs of each row, and the shard count."""
    named = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                      *[F.col(d).alias(f"m{i}") for i, d in enumerate(dims)])
    places, _ = _places(named, [f"m{i}" for i in range(len(dims))])
    text = F.coalesce("text", F.lit(""))
    rows = scratch.keep(named.select(
        "id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("same"),
        F.xxhash64("id", F.monotonically_increasing_id() % 65536).alias("salt"),
        *[p.alias(f"p{i}") for i, p in enumerate(places)]), "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    n = shards or max(1, -(-total // target_bytes))
    cap = max(1.0, GROUP_SHARE * total / n)
    groups = rows.groupBy("same", "size", "crc").agg(
        F.ceil(F.sum("size") / cap).cast("int").alias("chunks"),
        *[F.min(f"p{i}").alias(f"p{i}") for i in range(len(dims))], F.count(F.lit(1)).alias("n"))
    # only groups of several rows have anything to share or to cut
    shared = groups.where("n > 1").drop("n")
    joined = rows.alias("r").join(shared.alias("g"), ["same", "size", "crc"], "left")
    chunk = F.pmod("salt", F.coalesce("chunks", F.lit(1)))
    return scratch.keep(joined.select(
        F.lit(0).cast("long").alias("node"), "id", "size", "crc", "salt", F.xxhash64("same", chunk).bitwiseAND(F.lit(PLACES)).alias("tie"),
        *[F.coalesce(f"g.p{i}", f"r.p{i}").alias(f"p{i}") for i in range(len(dims))]), "placed"), int(n)


def _key(n_dims: int) -> Column:
    """Key of a row in its node's split dimension."""
    place = F.element_at(F.array(*[f"p{i}" for i in range(n_dims)]), F.col("dim") + 1)
    return F.shiftleft(place, 31).bitwiseOR(F.col("tie"))


def _values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small table of numbers from the driver, as SQL values; columns: "name type, ..."."""
    names = [c.split() for c in columns.split(", ")]
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in names])
    data = ", ".join("(" + ", ".join(f"{v:f}D" if isinstance(v, float) else f"{v}L" for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in names)} "
                     f"FROM VALUES {data} AS t({', '.join(n for n, _ in names)})")


def _split(rows: DataFrame, nodes: list[dict], n_dims: int, light: float) -> list[dict]:
    """Cuts of all nodes (dicts with node, dim, want and the range low..high); key < cut goes left."""
    spark = rows.sparkSession
    open_nodes, done = [n | {"below": 0} for n in nodes], []
    while open_nodes:
        level = _values(spark, [(n["node"], n["dim"], n["low"], -(-(n["high"] - n["low"] + 1) // BUCKETS),
                                 n["high"], float(n["want"] - n["below"])) for n in open_nodes],
                        "node bigint, dim int, low bigint, width bigint, high bigint, want double")
        keyed = rows.join(F.broadcast(level), "node").withColumn("key", _key(n_dims)).where("key between low and high")
        sums = (keyed.groupBy("node", F.expr("(key - low) div width").alias("bucket"))
                .agg(F.sum("size").alias("bytes"), F.min("key").alias("first"), F.max("key").alias("last"),
                     F.first("want").alias("want")))
        before = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        hit = (sums.withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
               .where("before < want and before + bytes >= want").collect())  # one row a node
        by = {r.node: r for r in hit}
        again = []
        for n in open_nodes:
            r = by[n["node"]]
            n["low"], n["high"], n["below"] = r["first"], r["last"], n["below"] + r["before"]
            if r["first"] < r["last"] and r["bytes"] > light:
                again.append(n)
            else:  # the cut before or after this key, whichever is nearer to the quantile
                right = n["want"] - n["below"] < r["bytes"] / 2
                done.append(n | {"cut": r["first"] if right else r["last"] + 1})
        open_nodes = again
    return done


def kd_shards(df: DataFrame, id_col: str, text_col: str, dims: list[str], shards: int | None = None,
              target_bytes: int = 1 << 30) -> DataFrame:
    """(id, size, crc, shard, slot) per input row.  ``shards``: how many; without it
    as many as ``target_bytes`` asks for."""
    scratch = Scratch(df.sparkSession, "sharding")
    placed, n_shards = _rows(df, id_col, text_col, dims, shards, target_bytes, scratch)
    n_dims = len(dims)
    extremes = [f(f"p{i}").alias(f"{f.__name__}{i}") for i in range(n_dims) for f in (F.min, F.max)]
    rows = placed
    parts = {0: (0, n_shards)}  # node -> first shard, number of shards
    span = None
    light, depth = None, 0
    while any(k > 1 for _, k in parts.values()):
        stats = {r.node: r for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *extremes).collect()}
        if span is None and stats:
            whole = stats[0]
            light = LIGHT * whole["bytes"] / n_shards
            span = [max(1, whole[f"max{i}"] - whole[f"min{i}"]) for i in range(n_dims)]
        todo, cuts = [], []
        for node, (first, k) in parts.items():
            if k == 1 or node not in stats:
                continue
            r = stats[node]
            width = [(r[f"max{i}"] - r[f"min{i}"]) / span[i] for i in range(n_dims)]
            dim = width.index(max(width))
            todo.append({"node": node, "dim": dim, "want": r["bytes"] * (k // 2) / k,
                         "low": r[f"min{dim}"] << 31, "high": (r[f"max{dim}"] << 31) | PLACES})
        cuts = _split(rows, todo, n_dims, light) if todo else []
        level = _values(df.sparkSession, [(c["node"], c["dim"], c["cut"]) for c in cuts],
                        "node bigint, dim int, cut bigint")
        rows = (rows.join(F.broadcast(level), "node", "left")
                .withColumn("node", F.when(F.col("cut").isNull(), F.col("node") * 2)
                            .otherwise(F.col("node") * 2 + (_key(n_dims) >= F.col("cut")).cast("long")))
                .drop("dim", "cut"))
        parts = {m: v for node, (first, k) in parts.items() for m, v in
                 (((2 * node, (first, k)),) if k == 1 else
                  ((2 * node, (first, k // 2)), (2 * node + 1, (first + k // 2, k - k // 2))))}
        depth += 1
        if depth % 8 == 0:
            rows = scratch.keep(rows, "level")
    names = _values(df.sparkSession, [(m, first) for m, (first, _) in parts.items()], "node bigint, shard int")
    named = rows.join(F.broadcast(names), "node").select("id", "size", "crc", "salt", "shard")
    return _with_slots(named, scratch)


def _with_slots(rows: DataFrame, scratch: Scratch) -> DataFrame:
    kept = scratch.keep(rows, "shards")
    most = kept.groupBy("shard").count().agg(F.max("count")).first()[0] or 1
    parts = -(-most // SLOT_ROWS)
    dealt = kept.withColumn("part", F.pmod("salt", F.lit(parts)).cast("int"))
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "salt", "crc")) - 1
    return (dealt.withColumn("rank", rank).join(offsets, ["shard", "part"])
            .select("id", "size", "crc", "shard", (F.col("offset") + F.col("rank")).cast("long").alias("slot")))
