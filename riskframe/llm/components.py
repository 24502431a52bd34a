"""Connected components of a link table, distributed.

Alternating large-star / small-star rounds: every node is re-linked to the
smallest node of its neighbourhood until each one points straight at the
smallest node of its component.  The number of rounds grows with the logarithm
of a component's diameter.  Links never reach the driver; each round is one
written table in the shared folder, so lost executors cost single tasks.
A hub with very many links is reduced with a partial ``min`` before the
shuffle; the join on the hub is a plain equi-join that AQE may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(directed: DataFrame, only_larger: bool) -> DataFrame:
    """``directed``: rows (a, b), b a neighbour of a.  Links neighbours of a to the
    smallest of a and its neighbours: all larger ones (large star) or all (small star)."""
    least = (directed.groupBy("a").agg(F.min("b").alias("m"))
             .select(F.col("a").alias("h"), F.least("a", "m").alias("m")))
    joined = directed.join(least, directed.a == least.h).select("a", "b", "m")
    if only_larger:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
        joined.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(links: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """(node, component) for every node that has a link; component = smallest
    node reachable.  Links may repeat, run either way or join a node to itself;
    null ends are ignored.  No links: an empty table."""
    edges = scratch.keep(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                         .where(F.col(a).isNotNull() & F.col(b).isNotNull())
                         .where("a <> b").distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        stars = scratch.keep(_star(_both_ways(edges), True), "large")
        # after the large star every row is (larger node, smaller node)
        turned = scratch.keep(_star(stars.where("b < a"), False), "small")
        new = _mark(turned)
        scratch.drop(edges, stars)
        edges = turned
        if new == mark:
            break
        mark = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Row count and two order-free checksums: equal after a round that changed nothing."""
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")),
                  F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
    return tuple(r)
