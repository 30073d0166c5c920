"""Connected components by alternating large and small stars, all on Spark; only counts reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, save


#: Up to so many edges a task can take all that one node has. Beyond it, a node with a FEWth of all edges is joined by broadcast:
#: at most 2 * FEW nodes are.
EDGES, FEW = 1 << 20, 50_000


def _with_least(edges: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with m, the smallest v of u in groups. No node has more than a FEWth of the edges in one task."""
    if total <= EDGES:
        return edges.join(groups.groupBy("u").agg(F.min("v").alias("m")), "u").select("u", "v", "m")
    low = groups.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    many = -(-total // FEW)
    hot = low.where(F.col("n") >= many).select(F.col("u").alias("hu"), F.col("m").alias("hm"))
    met = edges.join(F.broadcast(hot), F.col("u") == F.col("hu"), "left")
    rest = met.where("hu is null").select("u", "v").join(low.where(F.col("n") < many).select("u", "m"), "u")
    return met.where("hu is not null").select("u", "v", F.col("hm").alias("m")).union(rest.select("u", "v", "m"))


def _large(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both.where("v > u"), both, 2 * total).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    met = _with_least(down, down, total)
    return met.select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v), longs: returns (node, component), the smallest node reachable, for every node of an edge that is not itself smallest.

    Self-loops, repeated edges and either direction are fine; nulls are ignored. Each round is a written table, so a lost
    executor costs a stage and not the history. A node with many links never meets in one task: groups keep only a minimum,
    and the joins back can be split.
    """
    given = edges.where("u is not null and v is not null and u <> v")
    now = save(_small(given, given.count()).distinct(), "cc")
    state = None
    while True:
        stars = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).collect()[0]
        if tuple(stars) == state or not stars["n"]:
            break
        state = tuple(stars)
        after = save(_small(_large(now, stars["n"]), stars["n"]).distinct(), "cc")
        drop(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
