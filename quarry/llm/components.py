"""Connected components by alternating large-star and small-star.

Edges are rows of two 64-bit node ids. Each round joins every edge with the least
neighbour of its ends; the graph turns into stars whose centres are the least ids of the
components, after a number of rounds that grows with the logarithm of the longest
path. Least neighbours are aggregates with a partial step before the shuffle, so a hub sends one
row per task; the join of its edges with its one row of minima is a skewed join that
adaptive execution splits. Nothing about edges or components comes to the driver but a count
and a checksum, which tell when a round changed nothing. Every round is written to the shared
folder, so lineage stays short and a lost executor costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return moved.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v")


def components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges, the component being its least node.

    Loops and repeated edges are allowed; rows with a null end are left out. No edges, no rows."""
    e = cut(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    for _ in range(rounds):
        after = cut(_small_star(_large_star(e)).distinct(), "cc")
        discard(e)
        e = after
        sign = tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
        if sign == before:
            break
        before = sign
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
