"""Connected components of a large graph as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvian.session import written


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (u, v) that is not the smallest of its component; root is the smallest.

    Large-star and small-star rounds (Kiveris and others, 2014): each round hangs neighbours below the smallest one, until
    every edge leads straight to its root; the number of rounds grows with the log of a component's size. Minima are
    combined before the shuffle, and a hub's edges meet its one minimum in a join, which Spark may split, so no list of
    neighbours is ever collected. Null ends and loops are ignored; repeated links count once.
    """
    u, v = F.col("u"), F.col("v")
    edges = written(links.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    seen = _signature(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where(v > u).join(lowest, "u").select(v.alias("u"), F.col("m").alias("v"))
                 .where(u != v).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = (hung.select(v.alias("u"), F.col("m").alias("v")).where(u != v)
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        edges = written(small)
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    return edges.select(u.alias("node"), v.alias("root"))
