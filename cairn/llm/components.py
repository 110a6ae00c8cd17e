"""Connected components of a graph of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long).  node, root: the least node of each node's component; nodes without edges are absent.

    Minima are aggregated and joined back, so that no neighbour list is ever gathered; each step ends in
    a table in the shared folder, so both sides of a join are plain shuffles and Spark can split the
    rows of a node with very many neighbours.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        n, s = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, s) == seen or not n:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        seen = (n, s)
        both = now.union(now.select("b", "a"))
        least = cut(both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = cut(both.join(least, both.a == least.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        lower = cut(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")))
        small = large.join(lower, large.a == lower.u).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("u", "m"))
        old, now = (now, least, large, lower), cut(small.distinct())
        for df in old:
            discard(df)
