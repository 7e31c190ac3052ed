"""Connected components by alternating large and small stars (distributed union-find).

Each round is two grouped minima joined back to the edges, so no node's neighbours are
ever gathered in one place; the edges are written to the shared folder after each round.
Once a round has left at most SMALL edges, the next one works in a single partition, which
spares the shuffles of rounds that have next to nothing to do; the steps are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.llm.common import cut, delete

#: A table of at most so many rows of a few numbers is read as one partition.
SMALL = 100_000


def is_small(written: DataFrame) -> bool:
    """Whether a written table has at most SMALL rows."""
    return written.limit(SMALL + 1).count() <= SMALL


def _in_one(df: DataFrame) -> DataFrame:
    return df.coalesce(1)


def _as_dealt(df: DataFrame) -> DataFrame:
    return df


def _both_ways(edges: DataFrame, second: str) -> DataFrame:
    """Each edge ``u -> v`` and ``v -> second``, without a union, which would add a partition."""
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col(second).alias("v")))
    return edges.select(F.explode(ways).alias("e")).select("e.u", "e.v")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges ``u -> v`` are stars: one edge for each u, and no v is a u."""
    counts = edges.groupBy("u").agg(F.count(F.lit(1)).alias("c"))
    twice = counts.filter("c > 1").select(F.lit(1).alias("x"))
    chained = edges.join(counts.select(F.col("u").alias("v")), "v", "left_semi").select(F.lit(1).alias("x"))
    return twice.unionByName(chained).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the undirected edges ``(u, v)``.

    ``component`` is the smallest node that can be reached.  Loops, repeated edges and
    either direction are fine; edges with a null end are ignored; no edges, no rows.
    """
    tidy = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").filter("u is not null and v is not null")
    now = cut(tidy.distinct(), "edges")
    while True:
        # a join forgets that its sides are one partition, so each step says it again
        held = _in_one if is_small(now) else _as_dealt
        edges = held(now)
        if _settled(edges):
            return _both_ways(edges, "v").select(F.col("u").alias("node"), F.col("v").alias("component")).dropDuplicates(["node"])
        both = _both_ways(edges, "u")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = held(both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        to_least = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = held(large.join(least.hint("merge"), "u").select(F.explode(to_least).alias("e")).select("e.u", "e.v").filter("u <> v")).distinct()
        after = cut(small, "edges")
        delete(now)
        now = after
