"""Merge chains, connected components and threads over relations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _kept(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, where the session has one."""
    sc = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        return df.cache()
    path = f"{folder.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def resolve_chain(pointers: DataFrame, hops: int = 10) -> DataFrame:
    """Follow ``(node, target)`` pointers to the end of their chain.

    Returns ``node, root``; the root is null (not found) where the chain has more hops than
    allowed, runs in a circle or points to what is no node.  A null target ends a chain.
    Steps are doubled, so ten hops take four joins.
    """

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        return first.select("node", F.col("root").alias("_via")).join(second.select(F.col("node").alias("_via"), "root"), "_via", "left").select("node", "root")

    step = pointers.select("node", F.coalesce("target", "node").alias("root"))
    found, left = None, hops
    while left:
        if left & 1:
            found = step if found is None else then(found, step)
        left >>= 1
        step = then(step, step) if left else step
    ends = pointers.filter("target is null").select("node", F.col("node").alias("root"))
    return then(found, ends)


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` by spreading the least label and jumping over it until nothing changes."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u is not null and v is not null").distinct()
    # merge joins at every size: labels grow with the table, and no round sends them to the driver
    both = _kept(both)
    labels = _kept(both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("label")).withColumnRenamed("u", "node"))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label").hint("merge"), "v").groupBy("u").agg(F.min("label").alias("near"))
        spread = labels.join(near.withColumnRenamed("u", "node").hint("merge"), "node").withColumn("next", F.least("label", "near"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        jumped = F.least("next", F.coalesce("far", "next"))
        after = _kept(spread.join(jump.hint("merge"), "next", "left").select("node", jumped.alias("label"), F.col("label").alias("before")))
        if after.filter("label <> before").isEmpty():
            return after.select("node", F.col("label").alias("component"))
        labels = after.select("node", "label")


def threads(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each node's thread: the earliest anchor of its component; undated anchors come last.

    ``anchors``: node, day (null if unknown).  Nodes without an edge are their own thread.
    """
    found = anchors.join(components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = found.groupBy("component").agg(F.min(F.struct(F.col("day").isNull().alias("undated"), F.col("day"), F.col("node"))).alias("f"))
    return found.join(first, "component").select("node", "component", F.col("f.node").alias("thread"))
