"""Change logs: upserts, revisions, ledgers and snapshots as of a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverbed.operators.latest import latest_per_key


def merge_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old table with the new rows put in by key; the new row wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_per_key(both, keys, F.desc("_new")).drop("_new")


def changed(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """What a full state change means: ``op`` upsert for new or differing rows, remove for missing ones."""
    a = old.select(*keys, F.struct(*columns).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(*keys, F.struct(*columns).alias("_new"), F.lit(True).alias("_in_new"))
    both = a.join(b, keys, "full_outer")
    op = F.when(F.col("_in_new").isNull(), "remove").when(F.col("_in_old").isNull() | ~F.col("_old").eqNullSafe(F.col("_new")), "upsert")
    return both.withColumn("op", op).filter("op is not null").select(*keys, "op", *(F.col(f"_new.{c}").alias(c) for c in columns))


def revisions(materials: DataFrame, key: str, order: list[Column], *parts: str) -> DataFrame:
    """Number a material's revisions: a new one only where the content hash changes."""
    collapsed = [F.trim(F.regexp_replace(F.coalesce(F.col(p).cast("string"), F.lit("")), r"\s+", " ")) for p in parts]
    hashed = materials.withColumn("content_hash", F.sha2(F.concat_ws("\u0001", *collapsed), 256))
    w = Window.partitionBy(key).orderBy(*order)
    fresh = ~F.coalesce(F.lag("content_hash").over(w) == F.col("content_hash"), F.lit(False))
    return hashed.withColumn("_fresh", fresh).withColumn("revision", F.sum(F.col("_fresh").cast("int")).over(w)).filter("_fresh").drop("_fresh")


def release_watermark(ledger: DataFrame, at: Column) -> DataFrame:
    """The last sequence number below which every row is released (one row)."""
    held = F.min(F.when(F.col("visible_at") > at, F.col("seq")))
    return ledger.agg((F.coalesce(held, F.max("seq") + 1) - 1).alias("watermark"))


def snapshot(ledger: DataFrame, key: str, watermark: Column) -> DataFrame:
    """The state that the ledger describes up to a watermark."""
    return latest_per_key(ledger.filter(F.col("seq") <= watermark), [key], F.desc("seq")).filter("op = 'upsert'")
