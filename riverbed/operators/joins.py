"""Joins that Spark has no word for: as-of, intervals, lateral tops, prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_day: str, right_day: str, within_days: int, values: list[str]) -> DataFrame:
    """To each left row the latest right row of its key on that day or up to some days earlier.

    Both sides are laid out on one time line for each key and the last right row is
    carried forward, so the work is one shuffle whatever the number of days.
    """
    tagged = left.select(*by, F.col(left_day).alias("_day"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), *(F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values), F.lit(None).cast(right.schema[right_day].dataType).alias("_from"))
    dated = right.select(*by, F.col(right_day).alias("_day"), F.lit(0).alias("_side"), F.lit(None).cast(tagged.schema["_left"].dataType).alias("_left"), *values, F.col(right_day).alias("_from"))
    w = Window.partitionBy(*by).orderBy("_day", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_side") == 0, F.struct("_from", *values)), ignorenulls=True).over(w)
    joined = tagged.unionByName(dated).withColumn("_seen", seen).filter("_side = 1")
    fresh = F.date_diff(F.col("_day"), F.col("_seen._from")) <= within_days
    return joined.select("_left.*", F.when(fresh, F.col("_seen._from")).alias("asof_day"), *(F.when(fresh, F.col(f"_seen.{v}")).alias(v) for v in values))


def in_interval(points: DataFrame, spans: DataFrame, by: list[str], at: str, lo: str, hi: str, width_seconds: int) -> DataFrame:
    """Points inside ``(lo, hi]``, met in time buckets no narrower than most spans."""
    bucket = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (width_seconds * 1_000_000))
    filed = points.withColumn("_bucket", bucket(F.col(at)))
    spread = spans.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(lo)), bucket(F.col(hi)))))
    return filed.join(spread, [*by, "_bucket"]).filter((F.col(at) > F.col(lo)) & (F.col(at) <= F.col(hi))).drop("_bucket")


def lateral_top(left: DataFrame, right: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """Each left row with at most ``k`` right rows of its key, or none (outer)."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return left.join(right.withColumn("_n", n).filter(F.col("_n") <= k).drop("_n"), by, "left")


def overlap_scores(direct: DataFrame, body: DataFrame, key: str, direct_points: int = 3, body_points: int = 1) -> DataFrame:
    """Full outer union of two hit lists, points summed."""
    a = direct.select(key).distinct().withColumn("_d", F.lit(direct_points))
    b = body.select(key).distinct().withColumn("_b", F.lit(body_points))
    return a.join(b, key, "full_outer").select(key, (F.coalesce("_d", F.lit(0)) + F.coalesce("_b", F.lit(0))).alias("points"))


def same_version(left: DataFrame, right: DataFrame, keys: list[str], null_safe: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Join on keys and on versions that may be unknown on both sides (null meets null)."""
    l, r = left.alias("l"), right.alias("r")  # noqa: E741
    parts = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in null_safe or ()]
    match = parts[0]
    for p in parts[1:]:
        match = match & p
    shared = {*keys, *(null_safe or ())}
    return l.join(r, match, how).select("l.*", *(F.col(f"r.{c}") for c in right.columns if c not in shared))


#: Numbers of 64 bits in the map of ``maybe_among``: every task gets 131,072 rows at most (a fixed value).
MAP_WORDS = 1 << 17


def maybe_among(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be one of ``others``; most of those that are none are left out.

    A bit map of a fixed size, by a hash of the keys, goes to every task, so a join behind
    it shuffles little more than what it keeps, however large the sides are.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(64 * MAP_WORDS))
    bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), (s % 64).cast("int"))
    marks = others.select(slot.alias("_slot")).groupBy(F.shiftright("_slot", 6).alias("_word")).agg(F.bit_or(bit(F.col("_slot"))).alias("_bits"))
    placed = df.withColumn("_slot", slot).withColumn("_word", F.shiftright("_slot", 6))
    return placed.join(F.broadcast(marks), "_word").filter(F.col("_bits").bitwiseAND(bit(F.col("_slot"))) != 0).select(df.columns)
