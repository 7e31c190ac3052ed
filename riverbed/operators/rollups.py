"""Aggregations: gap filling, rhythm, multi-dimension rollups, covering contributors, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverbed.functions.calendar import local_day, shift


def fill_gaps(spine: DataFrame, counted: DataFrame, keys: list[str], empty: dict[str, object]) -> DataFrame:
    """Every row of the spine, with zeros where nothing was counted."""
    joined = spine.join(counted, keys, "left")
    return joined.select(*keys, *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in empty.items()))


def rhythm(made: DataFrame, today: Column) -> DataFrame:
    """Days with output, the median gap between them and the days since the last."""
    days = made.select("source", local_day(F.col("ts")).alias("day")).distinct()
    gap = F.date_diff("day", F.lag("day").over(Window.partitionBy("source").orderBy("day")))
    return days.withColumn("gap", gap).groupBy("source").agg(F.count(F.lit(1)).alias("days"), F.expr("percentile(gap, 0.5)").alias("median_gap"), F.date_diff(today, F.max("day")).alias("quiet_days"))


def by_each(rows: DataFrame, dimensions: list[str], *aggregates: Column) -> DataFrame:
    """One aggregate row for each value of each dimension, in a single pass."""
    sides = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions)))
    return rows.withColumn("side", sides).select("*", "side.*").groupBy("dimension", "value").agg(*aggregates)


def half_covering(amounts: DataFrame, key: str, amount: str) -> DataFrame:
    """The largest contributors, up to the one with which half of the total is reached.

    The running sum goes over partial sums of amount ranges first, so that no task sorts
    all contributors: only the range in which the half falls is walked row by row.
    """
    bucket = F.floor(F.log2(F.col(amount).cast("double") + 1)).alias("bucket")
    ranged = amounts.withColumn("bucket", bucket)
    sums = ranged.groupBy("bucket").agg(F.sum(amount).alias("s"))  # at most 64 rows
    above = sums.alias("x").join(sums.alias("y"), F.col("y.bucket") > F.col("x.bucket"), "left").groupBy("x.bucket").agg(F.coalesce(F.sum("y.s"), F.lit(0)).alias("above"))
    total = sums.agg(F.sum("s").alias("total"))
    near = ranged.join(F.broadcast(above.crossJoin(total)), "bucket").filter("above * 2 < total")
    inside = F.sum(amount).over(Window.partitionBy("bucket").orderBy(F.desc(amount), F.asc(key)).rowsBetween(Window.unboundedPreceding, -1))
    return near.withColumn("before", F.col("above") + F.coalesce(inside, F.lit(0))).filter("before * 2 < total").select(key, amount)


def adaptive_interval(seen: DataFrame, at: Column, shortest: Column | int = 15, longest: Column | int = 60) -> DataFrame:
    """Minutes between fetches: a third of the mean distance of the last week's items, clamped.

    At most 0.15 items a day make a source quiet: it takes the longest interval.
    """
    recent = seen.groupBy("source").agg(F.count_if(F.col("ts") > shift(at, -168)).alias("recent"))
    low, high = (b if isinstance(b, Column) else F.lit(b) for b in (shortest, longest))
    wish = F.least(high, F.greatest(low, F.try_divide(F.lit(24 * 60.0), F.col("recent") / 7.0 * 3)))
    return recent.withColumn("interval_minutes", F.when(F.col("recent") / 7.0 <= 0.15, high).otherwise(F.floor(wish + 0.5)).cast("bigint"))


def confusion(rows: DataFrame, key: str) -> DataFrame:
    """Outcome counts of ``gold`` against ``said``; failed rows are errors only."""
    ok, gold, said = ~F.col("failed"), F.col("gold"), F.col("said")
    counted = rows.groupBy(key).agg(F.count_if(ok & gold & said).alias("tp"), F.count_if(ok & ~gold & said).alias("fp"), F.count_if(ok & ~gold & ~said).alias("tn"), F.count_if(ok & gold & ~said).alias("fn"), F.count_if(F.col("failed")).alias("error"))
    share = lambda a, b: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 6)
    return counted.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn")})


def spend_breaker(daily: DataFrame, today: Column, first: Column, floor: int, no_history: int, multiple: int, days: int, warning_millionths: int = 800_000) -> DataFrame:
    """Whether today's spend opens the breaker, or is near to it; in whole micros, without division.

    ``daily``: day, micros; ``first``: the day of the first attempt ever.  History is the
    days since then, ``days`` at most, whether anything was spent on them or not.  With history and some
    spend in it, the breaker opens beyond the floor and beyond a multiple of the mean day;
    without, beyond ``no_history``.  A warning comes at a share of each of these bounds.
    """
    exact = lambda c: c.cast("decimal(38,0)")
    past = (F.col("day") < today) & (F.col("day") >= F.date_sub(today, days))
    spent = lambda when: exact(F.coalesce(F.sum(F.when(when, F.col("micros"))), F.lit(0)))
    row = daily.agg(spent(F.col("day") == today).alias("micros"), spent(past).alias("sum"))
    row = row.withColumn("days", exact(F.coalesce(F.least(F.lit(days), F.greatest(F.lit(0), F.date_diff(today, first))), F.lit(0))))
    historic = (F.col("days") > 0) & (F.col("sum") > 0)
    mean = F.col("sum") * multiple
    opens = F.when(historic, (F.col("micros") > floor) & (F.col("micros") * F.col("days") > mean)).otherwise(F.col("micros") > no_history)
    of = lambda bound: exact(F.col("micros") * 1_000_000) >= exact(F.lit(str(bound * warning_millionths)))
    near = exact(F.col("micros") * F.col("days")) * 1_000_000 >= exact(mean) * warning_millionths
    warns = F.when(historic, of(floor) & near).otherwise(of(no_history))
    return row.select(today.alias("today"), F.col("micros").cast("bigint").alias("micros"), F.col("days").cast("int").alias("days"), opens.alias("open"), warns.alias("warning"))
