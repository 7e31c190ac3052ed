"""Hourly heat kept as a table: snapshots, repair of incomplete hours, backfill, late signals.

The table has a row for each story and hour (``story, hour, heat, participants, editorial,
complete``) in Parquet, a folder for each business day.  An hour is incomplete while a
source of one of its participants is behind.  Every run works out which hours and stories
it has to write from the stored rows alone, computes those from the signals, and replaces
only the days in which something changed, so a run that has nothing to do writes nothing.
A run that was cut off is repeated: the values depend on the signals only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.functions.calendar import shift
from riverbed.operators.heat import WINDOW_HOURS, decay, index
from riverbed.sources.feeds import replace_partitions

#: Hours of history that a backfill goes back (a fixed value).
BACKFILL_HOURS = 7 * 24
SCHEMA = "story long, hour timestamp_ntz, heat double, participants long, editorial long, complete boolean"


def hourly_rows(signals: DataFrame, wanted: DataFrame, clocks: DataFrame | None, window_hours: int = WINDOW_HOURS) -> DataFrame:
    """Heat of the wanted ``(story, hour)``.

    ``signals``: story, participant, editorial, ts; ``clocks``: participant, fetched_to (its
    source has been read up to there) or None where no source can be behind.  A participant
    counts once an hour, by its latest signal in the hours before; stories without any have
    no row.  An hour is complete if the sources of all its participants were read past it.
    Each signal meets the hours of its own story that its window reaches, no others.
    """
    # of a participant's signals between two full hours only the last can count
    upto = F.date_trunc("hour", F.col("ts") - F.expr("interval 1 microsecond")) + F.expr("interval 1 hour")
    last = signals.filter("story is not null and participant is not null and ts is not null").groupBy("story", "participant", upto.cast("timestamp_ntz").alias("first_hour")).agg(F.max("ts").alias("ts"), F.bool_or("editorial").alias("editorial"))
    hours = F.sequence(F.col("first_hour"), shift(F.col("first_hour"), window_hours), F.expr("interval 1 hour"))
    spread = last.withColumn("hour", F.explode(hours)).filter((F.col("ts") <= F.col("hour")) & (F.col("ts") > shift(F.col("hour"), -window_hours)))
    spread = spread.join(wanted.select("story", "hour").distinct(), ["story", "hour"], "left_semi")
    one = spread.groupBy("story", "hour", "participant").agg(F.max("ts").alias("latest"), F.bool_or("editorial").alias("editorial"))
    if clocks is None:
        one = one.withColumn("behind", F.lit(False))
    else:
        known = clocks.groupBy("participant").agg(F.max("fetched_to").alias("fetched_to"))
        one = one.join(known, "participant", "left").withColumn("behind", F.coalesce(F.col("fetched_to") < F.col("hour"), F.lit(False)))
    return one.groupBy("story", "hour").agg(
        index(F.sum(decay(F.col("latest"), F.col("hour")))).alias("heat"),
        F.count(F.lit(1)).alias("participants"),
        F.count_if(F.col("editorial")).alias("editorial"),
        (~F.bool_or("behind")).alias("complete"),
    )


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows; none before its first run."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA + ", day date").parquet(path).drop("day")


def merge(spark: SparkSession, path: str, rows: DataFrame, staging: str) -> int:
    """Put rows in the place of those of their story and hour; returns how many differ from what was stored.

    Only days in which a row is new or another one are written, each with its other rows.
    The new content is written beside the table before a day is replaced, since a day
    cannot be read and written at once.
    """
    old = stored(spark, path)
    values = ["heat", "participants", "editorial", "complete"]
    was = old.select("story", "hour", F.struct(*values).alias("was"))
    changed = rows.select("story", "hour", *values).join(was, ["story", "hour"], "left").filter(~F.struct(*values).eqNullSafe(F.col("was"))).drop("was")
    part = f"{staging.rstrip('/')}/heat-{uuid.uuid4().hex}"
    changed.withColumn("day", F.to_date("hour")).write.parquet(f"{part}/changed")
    new = spark.read.parquet(f"{part}/changed")
    n = new.count()
    if n:
        days = new.select("day").distinct()
        kept = old.withColumn("day", F.to_date("hour")).join(days, "day", "left_semi").join(new.select("story", "hour"), ["story", "hour"], "left_anti")
        kept.select(new.columns).unionByName(new).write.parquet(f"{part}/days")
        # the day is the only key of the write's shuffle, so a day is one file or few
        whole = spark.read.parquet(f"{part}/days")
        replace_partitions(whole.repartition("day", F.pmod(F.xxhash64("story"), F.lit(8))), path, "day")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return n


def snapshot_hours(signals: DataFrame, hour: Column, window_hours: int = WINDOW_HOURS) -> DataFrame:
    """``(story, hour)`` of the stories with a signal in the window of one hour."""
    inside = signals.filter((F.col("ts") <= hour) & (F.col("ts") > shift(hour, -window_hours)))
    return inside.select("story", hour.cast("timestamp_ntz").alias("hour")).distinct()


def incomplete_hours(kept: DataFrame, hour: Column, window_hours: int = WINDOW_HOURS) -> DataFrame:
    """The ledger of a repair: stored hours of the window before ``hour`` that are not complete."""
    return kept.filter(~F.col("complete") & (F.col("hour") < hour) & (F.col("hour") > shift(hour, -window_hours))).select("story", "hour")


def snapshot(spark: SparkSession, path: str, signals: DataFrame, clocks: DataFrame, at: Column, staging: str) -> dict[str, int]:
    """Store the hour of ``at`` and repair what earlier hours lacked.

    Incomplete hours are computed anew; those that are complete now take the place of
    what stood there, the others stay as they are, for a later run.
    """
    hour = F.date_trunc("hour", at).cast("timestamp_ntz")
    stories = merge(spark, path, hourly_rows(signals, snapshot_hours(signals, hour), clocks), staging)
    open_ = incomplete_hours(stored(spark, path), hour)
    repaired = merge(spark, path, hourly_rows(signals, open_, clocks).filter("complete"), staging)
    return {"stories": stories, "repaired": repaired}


def backfill_hours(signals: DataFrame, stories: DataFrame, at: Column, hours: int = BACKFILL_HOURS, window_hours: int = WINDOW_HOURS) -> DataFrame:
    """``(story, hour)`` of each story from its first signal to the end of its last one's window, at most ``hours`` back."""
    ends = signals.join(stories.select("story").distinct(), "story", "left_semi").groupBy("story").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    end = F.date_trunc("hour", F.least(at, shift(F.col("last"), window_hours)))
    start = F.greatest(F.date_trunc("hour", "first"), shift(end, -hours))
    spine = ends.withColumn("end", end.cast("timestamp_ntz")).withColumn("start", start.cast("timestamp_ntz")).filter("start <= end")
    return spine.select("story", F.explode(F.sequence("start", "end", F.expr("interval 1 hour"))).alias("hour"))


def backfill(spark: SparkSession, path: str, signals: DataFrame, stories: DataFrame, clocks: DataFrame, at: Column, staging: str) -> int:
    """Compute the hours of some stories over their history, after an import or a regrouping."""
    return merge(spark, path, hourly_rows(signals, backfill_hours(signals, stories, at), clocks), staging)


def late_hours(late: DataFrame, now: Column, window_hours: int = WINDOW_HOURS) -> DataFrame:
    """``(story, hour)`` that late signals change: the hours up to now whose window holds them."""
    first = F.date_trunc("hour", F.col("ts") - F.expr("interval 1 microsecond")) + F.expr("interval 1 hour")
    last = F.least(F.date_trunc("hour", now), F.date_trunc("hour", shift(F.col("ts"), window_hours)))
    span = late.withColumn("a", first.cast("timestamp_ntz")).withColumn("b", last.cast("timestamp_ntz")).filter("a <= b")
    return span.select("story", F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("hour")).distinct()


