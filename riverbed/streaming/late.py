"""Late and unreliable signals: what is filed where, and which stored hours it changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.functions.calendar import shift
from riverbed.operators import heat_store

#: Hours after which a find is stale, and by which a claimed time may lie ahead (fixed values).
STALE_HOURS, FUTURE_HOURS = 48, 1


def filed(rows: DataFrame, claimed: str = "claimed", discovered: str = "discovered", given: Column | None = None) -> DataFrame:
    """``published, reason, filed_at, historical`` beside each row.

    A claimed time more than an hour ahead of the find is none.  Reasons for a backfill: the
    one given, no claimed time, or a find more than 48 hours late; a backfill is filed under its claimed
    time if it has one, all else under the find's.  A backfill without a claimed time, or that
    late, is history: it adds no heat.
    """
    found, said = F.col(discovered), F.col(claimed)
    published = F.when(said <= shift(found, FUTURE_HOURS), said)
    stale = F.coalesce(published < shift(found, -STALE_HOURS), F.lit(False))
    given = F.lit(None).cast("string") if given is None else F.nullif(given, F.lit(""))
    reason = F.coalesce(given, F.when(published.isNull(), "unknown-publication-time").when(stale, "stale-on-discovery"))
    backfill = reason.isNotNull()
    return rows.select("*", published.alias("published"), reason.alias("reason"), F.when(backfill & published.isNotNull(), published).otherwise(found).alias("filed_at"), (backfill & (published.isNull() | stale)).alias("historical"))


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


class LateHeat:
    """A sink for ``foreachBatch`` that keeps signals, dead letters and the hourly heat up to date.

    ``root`` is a folder that all executors see.  A batch is written under its number, so one
    that is run again after a failure replaces itself; the heat is computed from the stored signals,
    so that repeats and the order of the files do not matter.  Signals that are history, or
    have no story, participant or find, go to the dead letters with the reason.
    """

    def __init__(self, root: str):
        self.signals, self.letters, self.heat, self.staging = (f"{root.rstrip('/')}/{name}" for name in ("signals", "letters", "heat", "staging"))

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = filed(batch)
        broken = F.col("story").isNull() | F.col("participant").isNull() | F.col("discovered").isNull()
        dead = broken | F.col("historical")
        rows = rows.withColumn("batch", F.lit(number)).withColumn("why", F.when(broken, "incomplete").when(F.col("historical"), F.col("reason")))
        for path, part in ((self.letters, rows.filter(dead)), (self.signals, rows.filter(~dead).drop("why"))):
            part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        if not _exists(spark, f"{self.signals}/batch={number}"):
            return
        kept = spark.read.parquet(self.signals).filter(F.col("batch") <= number).withColumn("ts", F.col("filed_at"))
        clock = kept.agg(F.max("discovered").alias("now"), F.max(F.when(F.col("batch") < number, F.col("discovered"))).alias("before")).first()
        now = F.lit(clock.now).cast("timestamp_ntz")
        wanted = heat_store.late_hours(kept.filter(F.col("batch") == number), now)
        if clock.before is not None:
            # the hours that have passed since, for whatever still has heat then
            before = F.lit(clock.before).cast("timestamp_ntz")
            recent = kept.filter(F.col("ts") > shift(before, -heat_store.WINDOW_HOURS - 1))
            wanted = wanted.union(heat_store.late_hours(recent, now).filter(F.col("hour") > F.date_trunc("hour", before))).distinct()
        touched = kept.join(wanted.select("story").distinct(), "story", "left_semi").select("story", "participant", "editorial", "ts")
        heat_store.merge(spark, self.heat, heat_store.hourly_rows(touched, wanted, None), self.staging)


def run(arrivals: DataFrame, sink: LateHeat, checkpoint: str, late: str = "3 days") -> None:
    """Run the stream over what is there now.

    ``arrivals``: event_id, story, participant, editorial, claimed, discovered (timestamp).  An
    event that is sent again within the watermark counts once.
    """
    once = arrivals.withWatermark("discovered", late).dropDuplicatesWithinWatermark(["event_id"])
    plain = once.withColumn("claimed", F.col("claimed").cast("timestamp_ntz")).withColumn("discovered", F.col("discovered").cast("timestamp_ntz"))
    plain.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
