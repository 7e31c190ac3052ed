"""Structured Streaming twins of the visit rules: repeats, rate windows, distinct visitors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riverbed.functions.calendar import local_day
from riverbed.operators.visits import REPEAT_MINUTES


def read_events(spark, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_views(views: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Views that are no repeat of a counted one, with state for each client, day and path.

    ``views``: client, path, ts (timestamp), event_id.  The state is the last counted
    minute; it is dropped once the watermark has passed it by the repeat window, so it
    never outgrows half an hour of active keys.
    """
    out = "client long, path string, ts timestamp, event_id long"

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        anchor, keep = (state.get[0] if state.exists else None), []
        for ts in rows["ts"]:
            minute = int(ts.timestamp() // 60)
            first = anchor is None or minute - anchor >= REPEAT_MINUTES
            anchor = minute if first else anchor
            keep.append(first)
        state.update((anchor,))
        state.setTimeoutTimestamp(max((anchor + REPEAT_MINUTES) * 60_000, state.getCurrentWatermarkMs() + 1))
        yield rows[keep][["client", "path", "ts", "event_id"]]

    keyed = views.withWatermark("ts", late).withColumn("day", local_day(F.col("ts")))
    return keyed.groupBy("client", "day", "path").applyInPandasWithState(fold, out, "anchor long", "append", GroupStateTimeout.EventTimeTimeout)


def visitors_by_day(views: DataFrame, late: str = "1 day") -> DataFrame:
    """One row for each client and business day; state lives as long as the day can still grow."""
    return views.withWatermark("ts", late).withColumn("day", local_day(F.col("ts"))).dropDuplicatesWithinWatermark(["client", "day"]).select("day", "client", "ts")


def minute_counts(views: DataFrame, late: str = "5 minutes") -> DataFrame:
    """Views of each client in each tumbling minute, for the rate rule."""
    return views.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "client").agg(F.count(F.lit(1)).alias("views"))


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now, into Parquet."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
