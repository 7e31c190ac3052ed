"""Visit counting: repeat suppression anchored on counted views, then a rate cap."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.functions.calendar import local_day

REPEAT_MINUTES, PER_MINUTE = 30, 60


def suppress(minutes: list[int], after: int = REPEAT_MINUTES) -> list[bool]:
    """Which views are first: a repeat falls within ``after`` minutes of the last first one."""
    out, anchor = [], None
    for m in minutes:
        first = anchor is None or m - anchor >= after
        out.append(first)
        anchor = m if first else anchor
    return out


def first_views(views: DataFrame) -> DataFrame:
    """The views that count: ``client, path, ts, event_id``.

    ``views``: client, path, ts, event_id.  A view within 30 whole minutes of the last
    counted one of the same client, business day and path is a repeat; of the rest, the
    first 60 of a client in a minute count, and a capped view is no anchor.  Of one path's
    views in a minute only the earliest can count, so views shrink to these before they
    move.  A path's minutes of a day (1,440 at most) are then folded by themselves; only
    where a client asks for more than 60 paths in a minute do its paths have to be folded
    together, that day alone.
    """
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000)
    least = F.min(F.struct("ts", "event_id")).alias("v")
    each = views.withColumns({"day": local_day(F.col("ts")), "m": minute}).groupBy("client", "day", "path", "m").agg(least)
    crowded = each.groupBy("client", "day", "m").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PER_MINUTE).select("client", "day").distinct()
    begin = F.struct(F.lit(None).cast("bigint").alias("m"), F.array().cast("array<bigint>").alias("kept"))
    step = lambda s, x: F.when(s["m"].isNull() | (x["m"] - s["m"] >= REPEAT_MINUTES), F.struct(x["m"].alias("m"), F.concat(s["kept"], F.array(x["m"])).alias("kept"))).otherwise(s)
    alone = each.join(crowded, ["client", "day"], "left_anti").groupBy("client", "day", "path").agg(F.sort_array(F.collect_list(F.struct("m", "v"))).alias("all"))
    kept = alone.withColumn("kept", F.aggregate("all", begin, step)["kept"])
    single = kept.select("client", "path", F.explode(F.filter("all", lambda x: F.array_contains("kept", x["m"]))).alias("x")).select("client", "path", "x.v.ts", "x.v.event_id")

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["m", "ts", "event_id"], kind="stable")
        anchors: dict[str, int] = {}
        now, used, marks = None, 0, []
        for path, m in zip(frame["path"], frame["m"], strict=True):
            if m != now:
                now, used = m, 0
            anchor = anchors.get(path)
            ok = (anchor is None or m - anchor >= REPEAT_MINUTES) and used < PER_MINUTE
            if ok:
                anchors[path], used = m, used + 1
            marks.append(ok)
        return frame.loc[marks, ["client", "path", "ts", "event_id"]]

    schema = each.select("client", "path", "v.ts", "v.event_id").schema
    busy = each.join(crowded, ["client", "day"], "left_semi").select("client", "day", "path", "m", "v.ts", "v.event_id")
    return single.unionByName(busy.groupBy("client", "day").applyInPandas(fold, schema))


def counted(views: DataFrame) -> DataFrame:
    """All views, with ``counted`` for those that count."""
    hits = first_views(views).select("client", "path", "ts", "event_id", F.lit(True).alias("counted"))
    return views.join(hits, ["client", "path", "ts", "event_id"], "left").withColumn("counted", F.col("counted").isNotNull())
