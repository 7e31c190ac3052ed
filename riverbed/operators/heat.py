"""Time-decayed attention: heat rankings, trends and hourly snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverbed.functions.calendar import seconds_between, shift

WINDOW_HOURS, HALF_LIFE_HOURS, TREND_HOURS = 72, 24, 6
MIN_PARTICIPANTS, MIN_EDITORIAL, TOP = 2, 1, 50


def decay(latest: Column, at: Column, half_life_hours: int = HALF_LIFE_HOURS) -> Column:
    """One, halved for each half-life between the latest evidence and ``at``."""
    return F.pow(F.lit(0.5), seconds_between(latest, at) / (3600.0 * half_life_hours))


def latest_evidence(signals: DataFrame, at: Column, hours: int = WINDOW_HOURS, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for each story and participant with evidence in ``(at - hours, at]``.

    ``signals``: story, participant, editorial (boolean), ts.  A participant counts once,
    by its latest evidence, however many signals it sent; so a hot story's rows shrink to
    its participants before anything else moves.
    """
    inside = signals.filter((F.col("ts") > shift(at, -hours)) & (F.col("ts") <= at))
    return inside.groupBy("story", "participant", *extra).agg(F.max("ts").alias("latest"), F.bool_or("editorial").alias("editorial"))


def heat(evidence: DataFrame, at: Column, *keys: str) -> DataFrame:
    return evidence.groupBy("story", *keys).agg(
        F.round(F.sum(decay(F.col("latest"), at)), 6).alias("heat"),
        F.count(F.lit(1)).alias("participants"),
        F.count_if(F.col("editorial")).alias("editorial"),
        F.max("latest").alias("latest"),
    )


def ranking(signals: DataFrame, at: Column, top: int = TOP) -> DataFrame:
    """The hottest stories with enough participants, at least one of them editorial."""
    found = heat(latest_evidence(signals, at), at).filter((F.col("participants") >= MIN_PARTICIPANTS) & (F.col("editorial") >= MIN_EDITORIAL))
    return found.orderBy(F.desc("heat"), F.desc("latest"), F.asc("story")).limit(top)


def index(heat: Column) -> Column:
    """Heat as it is shown: times ten, to one decimal, halves up."""
    return F.floor(F.round(heat, 6) * 100 + 0.5) / 10


def trend(signals: DataFrame, sources: DataFrame, at: Column, hours: int = TREND_HOURS, window_hours: int = WINDOW_HOURS) -> DataFrame:
    """Heat now against some hours earlier, with badges.

    ``sources``: participant, behind (its evidence may be incomplete), since (observed from
    then on).  Where a story has participants that cannot be compared, only the others are;
    if none of these had heat before, the change is unknown.  Up or down begins beyond a
    tenth; ``surge`` is half of the participants, three at least, new in the last hours,
    ``rising`` a growth of more than 15 % without a surge, ``fresh`` a first report in the
    last hours.
    """
    before = shift(at, -hours)
    inside = signals.filter((F.col("ts") > shift(before, -window_hours)) & (F.col("ts") <= at))
    now = F.col("ts") > shift(at, -window_hours)
    ends = inside.groupBy("story", "participant").agg(F.max(F.when(now, F.col("ts"))).alias("last"), F.min(F.when(now, F.col("ts"))).alias("first"), F.max(F.when(F.col("ts") <= before, F.col("ts"))).alias("earlier"))
    known = ends.join(sources, "participant", "left").withColumn("odd", F.coalesce("behind", F.lit(False)) | F.coalesce(F.col("since") > shift(before, -window_hours), F.lit(False)))
    total = lambda when, instant, only: index(F.coalesce(F.sum(F.when(only, decay(F.col(when), instant))), F.lit(0.0)))
    every, even = F.lit(True), ~F.col("odd")
    rows = known.groupBy("story").agg(
        F.count("last").alias("participants"),
        total("last", at, every).alias("heat_now"),
        total("earlier", before, every).alias("heat_before"),
        total("last", at, even).alias("now_even"),
        total("earlier", before, even).alias("before_even"),
        F.bool_or("odd").alias("odd"),
        F.count_if(F.col("first") > before).alias("recent"),
    )
    first = signals.filter(F.col("ts") <= at).groupBy("story").agg(F.min("ts").alias("begun"))
    cur, prev = F.when(F.col("odd"), F.col("now_even")).otherwise(F.col("heat_now")), F.when(F.col("odd"), F.col("before_even")).otherwise(F.col("heat_before"))
    rows = rows.filter("participants > 0").join(first, "story").withColumn("change", F.when(prev > 0, (cur - prev) / prev))
    change, surge = F.col("change"), (F.col("recent") >= 3) & (F.col("recent") * 2 >= F.col("participants"))
    direction = F.when(F.col("heat_before") <= 0, "new").when(change.isNull(), "unknown").when(change > 0.1, "up").when(change < -0.1, "down").otherwise("flat")
    return rows.select(
        "story", "heat_now", "heat_before", direction.alias("trend"), (F.floor(change * 1000 + 0.5) / 10).alias("trend_pct"), surge.alias("surge"), (F.col("begun") > before).alias("fresh"), F.coalesce(~surge & (change > 0.15), F.lit(False)).alias("rising")
    )


def hourly(signals: DataFrame, hours: DataFrame, window_hours: int = WINDOW_HOURS) -> DataFrame:
    """Heat of every story at each hour of a spine ``(hour)``.

    Each signal is filed under the few hours whose window holds it; only a participant's
    latest one before an hour counts there.
    """
    # of one participant's signals for a story only the last in each hour can be its latest
    inside = signals.groupBy("story", "participant", F.date_trunc("hour", F.col("ts") - F.expr("interval 1 microsecond")).alias("of")).agg(F.max("ts").alias("ts"))
    span = F.sequence(F.date_trunc("hour", "ts"), shift(F.date_trunc("hour", "ts"), window_hours), F.expr("interval 1 hour"))
    spread = inside.withColumn("hour", F.explode(span)).filter((F.col("ts") <= F.col("hour")) & (F.col("ts") > shift(F.col("hour"), -window_hours)))
    spread = spread.withColumn("hour", F.col("hour").cast("timestamp_ntz")).join(hours, "hour", "left_semi")
    one = spread.groupBy("story", "hour", "participant").agg(F.max("ts").alias("latest"))
    return one.groupBy("story", "hour").agg(F.round(F.sum(decay(F.col("latest"), F.col("hour"))), 6).alias("heat"), F.count(F.lit(1)).alias("participants"))


def behind(fetches: DataFrame, sources: DataFrame, at: Column) -> DataFrame:
    """Sources without a good fetch within three intervals or 90 minutes, the longer of them."""
    last = fetches.filter("ok").groupBy("source").agg(F.max("ts").alias("last_ok"))
    limit = F.greatest(3 * F.col("interval_minutes"), F.lit(90)) * 60
    late = F.col("last_ok").isNull() | (seconds_between(F.col("last_ok"), at) > limit)
    return sources.join(last, "source", "left").withColumn("behind", late)
