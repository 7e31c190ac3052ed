"""Versioned series: the version that counts, earlier periods, changes, conversions, holds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverbed.operators.joins import asof_backward
from riverbed.operators.latest import latest_per_key


def current_versions(prices: DataFrame) -> DataFrame:
    """Each period's version: the newest first fetched, then released, then by label."""
    return latest_per_key(prices, ["series", "period"], F.desc("first_fetched"), F.desc_nulls_last("released"), F.desc("label"))


def percent_change(now: Column, before: Column) -> Column:
    """Percent to one decimal, halves away from zero, never minus zero; null without a positive base."""
    exact = (now - before) * 100 / before
    return F.when(before > 0, F.round(exact, 1).cast("decimal(18,1)"))


def with_previous(versions: DataFrame) -> DataFrame:
    """Each period beside the nearest earlier one of its series."""
    w = Window.partitionBy("series").orderBy("period")
    before = versions.withColumns({"previous_period": F.lag("period").over(w), "previous": F.lag("value").over(w), "next_period": F.lead("period").over(w)})
    return before.withColumn("change", percent_change(F.col("value"), F.col("previous")))


def converted(versions: DataFrame, rates: DataFrame, within_days: int) -> DataFrame:
    """Values in another currency at the rate of the period's end or some days earlier."""
    joined = asof_backward(versions, rates, ["currency"], "period_end", "day", within_days, ["rate"])
    return joined.withColumn("converted", (F.col("value") * F.col("rate")).cast("decimal(28,6)"))


#: How far a value may be from the one before it, as a ratio, by the series' frequency (fixed values).
BANDS = {"day": (0.5, 2.0), "week": (0.67, 1.5), "ten_day": (0.67, 1.5), "month": (0.5, 2.0)}


def judge(periods: list[dict], band: tuple[float, float]) -> list[dict]:
    """Verdicts on a source's periods, each ``{series: value}``, in their order.

    A value whose ratio to the stored period before leaves the band is held alone; the next
    period's value releases it if it is within the band of it, and else discards it and is judged
    against the last accepted one.  A period is refused whole if a value is not above zero,
    if it has not half of the series of the stored period before, or if two series or more, and more
    than half of those compared, jump at once: that is a misreading.  A refused period
    changes nothing.
    """
    within = lambda value, base: band[0] <= value / base <= band[1]
    out: list[dict] = []
    before: dict = {}
    accepted: dict = {}
    held: dict = {}
    for k, values in enumerate(periods):
        jumps, decided, compared = set(), {}, 0
        sound = all(v is not None and v > 0 for v in values.values()) and 2 * len(values) >= len(before)
        for key, value in values.items() if sound else ():
            base = before.get(key)
            if key in held:
                compared += 1
                decided[key] = "released" if within(value, periods[held[key]][key]) else "discarded"
                base = None if decided[key] == "released" else accepted.get(key)
            if base is not None:
                compared += 1
                if not within(value, base):
                    jumps.add(key)
        if not sound or len(jumps) >= 2 and 2 * len(jumps) > compared:
            out.append(dict.fromkeys(values, "refused"))
            continue
        for key, verdict in decided.items():
            out[held.pop(key)][key] = verdict
        out.append({key: "held" if key in jumps else "accepted" for key in values})
        held |= dict.fromkeys(jumps, k)
        before = {key: v for key, v in values.items() if key not in jumps}
        accepted |= before
    return out


def plausibility(versions: DataFrame, frequency: str) -> DataFrame:
    """``source, series, period, value, verdict``: the verdict on each value of each period.

    ``versions``: source, series, period, value, one row for a series and period.  The walk is
    in the order of the periods, over all series of a source at once, since a jump of most of
    them holds the whole period; a group is one source's periods.
    """
    schema = "source long, series long, period date, value double, verdict string"

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["period", "series"], kind="stable")
        periods = [dict(zip(p["series"], (None if pd.isna(v) else v for v in p["value"]), strict=True)) for _, p in frame.groupby("period", sort=False)]
        said = judge(periods, BANDS[frequency])
        return frame.assign(verdict=[v for one in said for v in one.values()])

    plain = versions.select("source", "series", "period", F.col("value").cast("double").alias("value"))
    return plain.groupBy("source").applyInPandas(walk, schema)
