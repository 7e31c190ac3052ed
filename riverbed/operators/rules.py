"""Ordered classification rules and bookkeeping over sources, budgets and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverbed.functions.calendar import add_months, local_day, local_midnight, seconds_between, shift


def first_match(*rules: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first rule that holds."""
    out = None
    for when, value in rules:
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(otherwise)


def publisher_priority(tier: Column, owner: Column, subject: Column, role: Column) -> Column:
    """0 best: the fact's own publisher, then first-tier, then reporting, then others."""
    return first_match((owner.isNotNull() & (owner == subject), 0), (tier == "first", 1), (role == "report", 2), otherwise=3)


def participant(owner: Column, source: Column) -> Column:
    """Who speaks: the owner where one is known, else the source itself."""
    return F.when(owner.isNotNull(), F.concat(F.lit("o"), owner.cast("string"))).otherwise(F.concat(F.lit("s"), source.cast("string")))


def featured_since(at: Column, months: int = 3) -> Column:
    """The instant from which picks are featured: business midnight some calendar months ago."""
    return local_midnight(add_months(local_day(at), -months))


def retained(rows: DataFrame, at: Column, days: int, failed_days: int) -> DataFrame:
    """What is kept: recent rows, failed ones for longer."""
    age = seconds_between(F.col("ts"), at) / 86400
    return rows.filter(age <= F.when(F.col("failed"), failed_days).otherwise(days))


def days_left(daily: DataFrame, balances: DataFrame, today: Column, last: int = 7, warn_days: int = 3, floor: int = 0) -> DataFrame:
    """Days that each balance lasts at the mean of the last full days that have spend.

    ``daily``: account, day, micros; ``balances``: account, micros, stale.  Days without
    spend are no part of the mean; without any, or with a stale reading, there is no number.
    """
    past = daily.filter((F.col("day") < today) & (F.col("day") >= F.date_sub(today, last)) & (F.col("micros") > 0))
    mean = past.groupBy("account").agg(F.sum("micros").alias("spent"), F.count_distinct("day").alias("days"))
    joined = balances.join(mean, "account", "left")
    left = F.when(~F.col("stale"), F.try_divide(F.col("micros") * F.col("days"), F.col("spent")))
    state = first_match((F.col("stale"), "stale"), (left < warn_days, "warn"), (left.isNull() & (F.col("micros") < floor), "warn"), otherwise="ok")
    return joined.select("account", F.round(left, 6).alias("days_left"), state.alias("state"))


def midnight_placeholders(readings: DataFrame) -> DataFrame:
    """Sources whose clock readings are all midnight (three at least, two days): only their dates count."""
    clock = F.date_format("ts", "HH:mm:ss") == "00:00:00"
    return readings.groupBy("source").agg(F.count(F.lit(1)).alias("readings"), F.count_distinct(F.col("ts").cast("date")).alias("days"), F.bool_and(clock).alias("midnight")).withColumn("date_only", (F.col("readings") >= 3) & (F.col("days") >= 2) & F.col("midnight"))


def readings_agree(a: Column, b: Column, a_clock: Column, b_clock: Column) -> Column:
    """Two readings of one date: the same instant, or the same business day unless both have clocks."""
    return (a == b) | ((local_day(a) == local_day(b)) & ~(a_clock & b_clock))


def closed_periods(today: Column, day: Column, unit: str) -> Column:
    """The start of the week or month a day lies in, null while that period is open."""
    start = F.trunc(day, unit)
    return F.when(start < F.trunc(today, unit), start)


def versions_to_compare(versions: DataFrame) -> DataFrame:
    """For each text its current version (else the newest) and the next older one of its language that differs.

    ``versions``: doc, version, lang, current, hash.
    """
    w = Window.partitionBy("doc").orderBy(F.desc("current"), F.desc("version"))
    new = versions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("doc", F.col("version").alias("new"), F.col("lang").alias("_lang"), F.col("hash").alias("_hash"))
    older = versions.join(new, "doc").filter((F.col("lang") == F.col("_lang")) & (F.col("hash") != F.col("_hash")) & (F.col("version") < F.col("new")))
    return new.select("doc", "new").join(older.groupBy("doc").agg(F.max("version").alias("old")), "doc", "left")


def repair_window(reports: DataFrame, links: DataFrame, at: Column, hours: int = 72) -> DataFrame:
    """All reports of the facts that a recent report touches. ``reports``: id, ts; ``links``: fact, id."""
    recent = reports.filter((F.col("ts") > shift(at, -hours)) & (F.col("ts") <= at)).select("id")
    facts = links.join(recent, "id", "left_semi").select("fact").distinct()
    return links.join(facts, "fact", "left_semi")


def cohort_heat(signals: DataFrame, at: Column, hours: int = 48) -> DataFrame:
    """Heat over the sources that were there for the whole window, so that two times compare. ``signals``: story, participant, since, ts."""
    old = signals.filter(F.col("since") <= shift(at, -hours)).withColumn("editorial", F.lit(True))
    from riverbed.operators.heat import heat, latest_evidence

    return heat(latest_evidence(old, at, hours), at).select("story", "heat", "participants")
