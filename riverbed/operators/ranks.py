"""Ordered rules: freshness, importance, when a fact happened, edition entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverbed.functions.calendar import local_day, local_midnight, seconds_between

#: Thresholds (fixed values).
RECOLLECT_HOURS, OLD_GAP_DAYS, LATE_REPORT_HOURS, FOLLOW_UP_HOURS = 48, 4, 72, 6


def freshness(facts: DataFrame) -> DataFrame:
    """``freshness``, ``basis`` and ``occurred_on`` of each report: the first rule that matches.

    ``facts``: reported, recollected_from (an earlier copy of the same source), own_day (a
    day the report's own text states), fact_day and fact_basis, first_reported (of the
    fact), story_reported (of its story).  An earlier copy of the source makes a report
    old; so does a trusted day long before it or, without such a day, a first report long
    before it; a fact that joined its story late is a follow-up; all else is new.
    """
    hours = lambda a, b: seconds_between(F.col(a), F.col(b)) / 3600
    trusted = F.when(F.col("fact_basis").isin("verified", "agreed"), F.col("fact_day"))
    day, copied = F.coalesce("own_day", trusted), F.coalesce(hours("recollected_from", "reported") >= RECOLLECT_HOURS, F.lit(False))
    dated = F.when(F.col("own_day").isNotNull(), "own_date").when(trusted.isNotNull(), "fact_date")
    past = F.coalesce(F.date_diff(local_day(F.col("reported")), day) > OLD_GAP_DAYS, F.lit(False))
    late = day.isNull() & F.coalesce(hours("first_reported", "reported") > LATE_REPORT_HOURS, F.lit(False))
    follows = F.coalesce(hours("story_reported", "first_reported") > FOLLOW_UP_HOURS, F.lit(False))
    kind = F.when(copied | past | late, "old").when(follows, "follow_up").otherwise("new")
    basis = F.when(copied, "recollected").when(late, "late_report").otherwise(F.coalesce(dated, F.lit("no_evidence")))
    return facts.withColumns({"freshness": kind, "basis": basis, "occurred_on": F.when(~copied, day)})


def rank_anchor(placed: DataFrame) -> DataFrame:
    """Where an old report is filed: on its day, at its first report or first copy, never later than listed (``listed_at``)."""
    at = F.when(F.col("basis") == "recollected", F.col("recollected_from")).when(F.col("occurred_on").isNotNull(), local_midnight(F.col("occurred_on"))).when(F.col("basis") == "late_report", F.col("first_reported"))
    return placed.withColumn("rank_anchor", F.when((F.col("freshness") == "old") & at.isNotNull(), F.least(at, F.col("listed_at"))))


def card_anchor(members: DataFrame, card: str) -> DataFrame:
    """A card's place: its earliest member that is not old, or its earliest anchor if all are.  Members: sort_at, rank_anchor."""
    current = F.min(F.when(F.col("rank_anchor").isNull(), F.col("sort_at")))
    return members.groupBy(card).agg(F.coalesce(current, F.min("rank_anchor")).alias("anchor"))


def importance() -> Column:
    """Score (50 without one) and fixed bonuses."""
    return F.coalesce("score", F.lit(50.0)) + F.when(F.col("official"), 5).otherwise(0) + F.when(F.col("major"), 2).otherwise(0) - F.when(F.col("old"), 30).otherwise(0)


def fact_timing(claims: DataFrame) -> DataFrame:
    """When a fact happened: the earliest verified day, else the day most agree on, else the founder's."""
    per_day = claims.groupBy("fact", "day").agg(F.count(F.lit(1)).alias("n"), F.bool_or("verified").alias("verified"), F.bool_or("founder").alias("founder"))
    best = F.min(F.when(F.col("n") >= 2, F.struct((-F.col("n")).alias("n"), "day")))
    found = per_day.groupBy("fact").agg(F.min(F.when(F.col("verified"), F.col("day"))).alias("v"), best.alias("b"), F.min(F.when(F.col("founder"), F.col("day"))).alias("f"))
    basis = F.when(F.col("v").isNotNull(), "verified").when(F.col("b").isNotNull(), "agreed").when(F.col("f").isNotNull(), "founder").otherwise("none")
    return found.select("fact", F.coalesce("v", "b.day", "f").alias("day"), basis.alias("basis"))


#: The most that a vote can be worth by its kind of noise, and with unusable material (fixed values).
NOISE_CAPS = {"none": 100, "out_of_scope": 30, "event_routine": 35, "price_tick": 40, "general_gov": 40, "junior_routine": 55}
UNUSABLE_CAP = 30


def attention(votes: DataFrame, weights: dict[str, dict[str, float]]) -> DataFrame:
    """A vote's score in whole tenths (``tenths``).

    ``votes``: kind, noise (null for none), unusable and the axes; ``weights``: for each
    kind, what an axis weighs.  Axes are clamped to 0-10 and rounded to tenths, summed by
    weight, and capped by noise and by unusable material.  An unknown kind has no score.
    """
    tenths = lambda c: F.floor(F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.coalesce(F.col(c).cast("double"), F.lit(0.0)))) * 10 + 0.5)
    total = F.lit(None).cast("double")
    for kind, axes in weights.items():
        total = F.when(F.col("kind") == kind, sum((tenths(a) * w for a, w in axes.items()), F.lit(0.0))).otherwise(total)
    caps = F.create_map(*(F.lit(x) for pair in NOISE_CAPS.items() for x in pair))
    cap = F.least(F.coalesce(F.try_element_at(caps, F.coalesce("noise", F.lit("none"))), F.lit(100)), F.when(F.col("unusable"), UNUSABLE_CAP).otherwise(100))
    return votes.withColumn("tenths", F.when(total.isNotNull(), F.floor(F.least(total, cap * 10) + 0.5).cast("long")))


def selected(scored: DataFrame, key: str, thresholds: dict[str, float]) -> DataFrame:
    """Whether an item's votes reach its tier's threshold, as a sum over votes in whole tenths.

    ``scored``: the key, tier, tenths.  Without a vote or a threshold nothing is selected.
    """
    sums = scored.groupBy(key, "tier").agg(F.sum("tenths").alias("tenths"), F.count("tenths").alias("votes"))
    needed = F.try_element_at(F.create_map(*(F.lit(x) for k, v in thresholds.items() for x in (k, float(v)))), F.col("tier"))
    return sums.withColumn("selected", F.coalesce((F.col("votes") > 0) & (F.col("tenths") >= F.round(needed * F.col("votes") * 10)), F.lit(False)))


def edition(entries: DataFrame, remembered: DataFrame, per_story: int = 1) -> DataFrame:
    """An issue's entries: one for each story, without stories of the last issues unless followed up."""
    fresh = entries.join(remembered.select("story").distinct().withColumn("seen", F.lit(True)), "story", "left").filter("seen is null or follow_up").drop("seen")
    weight = F.coalesce("score", F.lit(50.0)) + 5 * F.log2(1 + F.col("participants")) + F.when(F.col("official"), 5).otherwise(0) - F.when(F.col("follow_up"), 6).otherwise(0)
    n = F.row_number().over(Window.partitionBy("issue", "story").orderBy(F.desc("weight"), F.asc("id")))
    return fresh.withColumn("weight", F.round(weight, 6)).withColumn("_n", n).filter(F.col("_n") <= per_story).drop("_n")
