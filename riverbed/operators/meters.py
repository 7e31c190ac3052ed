"""Meters that open and close, and answers counted against decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A meter opens at the whole budget and closes below this share of it (fixed values).
OPENS, CLOSES = 1.0, 0.8


def hysteresis(used: DataFrame, key: str, share: str, *order: Column) -> DataFrame:
    """``open`` after each reading of a meter, in a total order.

    A reading at the budget or above opens, one below 80 % closes, one in between (or a
    null one) leaves things as they are; a meter begins closed.
    """
    said = F.when(F.col(share) >= OPENS, True).when(F.col(share) < CLOSES, False)
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return used.withColumn("open", F.coalesce(F.last(said, ignorenulls=True).over(w), F.lit(False)))


def tally(answers: DataFrame, cards: DataFrame, keys: list[str], day: str, revision: list[str]) -> DataFrame:
    """One row: how the answers stand against what the system had decided.

    ``answers``: keys, answer (no, yes, star) and the revision's columns, of which the last
    counts; one that was taken back (null) does not.  ``cards``: keys and system (selected,
    kept, blocked).  ``missed`` are stars that were not selected, ``extra`` selected ones
    without a star, ``widened`` blocked ones with a yes or star; an answer without a card
    has no decision, so a star of that kind is missed.
    """
    newest = answers.groupBy(*keys).agg(F.max_by("answer", F.struct(*revision)).alias("answer")).filter(F.col("answer").isin("no", "yes", "star"))
    decided = newest.join(cards.groupBy(*keys).agg(F.first("system").alias("system")), keys, "left")
    said, system = F.col("answer"), F.coalesce("system", F.lit(""))
    return decided.agg(
        F.count_distinct(day).alias("days"),
        F.count(F.lit(1)).alias("answered"),
        *(F.count_if(said == a).alias(a) for a in ("no", "yes", "star")),
        F.count_if((said == "star") & (system != "selected")).alias("missed"),
        F.count_if((said != "star") & (system == "selected")).alias("extra"),
        F.count_if((said != "no") & (system == "blocked")).alias("widened"),
    )
