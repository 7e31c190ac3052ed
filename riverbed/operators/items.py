"""Reading items: gates, filters and the places of cards.

Gates and filters are conditions over columns, so they reach the scan with whatever else a
query filters by; a parameter that is None leaves its filter out.  ``items`` hold:
visibility, is_original_post, admission_required, selected, candidate, eligible, score,
visible_after, channel, first_party, category, tags, timeline_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverbed.functions.calendar import add_months, local_day, local_midnight

#: Scores below this are left out of lists that nobody searched (a fixed value).
BROWSE_FLOOR = 20
FEATURED_MONTHS = 3


def confirmed() -> Column:
    """Selected, and so by the current projection."""
    return F.col("selected") & F.col("candidate")


def admitted(open_: bool) -> Column:
    """Original posts need a settled classification, unless admission is open."""
    return F.lit(open_) | ~F.col("is_original_post") | F.coalesce(~F.col("admission_required"), F.lit(False))


def listed(now: Column, open_: bool = False) -> Column:
    """Public and admitted; a selected item only after its release."""
    return (F.col("visibility") == "public") & admitted(open_) & (~F.col("selected") | (F.col("visible_after") <= now))


def chosen(now: Column, open_: bool = False) -> Column:
    """The selected set: public, admitted, eligible, confirmed and released."""
    return (F.col("visibility") == "public") & admitted(open_) & F.col("eligible") & confirmed() & (F.col("visible_after") <= now)


def featured(now: Column, open_: bool = False) -> Column:
    """The selected set of the last calendar months of the business day."""
    return chosen(now, open_) & (F.col("timeline_at") >= local_midnight(add_months(local_day(now), -FEATURED_MONTHS)))


def above_floor() -> Column:
    """Items without a score, at the floor or above, and confirmed ones."""
    return F.col("score").isNull() | (F.col("score") >= BROWSE_FLOOR) | confirmed()


def in_channel(channel: str | None) -> Column:
    if channel in (None, "all"):
        return F.lit(True)
    return F.col("first_party") if channel == "firstParty" else F.col("channel") == channel


def in_category(category: str | None, covers: dict[str, list[str]]) -> Column:
    """The category's own key and the stored keys that it covers; keys that are split in several stay out."""
    if category is None:
        return F.lit(True)
    sole = [old for old, new in covers.items() if new == [category]]
    return F.col("category").isin(*covers.get(category, []), category, *sole)


def between_days(start, end) -> Column:
    """``timeline_at`` in ``[start, end)``; either bound may be None."""
    found = F.lit(True)
    for bound, keep in ((start, lambda b: F.col("timeline_at") >= b), (end, lambda b: F.col("timeline_at") < b)):
        if bound is not None:
            found = found & keep(F.lit(bound).cast("timestamp_ntz"))
    return found


def tagged(tags: list[str] | None, text: Column) -> Column:
    """An overlap of the tags, or the text condition of their aliases."""
    return F.lit(True) if tags is None else F.arrays_overlap("tags", F.array(*map(F.lit, tags))) | text


def holds(column: str, value: str) -> Column:
    return F.array_contains(column, value)


def located(code: str, codes: list[str]) -> Column:
    """By geography (``state``, ``jurisdictions``): ``unknown``, ``none`` or any of the codes."""
    if code == "unknown":
        return F.col("state").isNull() | F.col("state").isin("unknown", "partial")
    if code == "none":
        return F.coalesce(F.col("state") == "none", F.lit(False))
    return F.coalesce(F.arrays_overlap("jurisdictions", F.array(*map(F.lit, codes))), F.lit(False))


def word_start(text: Column, word: str) -> Column:
    """Whether a Latin word of the text begins with ``word``, whatever its case."""
    return text.rlike(rf"(?i)(?<![\p{{L}}\p{{N}}_])\Q{word}\E")


def noisy(markers: dict[str, list[str]], title: Column, excerpt: Column, categories: Column) -> Column:
    """Whether a source's own filter drops a candidate.

    ``markers``: deny and allow (categories), keep, drop and drop_title (words, any case).
    Denied categories drop, then categories outside the allowed ones; a keep word saves;
    a drop word in the title, or in title or excerpt, drops.
    """
    low = F.lower(title)
    hay = F.concat(low, F.lit("\n"), F.lower(F.coalesce(excerpt, F.lit(""))))
    any_of = lambda text, words: F.lit(False) if not words else F.greatest(F.lit(False), *(F.contains(text, F.lit(w.lower())) for w in words))
    cats = lambda names: F.coalesce(F.arrays_overlap(categories, F.array(*map(F.lit, names))), F.lit(False))
    denied = cats(markers["deny"]) if markers.get("deny") else F.lit(False)
    outside = ~cats(markers["allow"]) if markers.get("allow") else F.lit(False)
    dropped = ~any_of(hay, markers.get("keep")) & (any_of(low, markers.get("drop_title")) | any_of(hay, markers.get("drop")))
    return denied | outside | dropped


def fact_cards(items: DataFrame, foldable: Column) -> DataFrame:
    """``card, anchor, members``: foldable items of a fact are one card, others their own."""
    card = F.when(F.col("fact_id").isNotNull() & foldable, F.concat(F.lit("f"), F.col("fact_id").cast("string"))).otherwise(F.concat(F.lit("a"), F.col("id").cast("string")))
    return items.groupBy(card.alias("card")).agg(F.min("sort_at").alias("anchor"), F.count(F.lit(1)).alias("members"))


def topic_counts(items: DataFrame, topics: DataFrame, now: Column, page: int = 20) -> DataFrame:
    """Each topic's total, recent (30 days) and latest item, pages and whether it is indexed.

    ``topics``: slug, tags.  An item belongs to a topic whose tags it shares; the topics'
    tags are exploded to meet the items' by equality.  Topics without items stay, with zeros.
    """
    wanted = topics.select("slug", F.explode("tags").alias("tag"))
    hits = items.select("id", "timeline_at", F.explode(F.array_distinct("tags")).alias("tag")).join(wanted, "tag").dropDuplicates(["slug", "id"])
    counted = hits.groupBy("slug").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("timeline_at") > now - F.expr("interval 30 days")).alias("recent"), F.max("timeline_at").alias("latest"))
    out = topics.select("slug").join(counted, "slug", "left").fillna(0, ["total", "recent"])
    indexed = (F.col("total") >= 50) | ((F.col("total") >= 20) & (F.col("recent") > 0))
    return out.select("slug", "total", "recent", "latest", F.greatest(F.lit(1), F.ceil(F.col("total") / page)).cast("bigint").alias("pages"), indexed.alias("indexable"))


def issue_order(entries: DataFrame, recent: DataFrame, penalty: float = 6.0) -> DataFrame:
    """``place`` of each entry in its issue; the first is the lead.

    ``entries``: issue, id, story, freshness, importance, follow_up, developed; ``recent``:
    issue, story of the issues that led before it.  Old entries go last, then those whose
    story led lately without having developed; then importance, less the penalty for a
    follow-up that did not develop; ties by id.
    """
    led = entries.join(recent.select("issue", "story").distinct().withColumn("led", F.lit(True)), ["issue", "story"], "left").withColumn("led", F.col("led").isNotNull())
    late = F.when(F.col("freshness") == "old", 2).otherwise(0) + F.when(F.col("led") & ~F.col("developed"), 1).otherwise(0)
    weight = F.col("importance") - F.when(F.col("follow_up") & ~F.col("developed"), penalty).otherwise(0.0)
    n = F.row_number().over(Window.partitionBy("issue").orderBy(late, weight.desc(), F.asc("id")))
    return led.withColumn("place", n).drop("led")


def fresh_first(board: DataFrame, fresh: DataFrame, by: str) -> DataFrame:
    """Renumber each board (``by``): stories known to be stale below the others, the order kept inside both.

    ``board``: by, rank, story; ``fresh``: story, fresh.  An unknown story keeps its place.
    """
    stale = F.coalesce(~F.col("fresh"), F.lit(False))
    n = F.row_number().over(Window.partitionBy(by).orderBy(stale, "rank"))
    return board.join(fresh, "story", "left").withColumn("place", n).drop("fresh")


def top_facts(candidates: DataFrame, key: str, fact: str, score: str, k: int) -> DataFrame:
    """All members of each key's ``k`` facts with the best single member; ties by the least fact."""
    best = candidates.groupBy(key, fact).agg(F.max(score).alias("_best"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_best"), F.asc(fact)))
    return candidates.join(best.withColumn("_n", n).filter(F.col("_n") <= k).select(key, fact), [key, fact], "left_semi")
