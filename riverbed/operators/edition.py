"""An issue's main entries and flashes, round-ups folded into what they mention; copies folded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riverbed.functions.calendar import local_day
from riverbed.operators.latest import first_per_key

#: Main entries of an issue and of a source, flashes, and sources that make a follow-up an entry (fixed values).
MAIN, PER_SOURCE, FLASHES, FOLLOW_UP_SOURCES = 12, 2, 10, 3


def fold_copies(reports: DataFrame) -> DataFrame:
    """``id, keeper, copies``: reports with one title on one business day are copies of one.

    ``reports``: id, key (of the title, null where it is too short to tell reports apart),
    at, official.  The copy that stays is an official one, then the earliest, then the least id; a
    report without a key or time is its own.
    """
    keyed = reports.withColumn("day", local_day(F.col("at"))).filter("key is not null and day is not null")
    first = keyed.groupBy("key", "day").agg(F.min_by("id", F.struct(~F.coalesce("official", F.lit(False)), F.col("at"), F.col("id"))).alias("keeper"), F.count(F.lit(1)).alias("copies"))
    found = reports.withColumn("day", local_day(F.col("at"))).join(first, ["key", "day"], "left")
    return found.select("id", F.coalesce("keeper", "id").alias("keeper"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))


def arrange(entries: DataFrame) -> DataFrame:
    """``issue, part, place, id, n_sources, folded``: each issue's main entries and flashes.

    ``entries``: issue, id, rank (the order, one number an entry), story, importance, source,
    sources and mentions (arrays), previous, commentary, authority.  An entry that mentions
    another one's story is folded into the most important of those (the first mentioned of equals),
    which takes over its sources.  Of the others, those earn a main place that are
    neither follow-ups nor commentary, or have an authority below 3 (and are no commentary),
    or three sources at least; where none does, all may have one.  The walk by rank takes
    twelve, two of a source; skipped entries use up no place, so the first two of each
    source that may have one, and the first twelve of these, are what it takes.  Of the
    rest the first ten are flashes.  No issue's entries meet in one task before the limits.
    """
    hosts = entries.select("issue", F.col("story").alias("mention"), F.col("id").alias("host"), "importance", F.col("rank").alias("host_rank")).filter("mention is not null")
    # of two entries of one story the later one is met
    hosts = hosts.groupBy("issue", "mention").agg(F.max_by(F.struct("host", "importance"), "host_rank").alias("h")).select("issue", "mention", "h.*")
    said = entries.select("issue", "id", "sources", F.posexplode("mentions").alias("at", "mention")).join(hosts, ["issue", "mention"]).filter("host <> id")
    folded = said.groupBy("issue", "id").agg(F.min_by("host", F.struct(-F.col("importance"), F.col("at"))).alias("host"), F.first("sources").alias("more"))
    added = folded.groupBy("issue", "host").agg(F.array_distinct(F.flatten(F.collect_list("more"))).alias("more"), F.count(F.lit(1)).alias("folded")).withColumnRenamed("host", "id")
    live = entries.join(folded.select("issue", "id"), ["issue", "id"], "left_anti").join(added, ["issue", "id"], "left")
    count = F.size(F.array_union(F.coalesce("sources", F.array().cast(entries.schema["sources"].dataType)), F.coalesce("more", F.array().cast(entries.schema["sources"].dataType))))
    live = live.select("issue", "id", "rank", "source", count.alias("n_sources"), F.coalesce("folded", F.lit(0)).cast("long").alias("folded"), "previous", "commentary", "authority")
    earns = (~F.col("previous") & ~F.col("commentary")) | ((F.col("authority") < 3) & ~F.col("commentary")) | (F.col("n_sources") >= FOLLOW_UP_SOURCES)
    live = live.withColumn("earns", F.coalesce(earns, F.lit(False)))
    any_earns = live.groupBy("issue").agg(F.bool_or("earns").alias("any"))
    may = live.join(any_earns, "issue").filter("earns or not any").drop("any")
    main = first_per_key(first_per_key(may, ["issue", "source"], PER_SOURCE, F.asc("rank")), ["issue"], MAIN, F.asc("rank"))
    # ten that are not main are among the first twenty-two
    near = first_per_key(live, ["issue"], MAIN + FLASHES, F.asc("rank")).join(main.select("issue", "id"), ["issue", "id"], "left_anti")
    flashes = first_per_key(near, ["issue"], FLASHES, F.asc("rank"))
    both = main.withColumn("part", F.lit("main")).unionByName(flashes.withColumn("part", F.lit("flash")))
    place = F.row_number().over(Window.partitionBy("issue", "part").orderBy("rank"))
    return both.select("issue", "part", place.alias("place"), "id", "n_sources", "folded")
