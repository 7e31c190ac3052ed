"""Linking similar sets, given their band keys, without fetching the sets of all pairs of a group.

The members of a bucket (a band key that several sets share) meet one leader, and those
linked with it are one component at once.  Leaders are the sets that meet most others; large
buckets of the same copies take one leader together.  A bucket is settled when its members
but the leader are all connected, so one of two sets is settled by its leader.  Members of
the other buckets meet a few leaders more.

In the buckets that are still open buckets every two members that are not connected yet are held against each
other by size and sketch, inside a join that hands on only pairs that can be links.  Where
sets bring no sketch, one is made of the parities of their items: two sets differ in at
least as many items as their sketches do in bits, so no link is turned away.  A bucket of
more than BLOCK members is dealt into parts, of which any two meet in a task of their own: a
task holds two parts, and what is shuffled is the square of a bucket's size divided by BLOCK.
Comparing sketches is the square of an open bucket's size; sets are fetched for likely pairs
alone, for the closest few of each two components first and for the others where these
are no links.  So no link is lost within a bucket.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverbed.llm.common import cut, delete
from riverbed.llm.components import components, is_small

#: Buckets of more than FEW sets share leaders; of two components so many of the closest
#: pairs are verified first, WIDER times as many of those left next, then all that are left.
FEW, WIDER = 32, 32
#: Further leaders of a bucket that the first one has not settled.
LEADERS = 4
#: Members of a bucket's part, of which two meet in a task.
BLOCK = 1024
#: 64-bit words of a sketch.
SKETCH = 8


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """``(bucket, id)`` of the band keys that at least two sets share."""
    keys = nodes.select("id", F.explode("bands").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("bucket")
    return keys.join(shared.hint("merge"), "bucket").select("bucket", "id")


def bits_apart(a: Column, b: Column) -> Column:
    """In how many bits two sketches differ."""
    return functools.reduce(Column.__add__, (F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(SKETCH)))


def parities(sets: DataFrame) -> DataFrame:
    """``(id, sketch)``: bit b of a sketch is the parity of the items that hash to b."""
    place = sets.select("id", F.explode("items").alias("e")).select("id", F.xxhash64("e").alias("x"))
    word, bit = F.col("x").bitwiseAND(F.lit(SKETCH - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("x", 32).bitwiseAND(F.lit(63)).cast("int"))
    return place.groupBy("id").agg(*(F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(SKETCH))).select("id", F.array(*(f"w{k}" for k in range(SKETCH))).alias("sketch"))


def near_links(members: DataFrame, nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, plausible: Callable[[Column, Column, float], Column] | None) -> tuple[DataFrame, DataFrame]:
    """Links between sets, and their components.

    ``members``: ``(bucket, id)``; ``nodes``: ``(id, n, sketch)`` with the set's size and
    sketch of SKETCH words; ``sets_of(ids)``: ``(id, items)`` with the full sets of those
    ids, distinct items; ``plausible(sketch, sketch, similarity)``: whether two sketches can
    have come from sets of at least that similarity, or None where sketches are to be made
    of the sets.  A link is ``100 * intersection >= percent * union``.  Returns
    ``(a, b, inter, both)``, links enough to connect each component, and
    ``(node, component)``.
    """
    members = cut(members.select("bucket", "id"), "members")
    ids = members.select("id").distinct()
    if plausible:
        small = cut(nodes.join(ids.hint("merge"), "id", "left_semi").select("id", F.col("n").cast("int").alias("n"), "sketch"), "nodes")
        sets = cut(sets_of(small.select("id")), "sets")
    else:
        sets = cut(sets_of(ids), "sets")
        # a set without items has no sketch, and no links
        small = cut(sets.select("id", F.size("items").alias("n")).join(parities(sets).hint("merge"), "id"), "nodes")

    def likely(na: Column, nb: Column, sa: Column, sb: Column) -> Column:
        """Whether sets of these sizes and sketches can be a link."""
        sizes = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
        if plausible:
            return sizes & plausible(sa, sb, percent / 100)
        # a link has so many items in common at least; all others are in one of the two alone
        common = F.ceil(percent * (na + nb) / (100 + percent))
        return sizes & (bits_apart(sa, sb) <= na + nb - 2 * common)

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the written pairs ``(a, b, na, nb)`` that are links."""
        wanted = sets
        if is_small(pairs):
            wanted = sets.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "id", "left_semi")
        items = lambda of, name: wanted.select(F.col("id").alias(of), F.col("items").alias(name))
        full = pairs.select("a", "b", "na", "nb").join(items("a", "ia").hint("merge"), "a").join(items("b", "ib").hint("merge"), "b")
        met = full.select("a", "b", F.size(F.array_intersect("ia", "ib")).alias("inter"), (F.col("na") + F.col("nb")).alias("total"))
        return met.select("a", "b", "inter", (F.col("total") - F.col("inter")).alias("both")).filter(f"100 * inter >= {percent} * both")

    def group_of(df: DataFrame, of: str = "id", name: str = "g") -> DataFrame:
        return df.join(groups.select(F.col("node").alias(of), F.col("component").alias(name)).hint("merge"), of, "left").withColumn(name, F.coalesce(name, of))

    def met_leaders(pairs: DataFrame) -> DataFrame:
        """The links among the pairs ``(a, b, na, nb)`` of members and leaders."""
        sketch = lambda of, name: small.select(F.col("id").alias(of), F.col("sketch").alias(name))
        both = pairs.distinct().join(sketch("a", "sa").hint("merge"), "a").join(sketch("b", "sb").hint("merge"), "b")
        both = cut(both.filter(likely(*map(F.col, ("na", "nb", "sa", "sb")))).select("a", "b", "na", "nb"), "stars")
        out = cut(verified(both), "links")
        delete(both)
        return out

    def unsettled(df: DataFrame) -> DataFrame:
        """The members ``(bucket, id, n, score, g)`` of buckets that hold two components, and so many parts."""
        known = group_of(df)
        counts = known.groupBy("bucket").agg(F.min("g").alias("g1"), F.max("g").alias("g2"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
        return known.join(counts.filter("g1 <> g2").select("bucket", "parts").hint("merge"), "bucket")

    now = cut(members.join(small.select("id", "n").hint("merge"), "id").join(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).hint("merge"), "bucket"), "round")
    delete(members)
    groups = now.sparkSession.createDataFrame([], "node long, component long")
    # the more a set meets others, the nearer it is to the middle of its copies
    scored = now.join(now.groupBy("id").agg(F.sum("c").alias("score")).hint("merge"), "id")
    leader = F.min(F.struct((-F.col("score")).alias("k"), F.col("n").alias("nh"), F.col("id").alias("h")))
    lead = scored.groupBy("bucket").agg(leader.alias("l"), F.first("c").alias("c"))
    # large buckets of the same copies take one leader, which need not be in each of them
    best = now.select("bucket", "id").join(lead.filter(F.col("c") > FEW).hint("merge"), "bucket").groupBy("id").agg(F.min("l").alias("best"))
    lead = lead.withColumn("of", F.when(F.col("c") > FEW, F.col("l.h"))).join(best.withColumnRenamed("id", "of").hint("merge"), "of", "left").withColumn("l", F.coalesce("best", "l"))
    led = cut(scored.join(lead.select("bucket", "l.h", "l.nh").hint("merge"), "bucket").filter("id <> h").select("bucket", "id", "n", "score", "h", "nh"), "led")
    delete(now)
    # all that is linked with its leader is one component
    links = met_leaders(led.select(F.col("id").alias("a"), F.col("h").alias("b"), F.col("n").alias("na"), F.col("nh").alias("nb")))
    found, groups = [links], _joined(groups, links)
    # a bucket whose members are all connected, or that has none but its leader and one more, is settled
    open_ = cut(unsettled(led.select("bucket", "id", "n", "score")), "open")
    delete(led)
    # a few leaders more connect the most of what is left of a large group
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("score"), "n", "id"))
    more = open_.withColumn("place", place).filter(F.col("place") <= LEADERS).select("bucket", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("g").alias("gb"))
    links = met_leaders(open_.join(more.hint("merge"), "bucket").filter("g <> gb").select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b"), F.when(F.col("id") > F.col("b"), F.col("n")).otherwise(F.col("nb")).alias("na"), F.when(F.col("id") > F.col("b"), F.col("nb")).otherwise(F.col("n")).alias("nb")))
    found, groups = [*found, links], _joined(groups, links)
    rest = cut(unsettled(open_.select("bucket", "id", "n", "score")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")), "open")
    delete(open_)
    # each row has its set's sketch and open buckets: a pair is handed on in the first that both are in
    own = rest.groupBy("id").agg(F.collect_list("bucket").alias("own"))
    dealt = rest.join(small.select("id", "sketch").hint("merge"), "id").join(own.hint("merge"), "id")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = cut(dealt.select("bucket", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "id", "n", "g", "sketch", "own", "part"), "dealt")
    x, y = dealt.alias("x"), dealt.alias("y")
    met = F.expr("x.bucket = y.bucket and x.lo = y.lo and x.hi = y.hi and x.id > y.id and x.g <> y.g")
    met &= (F.least("x.part", "y.part") == F.col("x.lo")) & (F.greatest("x.part", "y.part") == F.col("x.hi"))
    met &= likely(*map(F.col, ("x.n", "y.n", "x.sketch", "y.sketch")))
    met &= F.array_min(F.array_intersect("x.own", "y.own")) == F.col("x.bucket")
    pairs = x.hint("merge").join(y, met).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"), bits_apart(F.col("x.sketch"), F.col("y.sketch")).alias("apart"))
    pairs = cut(pairs, "pairs")
    delete(rest, dealt)
    for most in (FEW, FEW * WIDER, None):
        apart = group_of(group_of(pairs, "a", "ga"), "b", "gb").filter("ga <> gb")
        if most:
            place = F.row_number().over(Window.partitionBy(F.least("ga", "gb"), F.greatest("ga", "gb")).orderBy("apart", "a", "b"))
            apart = apart.withColumn("place", place).filter(F.col("place") <= most)
        tried = cut(apart.select("a", "b", "na", "nb"), "tried")
        if tried.isEmpty():
            delete(tried)
            break
        links = cut(verified(tried), "links")
        found.append(links)
        groups = _joined(groups, links)
        if most:
            left = cut(pairs.join(tried.select("a", "b").hint("merge"), ["a", "b"], "left_anti"), "pairs")
            delete(pairs)
            pairs = left
        delete(tried)
    delete(pairs, sets, small)
    return functools.reduce(DataFrame.unionByName, found), groups


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The components with the links ``(a, b)`` added."""
    if links.isEmpty():
        return groups
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    after = components(edges.unionByName(groups.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    delete(groups)
    return after
