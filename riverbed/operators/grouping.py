"""Which event a report belongs to: document names, shared facts, ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverbed.functions.calendar import local_day

#: What a document's name ends with, and how long it is at least (fixed values).
DOCUMENT_ENDS = ("法", "法典", "条例", "规定", "办法", "细则", "决定", "决议", "通知", "意见", "方案", "规划", "目录", "名录", "清单", "标准", "公告", "指南", "纲要", "准则", "规则", "计划", "措施", "法案", "协定", "协议", "基准", "要点", "批复", "章程", "制度", "令")
DOCUMENT_CHARS = 5
#: What a document's name may begin with and is left out, and the marks that count for nothing (fixed values).
COUNTRY_NAMES = ("中华人民共和国", "中国")
NAME_MARKS = "·・-—_\"'“”‘’、,，。.:：;；!！?？<>〈〉"
#: Full-width forms and their common ones: one distance for all, and the wide space.
_WIDE, _NARROW = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000", "".join(chr(c) for c in range(0x21, 0x7F)) + " "
#: Reports this alike, of one day and without a conflict of countries, are one (a fixed value).
CERTAIN_COSINE = 0.92


def document_key(name: Column) -> Column:
    """What the copies of a document's name share, or null for what is no document's name.

    Full-width forms count as common ones; white space, notes in brackets at the end, the
    country's name at the begin and marks count for nothing.
    """
    folded = F.regexp_replace(F.translate(name, _WIDE, _NARROW), r"\s+", "")
    bare = F.regexp_replace(F.regexp_replace(folded, r"(\([^()]*\))+$", ""), f"^({'|'.join(COUNTRY_NAMES)})", "")
    key = F.translate(bare, NAME_MARKS, "")
    return F.when((F.length(key) >= DOCUMENT_CHARS) & key.rlike(f"({'|'.join(DOCUMENT_ENDS)})$"), key)


def document_keys(title: Column) -> Column:
    """The keys of the documents that a title names in book-title marks, each once."""
    names = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("《([^《》]{1,120})》"), F.lit(1))
    return F.array_distinct(F.array_compact(F.transform(names, document_key)))


def conflict(a: Column, b: Column) -> Column:
    """Two known countries that differ."""
    return F.coalesce(a != b, F.lit(False))


def certain_duplicate(cosine: Column, at: tuple[Column, Column], country: tuple[Column, Column], same_title: Column, same_documents: Column) -> Column:
    """Whether two reports are one beyond doubt: very alike, one business day, no conflict, and one title or document."""
    day = F.coalesce(local_day(at[0]) == local_day(at[1]), F.lit(False))
    return F.coalesce(cosine >= CERTAIN_COSINE, F.lit(False)) & day & ~conflict(*country) & (F.coalesce(same_title, F.lit(False)) | F.coalesce(same_documents, F.lit(False)))


def shares_fact(names: tuple[Column, Column], amounts: tuple[Column, Column]) -> Column:
    """Two reports that name one party and one amount."""
    return F.coalesce(F.arrays_overlap(*names), F.lit(False)) & F.coalesce(F.arrays_overlap(*amounts), F.lit(False))


def decide(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """``query, verdict, rule, fact`` of each report by the first rule that matches.

    ``queries``: query, gate (why it is not judged, or null), specific (its hash counts),
    has_vector, scope_known; ``candidates``: query, id, fact, score, at, same_url,
    same_hash, apart_bits (null if no near copy), certain, date_apart.  Rules: the gate; one
    address, then one content hash (the earliest such candidate); the nearest copy; a
    certain duplicate (the first by recall, score and then id); all candidates dated
    apart; no vector; no candidate (a new event, if its scope is known); else undecided.
    Each query's candidates shrink to one row of minima before anything is joined.
    """
    early = F.struct("at", "id", "fact")
    recall = (-F.col("score")).alias("s")
    met = candidates.groupBy("query").agg(
        F.min(F.when(F.col("same_url"), early)).alias("url"),
        F.min(F.when(F.col("same_hash"), early)).alias("hash"),
        F.min(F.when(F.col("apart_bits").isNotNull(), F.struct("apart_bits", recall, "id", "fact"))).alias("copy"),
        F.min(F.when(F.col("certain"), F.struct(recall, "id", "fact"))).alias("sure"),
        F.bool_and("date_apart").alias("apart"),
    )
    rules = (
        (F.col("gate").isNotNull(), "not_judged", F.col("gate"), None),
        (F.col("url").isNotNull(), "same_fact", F.lit("same_url"), F.col("url.fact")),
        (F.col("specific") & F.col("hash").isNotNull(), "same_fact", F.lit("content_hash"), F.col("hash.fact")),
        (F.col("copy").isNotNull(), "same_fact", F.lit("fingerprint"), F.col("copy.fact")),
        (F.col("sure").isNotNull(), "same_fact", F.lit("certain_duplicate"), F.col("sure.fact")),
        (F.col("apart"), "undecided", F.lit("date_apart"), None),
        (~F.col("has_vector"), "undecided", F.lit("vector_missing"), None),
        (F.col("apart").isNull() & ~F.col("scope_known"), "undecided", F.lit("no_candidate"), None),
        (F.col("apart").isNull(), "new_event", F.lit("no_candidate"), None),
    )
    row = F.struct(F.lit("undecided").alias("verdict"), F.lit("similar_unsure").alias("rule"), F.lit(None).cast(candidates.schema["fact"].dataType).alias("fact"))
    for when, verdict, rule, fact in reversed(rules):
        target = F.lit(None) if fact is None else fact
        row = F.when(when, F.struct(F.lit(verdict).alias("verdict"), rule.alias("rule"), target.cast(candidates.schema["fact"].dataType).alias("fact"))).otherwise(row)
    return queries.join(met, "query", "left").withColumn("r", row).select("query", "r.*")
