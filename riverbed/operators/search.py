"""Search: terms, points for where they hit, guarded aliases, facets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TERMS = 6
DIRECT, BODY, TITLE, SEAT = 3, 1, 6, 1000


def terms_of(query: str) -> list[str]:
    """Lower-case terms, split at spaces and between Han and Latin; six at most."""
    spaced = re.sub(r"(?<=[一-鿿])(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])(?=[一-鿿])", " ", query.lower())
    return list(dict.fromkeys(spaced.split()))[:MAX_TERMS]


def escaped(term: str) -> str:
    """A term for LIKE with its metacharacters taken literally."""
    return re.sub(r"([\\%_])", r"\\\1", term)


def guarded(text: Column, word: str, blockers: list[str] = ()) -> Column:
    """Whether a text has the word at Latin word bounds, outside longer names that hold it."""
    clean = text
    for b in sorted(blockers, key=len, reverse=True):
        clean = F.regexp_replace(clean, f"(?i){re.escape(b)}", " ")
    return clean.rlike(rf"(?i)(?<![a-z]){re.escape(word)}(?![a-z])")


def relevance(docs: DataFrame, terms: list[str], title: str = "title", body: str = "body") -> DataFrame:
    """Points of each document that has every term somewhere; title hits first, body hits last."""
    low = {c: F.lower(F.col(c)) for c in (title, body)}
    hit = lambda c, t: low[c].contains(t)
    points = F.lit(0)
    every = F.lit(True)
    for t in terms:
        points = points + F.when(hit(title, t), TITLE + DIRECT).otherwise(0) + F.when(hit(body, t), BODY).otherwise(0)
        every = every & (hit(title, t) | hit(body, t))
    return docs.filter(every).withColumn("points", points)


def facets(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
