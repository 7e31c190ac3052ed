"""Entity linking by a dictionary of names, longest match first, with blockers."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverbed.operators import joins

#: Legal forms that names are looked up without (fixed values).
LEGAL_FORMS = ("inc", "ltd", "limited", "corp", "corporation", "plc", "sa", "ag", "gmbh", "llc", "co", "company", "group", "holdings", "股份有限公司", "有限责任公司", "有限公司", "集团")


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def lookup_key(name: str) -> str:
    """Accents, hyphens, case and legal forms do not tell names apart."""
    words = re.sub(r"[-‐-―'’.,&]+", " ", _plain(name)).split()
    while len(words) > 1 and words[-1] in LEGAL_FORMS:
        words.pop()
    return " ".join(words)


@F.pandas_udf(T.StringType())
def lookup_key_udf(names: pd.Series) -> pd.Series:
    return names.map(lookup_key, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def plain_words(texts: pd.Series) -> pd.Series:
    """A text's words, without accents and case."""
    return texts.map(lambda t: re.findall(r"\w+", _plain(t or "")))


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def leftmost(places: pd.Series, sizes: pd.Series) -> pd.Series:
    """Which of a text's matches (by place) stay when each takes its words from those that begin inside it."""

    def stay(at, n) -> list[bool]:
        out, free = [], 0
        for place, size in zip(at, n, strict=True):
            out.append(place >= free)
            free = place + size if out[-1] else free
        return out

    return pd.Series([stay(p, s) for p, s in zip(places, sizes, strict=True)])


def link(docs: DataFrame, dictionary: DataFrame, head_words: int = 12) -> DataFrame:
    """``doc_id, entity, mentions, role`` of the dictionary's entities in each text.

    ``docs``: doc_id, text; ``dictionary``: name, entity (null for a name that only blocks
    the shorter names inside it).  At each word the longest name counts and the words in it
    begin no other.  An entity in the first words is the subject, others are mentions.
    Names with one key are all linked; an entity's name is no blocker.  Names are read by
    their words: runs of words of the names' lengths meet the keys in a join, of any size
    on either side; runs that a bit map of the keys tells to be none are not shuffled, and only
    matches go on.  Null texts and names hold nothing.
    """
    keyed = dictionary.select(lookup_key_udf("name").alias("key"), "entity").filter("key <> ''")
    names = keyed.groupBy("key").agg(F.array_sort(F.collect_set("entity")).alias("entities")).withColumn("n", F.size(F.split("key", " ")))
    sizes = names.agg(F.array_sort(F.collect_set("n")).alias("lengths"))  # one row
    words = docs.filter("doc_id is not null").select("doc_id", plain_words("text").alias("words")).crossJoin(F.broadcast(sizes))
    spans = F.flatten(F.transform("lengths", lambda n: F.transform(F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("place"), n.alias("n"), F.array_join(F.slice("words", i + 1, n), " ").alias("key")))))
    grams = words.select("doc_id", F.explode(spans).alias("s")).select("doc_id", "s.*")
    met = joins.maybe_among(grams, names, "key").join(names.select("key", "entities"), "key")
    longest = met.groupBy("doc_id", "place").agg(F.max(F.struct("n", "entities")).alias("m"))
    found = longest.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "m.n", "m.entities"))).alias("all"))
    kept = found.withColumn("stay", leftmost(F.col("all.place"), F.col("all.n")))
    hits = kept.select("doc_id", F.explode(F.filter(F.arrays_zip("all", "stay"), lambda x: x["stay"])).alias("h")).select("doc_id", "h.all.place", F.explode("h.all.entities").alias("entity"))
    role = F.when(F.min("place") < head_words, "subject").otherwise("mention")
    return hits.groupBy("doc_id", "entity").agg(F.count(F.lit(1)).alias("mentions"), role.alias("role"))


def grounded_tags(tagged: DataFrame, evidence: DataFrame) -> DataFrame:
    """Keep of each document's tags those that its evidence names. ``tagged``: doc_id, tags; ``evidence``: doc_id, entity."""
    named = evidence.groupBy("doc_id").agg(F.collect_set("entity").alias("_named"))
    kept = F.array_intersect("tags", F.coalesce("_named", F.array().cast("array<string>")))
    return tagged.join(named, "doc_id", "left").withColumn("tags", kept).drop("_named")
