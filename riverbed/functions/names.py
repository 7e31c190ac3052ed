"""Parties that a text names, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about which party is meant (fixed values).
NAME_STOPWORDS = (
    "mining", "mines", "minerals", "metals", "resources", "copper", "gold", "silver", "lithium", "nickel", "cobalt", "group", "limited", "company",
    "corporation", "holdings", "project", "projects", "energy", "global", "international", "national", "million", "billion", "update", "news", "report",
    "quarter", "first", "second", "third", "fourth",
)
#: Letters of a name of one word, and of a word of a longer name that counts by itself (fixed values).
ONE_WORD, LONG_WORD = 5, 6
#: Capitalised words in a row; their borders are those of unaccented letters and digits.
_RUN = r"(?<!\w)[A-Z][A-Za-z]+(?:[ -][A-Z][A-Za-z]+)*(?!\w)"


def key_names(text: Column, lexicon: dict[str, list[str]] | None = None) -> Column:
    """The parties that a text names, each once, in order: ``co:<id>`` and ``nm:<words>``.

    ``lexicon``: known companies with the patterns that name them; a guard against another
    reading belongs in the pattern (``(?<!new )mexico``).  Capitalised words in a row are a
    name, without the words that any party may have: two words, or one of five letters that
    is no abbreviation.  Long words of a name are names too, so that a longer and a shorter
    form of it meet.  A null text names nobody.
    """
    plain = F.coalesce(text, F.lit(""))
    runs = F.regexp_extract_all(plain, F.lit(_RUN), F.lit(0))
    stop = F.array(*map(F.lit, NAME_STOPWORDS))
    words = F.transform(runs, lambda r: F.filter(F.split(r, "[ -]"), lambda w: ~F.array_contains(stop, F.lower(w))))
    mixed = lambda w, least: (F.length(w) >= least) & ~w.rlike("^[A-Z]+$")
    whole = F.filter(words, lambda ws: (F.size(ws) >= 2) | ((F.size(ws) == 1) & mixed(F.get(ws, F.lit(0)), ONE_WORD)))
    phrases = F.transform(whole, lambda ws: F.lower(F.array_join(ws, " ")))
    singles = F.transform(F.filter(F.flatten(words), lambda w: mixed(w, LONG_WORD)), F.lower)
    named = F.transform(F.array_union(phrases, singles), lambda n: F.concat(F.lit("nm:"), n))
    known = [F.when(plain.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(f"co:{name}")) for name, patterns in (lexicon or {}).items()]
    return F.array_sort(F.array_union(F.array_compact(F.array(*known)), named) if known else named)
