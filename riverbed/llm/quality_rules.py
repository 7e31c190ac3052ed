"""Quality rules: text statistics, then a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed to a fixed number of buckets.  Two smoothed multinomials
over the buckets, of the trusted target and of the raw corpus, are counted over whole
tables; a document's score is the mean log ratio of its n-grams.  The weights are whole
numbers (ten-thousandths), so that a score is an exact sum and the threshold decides the
same way on every run.  DataFrame functions only.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverbed.llm.common import let, text_of, words_of

#: Buckets of the hashed n-grams; the weight table that each task gets has so many entries.
BUCKETS = 1 << 14
#: A weight is the log ratio times this, rounded.
SCALE = 10_000
#: A document is kept if its mean weight is at least this.  An n-gram that the corpus has
#: once and the target never weighs about -ln 2, so a clean document of new words stays.
THRESHOLD = -7_000
SYMBOLS = "[#*$%&|<>]"


def _bucket(gram: Column) -> Column:
    return F.crc32(gram.cast("binary")).bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")


def _buckets(words: Column) -> Column:
    """The buckets of a document's words and adjacent word pairs."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: _bucket(F.concat(a, F.lit(" "), b)))
    return F.concat(F.transform(words, _bucket), pairs)


def repeat_words(words: Column, size: int = 5) -> Column:
    """Words inside windows of ``size`` words that the text holds at least twice.

    Windows are told apart by a 64-bit hash; only texts with a repeat sort their windows.
    """

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            found = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(found, lambda x: x["i"]))

        spans = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size)))), F.lit(0), lambda s, x: s + x)
        return let(let(ordered, twice), spans)

    starts = lambda w: F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
    hashes = let(words, lambda w: F.transform(starts(w), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size)))))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def ngram_weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """The weight of every bucket, from counts over all of ``docs``.

    ``trusted`` holds the ids of the target documents.  Only the BUCKETS counts, a number
    that does not depend on the data, come to the driver.  An empty target or corpus gives
    a ratio of one everywhere.
    """
    target = trusted.select(F.col(id_col).alias("id")).distinct().withColumn("hit", F.lit(1))
    # a merge join at every size: the trusted ids grow with the corpus
    texts = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text")).join(target.hint("merge"), "id", "left")
    grams = texts.select(F.coalesce("hit", F.lit(0)).alias("hit"), F.explode(let(words_of(F.col("text")), _buckets)).alias("bucket"))
    rows = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("hit").alias("target")).collect()
    raws, targets = sum(r.raw for r in rows), sum(r.target for r in rows)
    weights = [0] * BUCKETS
    for r in rows if targets else ():
        weights[r.bucket] = round((math.log((r.target + 1) / (targets + BUCKETS)) - math.log((r.raw + 1) / (raws + BUCKETS))) * SCALE)
    return weights


def _judged(docs: DataFrame, trusted: DataFrame, threshold: int, id_col: str, text_col: str) -> DataFrame:
    """Each row of ``docs`` whole, as ``row``, with its statistics and verdict."""
    weights = F.from_json(F.lit(json.dumps(ngram_weights(docs, trusted, id_col, text_col))), "array<int>")
    text = text_of(docs, text_col)
    with_words = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"), words_of(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    total = F.aggregate(_buckets(F.col("words")), F.lit(0).cast("long"), lambda s, b: s + F.get(weights, b))
    stats = with_words.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        total.alias("total"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    grams = F.greatest(2 * F.col("n_words") - 1, F.lit(0))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("total") >= threshold * grams))


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and verdict of every document.

    Returns ``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept`` for each input row.  A null text has no words and fails; repeated
    rows are judged each; a null id is never in the target; further columns are ignored;
    an empty table gives no rows.  A document without n-grams scores 0.
    """
    return _judged(docs, trusted, threshold, id_col, text_col).select(F.col(f"row.{id_col}").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, trusted: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns."""
    return _judged(docs, trusted, threshold, id_col, text_col).filter("kept").select("row.*")
