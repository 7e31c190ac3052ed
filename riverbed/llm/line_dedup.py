"""Fuzzy line deduplication by MinHash, with DataFrame functions only.

A line's set holds its character shingles: the windows of eight characters that begin at
every character.  Signatures are made of the windows that begin behind certain characters
(about three in ten of a Latin text, all of most other scripts; lines in which these are
rare use every window as well), verification reads the whole sets.  The hashes of one
permutation lie on a circle; the samples of a band are those that follow its fixed point.
Lines that share a band are confirmed by the exact Jaccard similarity of their sets and
linked into components; one line of each component stays.  Equal lines are one line from
the beginning, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverbed.llm.common import cut, delete, let, text_of
from riverbed.llm.near import near_links, shared_buckets

SHINGLE = 8
BANDS, ROWS = 12, 3
#: Links need a Jaccard similarity of so many hundredths.
PERCENT = 80
#: A line with fewer than one signature window in so many uses all of its windows as well.
SPARSE = 8

#: Windows of a signature begin at the line's begin, behind what is neither letter nor
#: digit, behind one of e E A 0 5, and behind all characters of scripts other than Latin.
_BEHIND = r"[\x00-/:-@\[-`{-\x7FeEA05[\x{80}-\x{24F}&&[^\p{L}\p{N}]]\x{250}-\x{10FFFF}]"
_STARTS = rf"(?s){_BEHIND}(?=(.{{{SHINGLE}}}))"


def _hashes(found: Column) -> Column:
    """Distinct 63-bit hashes of strings."""
    return F.array_distinct(F.transform(found, lambda s: F.shiftrightunsigned(F.xxhash64(s), 1)))


def windows(line: Column) -> Column:
    """All windows of a line: eight rows of them, each begun one character later."""
    rows = [F.regexp_extract_all(F.substr(line, F.lit(k + 1)), F.lit(rf"(?s).{{{SHINGLE}}}"), F.lit(0)) for k in range(SHINGLE)]
    return F.flatten(F.array(*rows))


def shingles(line: Column) -> Column:
    """The 32-bit hashes of a line's shingles, each once.

    Two lines of a thousand shingles share one by accident in 4,000 cases, which moves their
    similarity by a thousandth; half of the bytes of the sets that verification moves.
    """
    return F.array_distinct(F.transform(windows(line), lambda s: F.hash(s)))


def with_band_keys(df: DataFrame, hashes: str, name: str) -> DataFrame:
    """``df`` with the column ``name``: a key for each band of the distinct hashes in a column.

    The hashes lie on a circle; a band is the ROWS hashes that follow its fixed point, so
    two sets share it with the probability of so many equal samples, and a set that has
    fewer is its own only band.  Equal keys of one line count once; no hashes, no keys.
    """
    points = [(2 * b + 1) * (1 << 62) // BANDS for b in range(BANDS)]

    def of(own: Column) -> Column:
        n = F.size(own)

        def bands(merged: Column) -> Column:
            # the place of a point among the hashes is how many of them come before it
            key = lambda b: let(F.array_position(merged, F.lit(points[b])).cast("int") - (1 + b), lambda at: F.xxhash64(*(F.get(own, (at + k) % n) for k in range(ROWS))))
            return F.array_distinct(F.array(*map(key, range(BANDS))))

        few = F.when(n > 0, F.array(F.xxhash64(own))).otherwise(F.array().cast("array<bigint>"))
        return F.when(n >= ROWS, let(F.sort_array(F.concat(own, F.array(*map(F.lit, points)))), bands)).otherwise(few)

    # bound variables, so that each sort is evaluated once for a row
    return df.withColumn(name, let(F.sort_array(hashes), of))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, no, line)`` of the lines that take part: those with anything but white space."""
    lines = docs.select(docs[id_col].cast("long").alias("doc"), F.posexplode(F.split(text_of(docs, text_col), "\n")).alias("no", "line"))
    return lines.filter(F.col("doc").isNotNull() & F.col("line").rlike(r"\S"))


def _keys(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")


def line_nodes(lines: DataFrame) -> DataFrame:
    """``(h1, h2, first, copies, bands)``: the distinct lines with their band keys."""
    short = F.length("line") < SHINGLE
    none = F.array().cast("array<string>")
    keyed = lines.select("doc", *_keys(F.col("line")), "line", F.when(short, none).otherwise(F.regexp_extract_all(F.concat(F.lit(" "), "line"), F.lit(_STARTS), F.lit(1))).alias("found"))
    sparse = ~short & (F.size("found") * SPARSE < F.length("line") - (SHINGLE - 1))
    keyed = keyed.select("doc", "h1", "h2", _hashes(F.col("found")).alias("thin"), F.when(sparse, _hashes(windows(F.col("line")))).alias("full"))
    keyed = with_band_keys(with_band_keys(keyed, "thin", "bands"), "full", "more")
    bands = F.when(F.col("full").isNull(), F.col("bands")).otherwise(F.array_union("bands", "more"))
    keyed = keyed.select("doc", "h1", "h2", bands.alias("bands"))
    return keyed.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))


def line_groups(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(h1, h2, component, keeper)`` of every line that has an equal or a near line.

    ``h1, h2`` are the 128 bits that name the line, ``component`` names its group and
    ``keeper`` is the smallest document with a line of the group.
    """
    lines = _lines(docs, id_col, text_col)
    nodes = cut(line_nodes(lines).select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "first", "copies", "bands"), "lines")

    def sets_of(ids: DataFrame) -> DataFrame:
        # each line is looked up in its first document: no key is hot
        wanted = nodes.join(ids.hint("merge"), "id", "left_semi").select("id", "h1", "h2", F.col("first").alias("doc"))
        texts = lines.select("doc", *_keys(F.col("line")), "line").join(wanted.hint("merge"), ["doc", "h1", "h2"]).dropDuplicates(["doc", "h1", "h2", "id"])
        return texts.select("id", shingles(F.col("line")).alias("items"))

    links, groups = near_links(shared_buckets(nodes), nodes, sets_of, percent, None)
    delete(links)
    named = nodes.select("id", "h1", "h2", "first", "copies").join(groups.select(F.col("node").alias("id"), "component"), "id", "left")
    several = named.filter("copies > 1 or component is not null").withColumn("component", F.coalesce("component", "id"))
    keeper = several.groupBy("component").agg(F.min("first").alias("keeper"))
    out = cut(several.join(keeper, "component").select("h1", "h2", "component", "keeper"), "groups")
    delete(nodes, groups)
    return out


def _cleaned(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Each row of ``docs`` whole, as ``row``, with its line counts and the text that stays."""
    groups = line_groups(docs, percent, id_col, text_col)
    hits = _lines(docs, id_col, text_col).select("doc", "no", *_keys(F.col("line"))).join(groups, ["h1", "h2"]).select("doc", "no", "component", "keeper")
    # a document's lines of one group: the keeper keeps the first, others none
    first = hits.groupBy("doc", "component").agg(F.min("no").alias("no"), F.first("keeper").alias("keeper")).filter("doc = keeper").select("doc", "no")
    gone = hits.select("doc", "no").distinct().join(first, ["doc", "no"], "left_anti").groupBy("doc").agg(F.collect_set("no").alias("gone"))
    flat = docs.select(F.struct(*docs.columns).alias("row"), docs[id_col].cast("long").alias("doc"), text_of(docs, text_col).alias("text"))
    out = flat.join(gone, "doc", "left")
    split = F.split("text", "\n")
    stay = lambda s: F.array_except(F.sequence(F.lit(0), F.size(s) - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(split, lambda s: F.array_join(F.transform(stay(s), lambda i: F.get(s, i)), "\n")))
    return out.select("row", F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept_text"))


def dedup_lines(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep one line of each group of equal or near lines, over the whole corpus.

    The line that stays is the first of the group in its smallest document.  Returns
    ``id_col, n_lines, n_removed, kept_text`` for each input row; ``kept_text`` joins the
    lines that stay.  Lines of white space alone stay; a line of fewer than SHINGLE
    characters has no near lines but equal ones.
    A null text is an empty text; rows with a null id are returned whole and take no part;
    rows of one id are one document, and equal repeats get equal rows; further columns
    are ignored; an empty table gives no rows.
    """
    return _cleaned(docs, percent, id_col, text_col).select(F.col(f"row.{id_col}").alias(id_col), "n_lines", "n_removed", "kept_text")


def clean_lines(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the text that ``dedup_lines`` keeps; rows that it leaves without a word go.

    A column ``n_chars`` is set to the new length.
    """
    rows = _cleaned(docs, percent, id_col, text_col).filter((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    changed = F.col("n_removed") > 0
    new = {text_col: F.when(changed, F.col("kept_text")).otherwise(F.col(f"row.{text_col}")), "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*(new[c].alias(c) if new.get(c) is not None else F.col(f"row.{c}").alias(c) for c in docs.columns))
