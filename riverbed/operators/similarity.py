"""Near pairs: banded fingerprints, blocked bigrams, nearest vectors for a query set."""

from __future__ import annotations

import functools
import itertools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverbed.functions.text import NEAR_BITS, bigrams, normal_text_udf
from riverbed.sources.shared import shared_dir

#: So much of a normalised title is compared (a fixed value).
TITLE_MOST = 300
#: Titles of a part of a block, of which two are compared at once, and places for their character pairs.
TITLES, PLACES = 4096, 1024
#: Queries that meet a batch of vectors at once: a task holds so many scores for each of its vectors.
ASKED = 128


def near_fingerprints(prints: DataFrame, bits: int = NEAR_BITS, expected: int = 1 << 20) -> DataFrame:
    """Pairs of distinct 64-bit fingerprints at most ``bits`` apart.

    ``prints``: id, fp.  Equal fingerprints are one node named by its least id (``copies``
    counts them), so a large group of copies makes no pairs.  Of ``n`` bands, two such
    fingerprints agree on ``n - bits`` at least; every choice of so many bands is a join key.
    ``n`` is the least for which a key has more values than fingerprints are ``expected``, so
    the pairs that share a key by chance grow no faster than the table.  A pair is handed on
    under the first bands on which it agrees, and so once.
    """
    nodes = prints.filter("fp is not null").groupBy("fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    n = next(n for n in range(bits + 1, 65) if 64 // n * (n - bits) >= math.log2(max(expected, 2)) or n == bits + 6)
    edges = [k * 64 // n for k in range(n + 1)]

    signed = lambda mask: mask - (1 << 64) if mask >> 63 else mask
    bands = [((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in range(n)]
    masks = [signed(sum(chosen)) for chosen in itertools.combinations(bands, n - bits)]
    spread = nodes.select("id", "fp", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    # one number, by which rows are sorted at once; what two keys share by chance is turned away below
    keyed = spread.select("id", "fp", "mask", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    x, y = keyed.alias("x"), keyed.alias("y")
    differ = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    apart = F.bit_count(differ)
    agreed = F.slice(F.filter(F.array(*(F.when(differ.bitwiseAND(F.lit(signed(m))) == 0, signed(m)) for m in bands)), lambda b: b.isNotNull()), 1, n - bits)
    first = F.col("x.mask") == F.aggregate(agreed, F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))
    pairs = x.join(y, F.expr("x.key = y.key and x.mask = y.mask and x.id < y.id") & (apart <= bits) & first)
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), apart.alias("apart"))


def title_pairs(titles: DataFrame, block: list[str], least: float) -> DataFrame:
    """Pairs of one block whose titles' character pairs have a Jaccard similarity of at least ``least``.

    ``titles``: id, title and the block's columns.  The first 300 letters and digits of a
    title count, folded; titles that agree in them are one node.  A large block falls into
    classes of like sizes, of which only neighbours can hold such pairs, and a class into
    parts of about TITLES titles.  Any two parts that may hold pairs meet in one group, where a
    matrix product counts what their titles share, so a task holds two parts and nothing is
    handed on but pairs that are similar enough.  All titles of a block are compared, which
    is the square of their number; what is shuffled is that divided by TITLES.  Titles
    without two letters are in no pair.
    """
    spark = titles.sparkSession
    plain = F.substring(normal_text_udf("title"), 1, TITLE_MOST)
    nodes = titles.select("id", *block, plain.alias("title")).groupBy(*block, "title").agg(F.min("id").alias("id")).filter(F.length("title") > 1)
    # a size less than `least` of another is two classes away from it or more
    width = max(-math.log(least), 0.01) * (1 + 1e-6)
    nodes = nodes.withColumn("class", F.floor(F.log(F.size(bigrams(F.col("title")))) / width).cast("int"))
    path = f"{shared_dir(spark)}/riverbed-titles-{uuid.uuid4().hex}"  # read twice below
    nodes.write.parquet(path)
    nodes = spark.read.schema(nodes.schema).parquet(path)
    parts = F.ceil(F.col("c") / TITLES).cast("int")
    counts = nodes.groupBy(*block, "class").agg(F.count(F.lit(1)).alias("c"))
    sizes = counts.groupBy(*block).agg(F.sum("c").alias("total"), F.map_from_entries(F.collect_list(F.struct("class", parts.alias("parts")))).alias("parts"))
    dealt = nodes.alias("n").join(sizes.alias("s"), F.expr(" and ".join(f"n.{b} <=> s.{b}" for b in block) or "true")).select("n.*", "s.total", "s.parts")  # a null is a block of its own
    k = F.col("class")
    of = lambda at: F.coalesce(F.try_element_at("parts", at), F.lit(0))
    part = F.pmod(F.xxhash64("id"), of(k)).cast("int")
    met = lambda n, body: F.transform(F.filter(F.sequence(F.lit(0), n), lambda j: j < n), body)
    cell = lambda k1, p1, k2, p2, second: F.struct(k1.alias("k1"), p1.alias("p1"), k2.alias("k2"), p2.alias("p2"), second.alias("second"))
    own = met(of(k), lambda j: cell(k, F.least(part, j), k, F.greatest(part, j), part > j))
    larger = met(of(k + 1), lambda j: cell(k, part, k + 1, j, F.lit(False)))
    smaller = met(of(k - 1), lambda j: cell(k - 1, j, k, part, F.lit(True)))
    whole = F.lit(-1)
    cells = F.when(F.col("total") <= TITLES, F.array(cell(whole, whole, whole, whole, F.lit(False)))).otherwise(F.concat(own, larger, smaller))
    keys = [*block, "k1", "p1", "k2", "p2"]
    spread = dealt.select(*block, "id", "title", F.explode(cells).alias("cell")).select(*block, "cell.*", "id", "title")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        one = group["p1"].iloc[0] == group["p2"].iloc[0] and group["k1"].iloc[0] == group["k2"].iloc[0]
        return _alike(group["id"].to_numpy(), group["title"].tolist(), None if one else group["second"].to_numpy(), least)

    pairs = spread.groupBy(*keys).applyInPandas(compare, "a long, b long, inter long, both long")
    return pairs.select("a", "b", F.round(F.col("inter") / F.col("both"), 6).alias("score")).filter(F.col("score") >= least)


def _alike(ids: np.ndarray, titles: list[str], second: np.ndarray | None, least: float) -> pd.DataFrame:
    """``a, b, inter, both`` of the titles whose sets of character pairs are similar; of the two sides, where ``second`` tells them."""
    found = [np.zeros((4, 0), np.int64)]
    points = [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64) for t in titles]
    of = np.repeat(np.arange(len(titles)), [len(p) - 1 for p in points])
    names, rank = np.unique(np.concatenate([(p[:-1] << np.uint64(32)) | p[1:] for p in points]), return_inverse=True)
    of, rank = np.divmod(np.unique(of * len(names) + rank), len(names))
    n = np.bincount(of, minlength=len(titles))
    ends = np.cumsum(n)
    # sets of few different pairs are told exactly, others share a place with some others
    wide = min(len(names), PLACES)
    held = np.zeros((len(titles), wide + 2), np.float32)
    held[of, rank % wide] = 1
    # common places less this of both sides are negative, if the sets cannot be similar enough
    ask = (held[:, :wide].sum(axis=1) - n) / 2 + least / (1 + least) * n
    held[:, wide], held[:, wide + 1] = -ask, 1
    left, right = (np.arange(len(titles)),) * 2 if second is None else (np.flatnonzero(~second), np.flatnonzero(second))
    left, right = (side[np.argsort(n[side], kind="stable")] for side in (left, right))
    across = held[right]
    across[:, [wide, wide + 1]] = across[:, [wide + 1, wide]]
    for at in range(0, len(left), 256):
        x = left[at : at + 256]
        low = np.searchsorted(n[right], math.ceil(least * n[x[0]] - 1e-9))
        high = np.searchsorted(n[right], math.floor(n[x[-1]] / least + 1e-9), side="right")
        if second is None:
            low = max(low, at)
        i, j = np.nonzero(held[x] @ across[low:high].T >= -0.01)
        if second is None:
            i, j = i[low + j > at + i], j[low + j > at + i]
        p, q = x[i], right[low + j]
        if wide == len(names):
            inter = np.rint(np.einsum("ij,ij->i", held[p, :wide], held[q, :wide])).astype(np.int64) if len(p) < 4096 else np.concatenate([np.rint(np.einsum("ij,ij->i", held[p[s : s + 4096], :wide], held[q[s : s + 4096], :wide])).astype(np.int64) for s in range(0, len(p), 4096)])
        else:
            own = lambda t: rank[ends[t] - n[t] : ends[t]]
            inter = np.array([len(np.intersect1d(own(s), own(t), assume_unique=True)) for s, t in zip(p, q, strict=True)], np.int64)
        both = n[p] + n[q] - inter
        sure = inter >= least * both - 1e-6 * both
        p, q, inter, both = p[sure], q[sure], inter[sure], both[sure]
        found.append(np.stack([np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q]), inter, both]))
    return pd.DataFrame(np.concatenate(found, axis=1).T, columns=["a", "b", "inter", "both"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int, least: float) -> DataFrame:
    """For each query vector its ``k`` nearest other vectors by cosine, at least ``least``.

    The query set is taken in blocks of bounded size, each against all vectors by one
    matrix product a batch; a batch sends on no more than ``k`` rows for each query.
    Scores are rounded to six digits, ties go to the least id; null vectors, and those of
    another length than the queries', are passed over.
    """
    schema = "query long, id long, score double"
    found: DataFrame | None = None
    total = queries.count()
    size = 4096
    blocks = max(1, -(-total // size))
    numbered = queries.filter("vector is not null").select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    for block in range(blocks):
        rows = numbered.filter(F.col("block") == block).select("id", "vector").collect()  # about `size` vectors
        if not rows:
            continue
        ids = np.array([r.id for r in rows])
        q = np.array([r.vector for r in rows], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def search(batches: Iterator[pd.DataFrame], ids=ids, q=q) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                b = b[[x is not None and len(x) == q.shape[1] for x in b["vector"]]].sort_values("id")
                if not len(b):
                    continue
                v, names = np.array(b["vector"].tolist(), np.float64), b["id"].to_numpy()
                norm = np.linalg.norm(v, axis=1)
                for k0 in range(0, len(ids), ASKED):
                    own = ids[k0 : k0 + ASKED]
                    score = np.where(norm > 0, q[k0 : k0 + ASKED] @ v.T / np.maximum(norm, 1e-300), 0.0)
                    score = np.round(score, 6)
                    score[own[:, None] == names[None, :]] = -2
                    top = np.argsort(-score, axis=1, kind="stable")[:, :k]  # ids are in order, so ties are too
                    at = np.repeat(np.arange(len(own)), top.shape[1])
                    out = pd.DataFrame({"query": own[at], "id": names[top.ravel()], "score": score[at, top.ravel()]})
                    yield out[out["score"] >= least]

        part = vectors.select("id", "vector").mapInPandas(search, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    scored = found.withColumn("score", F.round("score", 6))
    n = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id")))
    return scored.withColumn("rank", n).filter(F.col("rank") <= k)
