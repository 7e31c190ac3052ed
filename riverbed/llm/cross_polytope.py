"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform; the hash
of a unit vector is the signed axis nearest to its rotation.  A table's bucket is the
hashes of several rotations, the last over fewer axes, so that the number of buckets grows
with the two-thirds power of the number of vectors.  A query looks into the buckets of the
signed axes next to it as well: those of the least loss, more of them where buckets are
more (multiprobe).  Vectors of all lengths are hashed with one more component, which fills
them up to the largest norm of their band (norms between two powers of two); a query asks
each band, so the nearest direction is the largest inner product.

Equal vectors are one vector with its smallest ids, as many as an answer can name.  Tables
come two at a time, which bounds the disk that their copies of the vectors take.  A bucket
of more than BLOCK vectors falls into blocks, each of which meets the bucket's queries: no
candidate is dropped and no bucket is one task's.  A query carries the least score that can
still be among its best, so later tables answer only with what is better.  Candidates are ranked by their inner
products in double precision, summed in one order for all.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverbed.llm.common import cut, delete, let

TABLES, AT_ONCE = 10, 2
#: Buckets and probes of a table over so many vectors; others by powers of the ratio.
VECTORS, BUCKETS, PROBES = 51_200, 128, 5
BUCKET_POWER, PROBE_POWER = 2 / 3, 0.55
#: Vectors of a bucket that queries meet at a time, and queries that meet them at a time.
BLOCK, QUERIES = 4096, 256
#: Hot buckets that are sent to every task at most (24 bytes each).
HOT = 100_000
#: Vectors that are hashed at a time.
ROWS = 4096


def shape_of(vectors: int, wide: int) -> tuple[list[int], int]:
    """``(axes of each hash, probes)`` for so many vectors of ``wide`` axes."""
    buckets, axes = BUCKETS * (max(vectors, 1) / VECTORS) ** BUCKET_POWER, []
    while buckets > 2 * wide:
        axes.append(wide)
        buckets /= 2 * wide
    if buckets > 1.5:
        axes.append(max(1, round(buckets / 2)))
    total = float(np.prod([2.0 * a for a in axes]))
    return axes, int(min(total, np.ceil(PROBES * (total / BUCKETS) ** PROBE_POWER)))


def rotated(x: np.ndarray, table: int, number: int) -> np.ndarray:
    """Three rounds of signs and a Hadamard transform of vectors whose width is a power of two."""
    rng, wide = np.random.Generator(np.random.PCG64(table * 1000 + number)), x.shape[1]
    for _ in range(3):
        x = x * rng.choice(np.array([-1.0, 1.0], np.float32), wide)
        step = 1
        while step < wide:
            pairs = x.reshape(len(x), -1, 2, step)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), wide)
            step *= 2
        x = x * np.float32(wide**-0.5)
    return x


def _sides(x: np.ndarray, axes: int) -> np.ndarray:
    """The components along all signed axes."""
    return np.concatenate([x[:, :axes], -x[:, :axes]], axis=1)


def bucket_of(x: np.ndarray, table: int, axes: list[int]) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for k, a in enumerate(axes):
        out = out * (2 * a) + _sides(rotated(x, table, k), a).argmax(axis=1)
    return out


def probes_of(x: np.ndarray, table: int, axes: list[int], probes: int) -> np.ndarray:
    """The buckets of the least loss, ``(vector, probe)``; the loss is that of the squared distances from the nearest axes."""
    keys, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1), np.float32)
    for k, a in enumerate(axes):
        along = _sides(rotated(x, table, k), a)
        own = np.square(along.max(axis=1, keepdims=True) - along)
        near = np.argsort(own, axis=1, kind="stable")[:, :probes]
        loss = (loss[:, :, None] + np.take_along_axis(own, near, 1)[:, None, :]).reshape(len(x), -1)
        keys = (keys[:, :, None] * (2 * a) + near[:, None, :]).reshape(len(x), -1)
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        loss, keys = np.take_along_axis(loss, best, 1), np.take_along_axis(keys, best, 1)
    return keys


def filled(x: np.ndarray, top: np.ndarray, more: bool) -> np.ndarray:
    """Vectors divided by ``top``, with zeros up to a power of two of components.

    With ``more``, one further component fills them up to unit length.
    """
    x = x / top[:, None]
    out = np.zeros((len(x), width_of(x.shape[1], more)), np.float32)
    out[:, : x.shape[1]] = x
    if more:
        out[:, x.shape[1]] = np.sqrt(np.maximum(0.0, 1.0 - np.square(x).sum(axis=1)))
    return out


def width_of(wide: int, more: bool) -> int:
    return 1 << (wide + more - 1).bit_length()


def usable(vector: Column) -> Column:
    """Whether a vector is there, is not zero and holds finite numbers only."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~broken & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


class _Buckets:
    """The answers of one bucket's block: its vectors, then the queries that look into it."""

    def __init__(self, most: int):
        self.most = most
        self.vectors: list[np.ndarray] = []
        self.ids: list[pa.ListArray] = []
        self.all: np.ndarray | None = None

    def put(self, v: np.ndarray, ids: pa.ListArray) -> None:
        self.vectors.append(v)
        self.ids.append(ids)

    def ask(self, names: np.ndarray, q: np.ndarray, floors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(query, id, score)`` of the nearest ones that reach the query's floor; ties at the end are all kept."""
        if not self.ids:
            return
        if self.all is None:
            self.all = np.concatenate(self.vectors).astype(np.float64)
            self.size = np.concatenate([pa.compute.list_value_length(i).to_numpy(zero_copy_only=False) for i in self.ids]).astype(np.int64)
            self.flat = np.concatenate([i.flatten().to_numpy(zero_copy_only=False) for i in self.ids])
            self.begin = np.cumsum(self.size) - self.size
            self.slack = np.sqrt(np.square(self.all).sum(axis=1).max()) * 1e-12
        for lo in range(0, len(q), QUERIES):
            part = q[lo : lo + QUERIES].astype(np.float64)
            near = part @ self.all.T
            k = min(self.most, near.shape[1])
            # products of matrices round by place; what may be among the first is summed again
            least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] - self.slack * np.sqrt(np.square(part).sum(axis=1))
            least = np.maximum(least, floors[lo : lo + QUERIES] - self.slack * np.sqrt(np.square(part).sum(axis=1)))
            row, col = np.nonzero(near >= least[:, None])
            if not len(row):
                continue
            score = (part[row] * self.all[col]).sum(axis=1)
            order = np.lexsort((-score, row))
            row, col, score = row[order], col[order], score[order]
            # equal scores at the end stay; the smaller ids among them win later
            place = np.arange(len(row)) - np.searchsorted(row, row)
            last = score[np.minimum(np.searchsorted(row, row) + k, np.searchsorted(row, row, side="right")) - 1]
            keep = (place < k) | (score == last)
            row, col, score = row[keep], col[keep], score[keep]
            sizes = self.size[col]
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - self.begin[col], sizes)
            yield np.repeat(names[lo : lo + QUERIES][row], sizes), self.flat[at], np.repeat(score, sizes)


def _met(sent: DataFrame, most: int) -> DataFrame:
    """``(q, id, score)``: the best of each block for its queries; ``sent`` holds a block's vectors before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, out, n = None, None, [], 0

        def taken() -> pa.RecordBatch:
            q, i, s = (np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(3))
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["q", "id", "score"])

        for b in batches:
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "bucket", "part", "band", "wide", "query")], axis=1)
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for lo, hi in itertools.pairwise([0, *cuts.tolist(), b.num_rows] if b.num_rows else []):
                key = tuple(keys[lo, :5])
                if key != at:
                    at, block = key, _Buckets(most)
                v = _matrix(b.column("v").slice(lo, hi - lo))
                if keys[lo, 5]:
                    ids, floors = (b.column(c).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in ("id", "floor"))
                    for found in block.ask(ids, v, floors):
                        out.append(found)
                        n += len(found[0])
                else:
                    block.put(v, b.column("ids").slice(lo, hi - lo))
            if n > 50_000:
                yield taken()
                out, n = [], 0
        yield taken()

    return sent.mapInArrow(run, "q long, id long, score double")


def _first(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` best ids of each query, each once."""
    # an id that two tables found has equal scores and so one rank
    ranked = found.withColumn("k", F.dense_rank().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "id"))).filter(F.col("k") <= most)
    return ranked.groupBy("q", "id").agg(F.first("score").alias("score"))


def _floors(best: DataFrame, most: int) -> DataFrame:
    """``(q, floor)``: the least score that can still be among a query's ``most`` best."""
    return best.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).filter(F.col("n") >= most).select("q", "floor")


def nearest(vectors: DataFrame, asks: Column, count: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The nearest other rows of the rows for which ``asks`` holds.

    Returns ``query_id, rank, vec_id, score``: the inner product in double precision, the
    largest first, ties to the smaller id, at most ``count`` rows a query.  Rows with a null
    id and vectors that are null, zero or hold a null or non-finite component take no part.
    Only vectors of one length are compared; rows of one id are one row, the smallest
    vector of which counts; further columns are ignored; an empty table gives no rows.
    Recall on 51,282 random directions, the hardest case, is about 0.93
    (``tests/llm/test_cross_polytope.py`` holds 0.9 on the given tables).
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("v"), F.coalesce(asks, F.lit(False)).alias("asks")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    hashed = rows.select("id", "asks", "v", F.struct(F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")).alias("h"))
    names = hashed.groupBy("id").agg(F.min("h").alias("h"), F.max("asks").alias("asks"))
    # equal vectors are one, named by its smallest id, with the ids that an answer can hold;
    # they are picked among the smallest ones of each range of ids, so that none gathers many
    smallest = F.slice(F.sort_array(F.collect_list("id")), 1, count + 1)
    some = names.groupBy("h", F.floor(F.col("id") / 4096).alias("at")).agg(smallest.alias("ids"), F.max("asks").alias("asks"))
    some = some.withColumns({"k": F.row_number().over(Window.partitionBy("h").orderBy("at")), "asks": F.max("asks").over(Window.partitionBy("h"))}).filter(F.col("k") <= count + 1)
    one = some.groupBy("h").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, count + 1).alias("ids"), F.max("asks").alias("asks")).withColumn("id", F.col("ids")[0])
    most = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    norm = let(most, lambda m: m * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") / m * (x.cast("double") / m))))
    nodes = hashed.select("id", "h", "v").join(one, ["id", "h"]).dropDuplicates(["id", "h"])
    nodes = cut(nodes.select("id", "h", "ids", "asks", "v", F.size("v").alias("wide"), norm.alias("norm"), F.least(F.ceil(F.log2(norm) - 1e-6), F.lit(1023)).cast("int").alias("band")), "vectors")
    # a row for each length and band; bands are at most as many as exponents
    groups = nodes.groupBy("wide", "band").agg(F.count(F.lit(1)).alias("n"), F.min("norm").alias("least")).collect()
    # where all are as long as their band's largest, they need no further component
    more = {(g.wide, g.band): g.least < 2.0**g.band * (1 - 1e-5) for g in groups}
    shapes = {(g.wide, g.band): shape_of(g.n, width_of(g.wide, more[g.wide, g.band])) for g in groups}
    bands: dict[int, list[int]] = {}
    for wide, band in sorted(shapes):
        bands.setdefault(wide, []).append(band)
    kind = nodes.schema["v"].dataType.simpleString()
    place = ["t", "bucket", "band", "wide"]

    def placed(tables: range, asking: bool, slim: bool = False) -> DataFrame:
        """The vectors at their buckets, or the queries at those into which they look; slim: the buckets alone."""
        own = [] if slim else ["id", "ids", "v", "floor"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                wides, norms = (b.column(c).to_numpy(zero_copy_only=False) for c in ("wide", "band"))
                for wide in np.unique(wides).tolist():
                    for band in bands[wide]:
                        at = np.flatnonzero((wides == wide) & (asking | (norms == band)))
                        for lo in range(0, len(at), ROWS):
                            yield from sent(b.take(pa.array(at[lo : lo + ROWS])), wide, band)

        def sent(b: pa.RecordBatch, wide: int, band: int) -> Iterator[pa.RecordBatch]:
            v = _matrix(b.column("v")).astype(np.float64)
            axes, probes = shapes[wide, band]
            # a query's own length is of no account
            top = np.abs(v).max(axis=1) if asking else np.full(len(v), 2.0**band)
            if asking:
                top = top * np.sqrt(np.square(v / top[:, None]).sum(axis=1))
            x = filled(v, top, more[wide, band])
            for t in tables:
                keys = probes_of(x, t, axes, probes) if asking else bucket_of(x, t, axes)[:, None]
                n = keys.shape[1]
                of = b.take(pa.array(np.repeat(np.arange(len(v)), n))) if n > 1 else b
                fixed = [pa.array(np.full(len(v) * n, x), pa.int32()) for x in (t, band, wide)]
                yield pa.RecordBatch.from_arrays([*(of.column(c) for c in own), fixed[0], pa.array(keys.ravel(), pa.int64()), *fixed[1:], pa.array(np.full(len(v) * n, asking))], names=[*own, *place, "query"])

        schema = ["id long", "ids array<long>", f"v {kind}", "floor double"] * (not slim) + ["t int", "bucket long", "band int", "wide int", "query boolean"]
        rows = nodes.withColumn("floor", F.lit(float("-inf")))
        if asking:
            rows = nodes.filter("asks")
            rows = rows.withColumn("floor", F.lit(float("-inf"))) if best is None else rows.join(_floors(best, count + 1), F.col("id") == F.col("q"), "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        return rows.select("id", "ids", "v", "floor", "wide", "band").mapInArrow(run, ", ".join(schema))

    crowded = placed(range(TABLES), False, True).groupBy(place).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > BLOCK)
    hot = cut(crowded.select(*place, F.ceil(F.col("c") / BLOCK).cast("int").alias("parts")), "hot")
    few = F.broadcast(hot) if hot.count() <= HOT else hot.hint("merge")
    parts = F.coalesce("parts", F.lit(1))
    best: DataFrame | None = None
    for begin in range(0, TABLES, AT_ONCE):
        tables = range(begin, min(begin + AT_ONCE, TABLES))
        own = placed(tables, False).join(few, place, "left").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
        asking = placed(tables, True).join(few, place, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        both = own.unionByName(asking).drop("parts").repartition(*place, "part").sortWithinPartitions(*place, "part", "query")
        found = _met(both, count + 1)
        after = cut(_first(found if best is None else found.unionByName(best), count + 1), "found")
        if best is not None:
            delete(best)
        best = after
    best = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("best"))
    who = names.filter("asks").select(F.col("id").alias("query_id"), "h").join(nodes.select("h", F.col("id").alias("q")), "h").select("query_id", "q")
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, count)
    out = who.join(best, "q").select("query_id", F.posexplode(others).alias("k", "r"))
    return out.select("query_id", (F.col("k") + 1).alias("rank"), F.col("r.id").alias("vec_id"), (-F.col("r.less")).alias("score"))
