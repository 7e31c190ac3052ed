"""Vector code compression: product codebooks in whole numbers, found by kd-trees.

Vectors become whole numbers (``floor(256 * x)``) and are cut into equal parts.  Each part
position has a codebook of at most ENTRIES entries, which begins as that part of the
smallest ids' vectors.  In each round the codebooks go to every task as kd-trees (their
size is fixed: PARTS codebooks of ENTRIES entries); a part's nearest entry is found by
branch and bound: first in the leaf where the part falls, then in every node whose box is
not farther than the best found, boxes at an equal distance included, so that of equally
near entries the lowest index wins.  A task adds its parts up in whole numbers, entry by
entry, and hands on one row for each entry; the sums of all tasks give the next codebooks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverbed.llm.common import cut

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries in a leaf of a kd-tree.
LEAF = 4
#: Vectors that a task works on at a time.
ROWS = 8192


class Tree:
    """A kd-tree over the entries of one codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._node(np.arange(len(entries)))

    def _node(self, own: np.ndarray) -> tuple:
        """``(low, high, entries, axis, split, left, right)``; a leaf has no children."""
        values = self.entries[own]
        low, high = values.min(axis=0), values.max(axis=0)
        axis = int(np.argmax(high - low)) if values.shape[1] else 0
        if len(own) <= LEAF or (low == high).all():
            return low, high, np.sort(own), None, None, None, None
        order = own[np.argsort(values[:, axis], kind="stable")]
        half = len(own) // 2
        return low, high, None, axis, self.entries[order[half], axis], self._node(order[:half]), self._node(order[half:])

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each point's nearest entry; ties to the lower index."""
        best, index = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(self.entries), np.int64)

        def tried(node: tuple, at: np.ndarray) -> None:
            for k in node[2]:
                apart = points[at] - self.entries[k]
                d = np.einsum("ij,ij->i", apart, apart)
                nearer = (d < best[at]) | (d == best[at]) & (k < index[at])
                best[at[nearer]], index[at[nearer]] = d[nearer], k

        home: dict[int, np.ndarray] = {}

        def descend(node: tuple, at: np.ndarray) -> None:
            if node[2] is not None:
                home[id(node)] = at
                tried(node, at)
                return
            left = points[at, node[3]] < node[4]
            for child, own in ((node[5], at[left]), (node[6], at[~left])):
                if len(own):
                    descend(child, own)

        def visit(node: tuple, at: np.ndarray) -> None:
            out = np.maximum(np.maximum(node[0] - points[at], points[at] - node[1]), 0)
            at = at[np.einsum("ij,ij->i", out, out) <= best[at]]
            if not len(at):
                return
            if node[2] is None:
                visit(node[5], at)
                visit(node[6], at)
            else:
                tried(node, np.setdiff1d(at, home.get(id(node), at[:0]), assume_unique=True))

        every = np.arange(len(points))
        if len(points):
            descend(self.root, every)
            visit(self.root, every)
        return index, best


def limit_of(width: int) -> int:
    """The largest whole component whose squared distances fit a long for so many components."""
    return math.isqrt((2**63 - 1) // max(width, 1)) // 2 - 1


def whole(vectors: np.ndarray, width: int) -> np.ndarray:
    """``floor(256 * x)``, held to the limit of ``limit_of``."""
    top = float(limit_of(width))
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * float(SCALE)), -top, top).astype(np.int64)


def _parts(ids: pa.Array, vectors: pa.ListArray, width: int) -> np.ndarray:
    """The batch's vectors as whole numbers, ``(row, part, component)``."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = whole(flat.reshape(len(ids), -1), width)
    return np.pad(x, ((0, 0), (0, -x.shape[1] % PARTS))).reshape(len(ids), PARTS, -1)


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~broken, F.lit(False))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            yield b.slice(k, ROWS)


def refined(rows: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """The codebooks after one round: entries move to the floor of their parts' mean."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in shared.value]
        total, count = np.zeros(shared.value.shape, object), np.zeros(shared.value.shape[:2], np.int64)
        for b in _batches(batches):
            x = _parts(b.column(0), b.column("v"), width)
            for p, tree in enumerate(trees):
                index, _ = tree.nearest(x[:, p])
                order = np.argsort(index, kind="stable")
                met, first = np.unique(index[order], return_index=True)
                total[p, met] += np.add.reduceat(x[order, p], first, axis=0).astype(object)
                count[p] += np.bincount(index, minlength=shared.value.shape[1])
        met = np.argwhere(count)
        sums = pa.array([[str(s) for s in total[p, e]] for p, e in met], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(met[:, 0], pa.int32()), pa.array(met[:, 1], pa.int32()), pa.array(count[tuple(met.T)], pa.int64()), sums], names=["p", "e", "n", "s"])

    each = rows.mapInArrow(run, "p int, e int, n long, s array<string>")
    whole_sums = [F.sum(F.col("s")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(books.shape[2])]
    out = books.copy()
    # at most PARTS * ENTRIES rows
    for r in each.groupBy("p", "e").agg(F.sum("n").alias("n"), *whole_sums).collect():
        out[r.p, r.e] = [int(r[f"s{k}"]) // r.n for k in range(books.shape[2])]
    return out


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Codes of all vectors under codebooks learned from all of them.

    Returns ``id_col, code, error, label_error, codebooks_sha256`` for each row whose vector
    is there, holds no null or non-finite component and is as long as the first one's (by
    id, nulls last; of equal ids the smaller vector): vectors of another length cannot share
    its codebooks and are dropped.  Lengths that PARTS does not divide are filled up with
    zeros.  Whole components are held to ``limit_of(length)`` (95 million for 64
    components), beyond which a squared distance would leave a long.  Repeated rows are rows
    of their own, a null id or label is kept, further columns are ignored, and fewer
    than ENTRIES vectors give as many entries.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("v"), vectors[label_col].alias("label")).filter(usable(F.col("v")))
    first = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    width = len(first[0].v) if first else 0
    rows = rows.filter(F.size("v") == width)
    seeds = [r.v for r in rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).collect()]
    names = [id_col, "code", "error", "label_error", "codebooks_sha256"]
    if not seeds:
        kind = vectors.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"id {kind}, code string, error long, label_error long, sha string").toDF(*names)
    books = np.ascontiguousarray(_parts(pa.nulls(len(seeds)), pa.array(seeds, pa.list_(pa.float64())), width).transpose(1, 0, 2))
    slim = rows.select("v")
    for _ in range(ROUNDS):
        books = refined(slim, books, width)
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in shared.value]
        for b in _batches(batches):
            x = _parts(b.column("id"), b.column("v"), width)
            found = [tree.nearest(x[:, p]) for p, tree in enumerate(trees)]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            error = np.sum([f[1] for f in found], axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = cut(rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long"), "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("id", "code", "error", "label_error", F.lit(sha).alias("sha")).toDF(*names)
