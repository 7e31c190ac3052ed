"""The prefix trie of conversations, built as a Patricia trie.

A turn is a 16-byte digest of its role and text and the number of its text's characters; a
conversation is the array of its turns, and equal conversations are one sequence.  The
distinct sequences are sorted over all tasks.  Of the trie only points are made: nodes where
sequences part, end or have no child; the edge between two points holds the turns of the
nodes between them, which have one child each.  A task walks its sorted sequences with a
stack of the open points of the last one: with the common prefix of two neighbours it knows
which points are complete.  The nodes that reach into a neighbouring task are those on the
common prefix of two tasks' last and first sequences; they are handed on node by node by
every task that they reach into, and added up by their keys.  All figures of a subtree are
sums or minima, so that is exact:

``saved = sum of n * chars - sum of chars`` over the nodes of the subtree, the first of which
every task adds up for its own sequences and the second once, where the node begins.

In the end each edge is unfolded: its unary nodes have the members of the point below, and
what they save is the point's figure plus (members - 1) times the suffix sum of the edge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverbed.llm.common import cut, delete

#: Conversations of so many ids in a row are joined to one piece of a node's list of ends.
IDS = 4096
#: Points in an output batch.
ROWS = 20_000
EMPTY = hashlib.sha256(b"").hexdigest()
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, turns)``: each conversation's ``(sym, chars)`` in the order of its turns.

    Null turn numbers come first; rows of one turn number are ordered by the MD5 of the
    role's length, a colon, the role and the text.  A null role or text is empty.  Rows with
    a null id belong to no conversation and are passed over; repeated rows are turns of
    their own; further columns are ignored.
    """
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    sym = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    flat = turns.select(turns[conv_col].cast("long").alias("conv"), turns[turn_col].alias("turn"), sym.alias("sym"), F.length(text).alias("chars")).filter("conv is not null")
    own = F.sort_array(F.collect_list(F.struct("turn", "sym", "chars")))
    return flat.groupBy("conv").agg(F.transform(own, lambda x: F.struct(x["sym"].alias("sym"), x["chars"].alias("chars"))).alias("turns"))


def rebuilt(turns: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """``(conv, turns)`` with the first turns of the block's first conversation before its own.

    Conversation c takes the first ``crc32(c) % heads`` turns of conversation
    ``c - c % block`` (the remainder has c's sign), all if there are fewer and none if it is
    absent, and then its own turns behind its first so many.
    """
    own = ordered_turns(turns)
    own = own.withColumn("base", F.col("conv") - F.col("conv") % block).withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int"))
    first = own.filter("conv = base").select("base", F.slice("turns", 1, heads - 1).alias("first"))
    both = own.join(first, "base", "left")
    head = F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    tail = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.select("conv", F.concat(head, tail).alias("turns"))


def _common(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common at their begin."""
    n = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y), False)
    return F.when(differs > 0, differs - 1).otherwise(n).cast("int")


def _ends(members: DataFrame) -> DataFrame:
    """``(key, sha)``: the digest of each sequence's conversations, joined in the order of their numbers.

    Pieces of bounded size are joined first; a digest then reads its pieces one after the
    other, and none is held longer than that.
    """
    piece = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = members.groupBy("key", F.floor(F.col("conv") / IDS).alias("at")).agg(piece.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []
        for b in batches:
            for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if k != key:
                    if digest:
                        out.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_pylist([{"key": k, "sha": s} for k, s in out], schema=kind)
                out = []
        if digest:
            out.append((key, digest.hexdigest()))
        yield pa.RecordBatch.from_pylist([{"key": k, "sha": s} for k, s in out], schema=kind)

    kind = pa.schema([("key", pa.string()), ("sha", pa.string())])
    return pieces.repartition("key").sortWithinPartitions("key", "at").mapInArrow(run, "key string, sha string")


class _Point:
    """An open point of the trie; the sums leave out the point's own text."""

    __slots__ = ("depth", "key", "left", "conv", "n", "children", "has", "leaves", "weighed", "chars", "sha")

    def __init__(self, depth: int, key: tuple[int, int], left: bool = False):
        self.depth, self.key, self.left = depth, key, left
        self.conv = self.sha = None
        self.n = self.children = self.leaves = self.weighed = self.chars = 0
        self.has = False


_POINT = "k1 long, k2 long, depth int, p1 long, p2 long, from int, suffix array<long>, conv long, n long, children long, leaves long, weighed long, chars long, sha string, whole boolean"
_KIND = pa.schema([(x.split(" ")[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}[x.split(" ")[1]]) for x in _POINT.split(", ")])


class _Walk:
    """A task's walk over its sorted sequences.

    ``before`` and ``after`` are the lengths of the prefixes that the first and the last
    sequence share with the neighbouring tasks, -1 where there is none.
    """

    def __init__(self, before: int, after: int):
        self.before, self.after = before, after
        self.stack: list[_Point] = []
        self.rows: list[tuple] = []

    def begin(self, keys: np.ndarray, chars: np.ndarray) -> None:
        self.keys, self.sizes = keys, chars
        self.stack = [_Point(d, self._key(d), self.before >= 0) for d in range(max(self.before, 0) + 1)]

    def _key(self, depth: int) -> tuple[int, int]:
        return (int(self.keys[depth, 0]), int(self.keys[depth, 1]))

    def _emit(self, c: _Point, parent: _Point | None, suffix: list[int], whole: bool) -> None:
        p = parent or _Point(-1, (0, 0))
        self.rows.append((*c.key, c.depth, *p.key, p.depth, suffix, c.conv, c.n, c.children, c.leaves, c.weighed, c.chars, c.sha, whole))

    def _close(self, c: _Point, parent: _Point) -> list[int]:
        """Adds a point to its parent; returns the suffix sums of the edge between them."""
        suffix = np.cumsum(self.sizes[parent.depth : c.depth][::-1])[::-1].tolist()
        parent.conv = c.conv if parent.conv is None or c.conv is not None and c.conv < parent.conv else parent.conv
        parent.n += c.n
        parent.has = True
        parent.children += not c.left
        if not c.has:
            c.leaves = 1
        parent.leaves += c.leaves
        parent.weighed += c.weighed + c.n * suffix[0]
        parent.chars += c.chars + (0 if c.left else suffix[0])
        return suffix

    def cut_to(self, depth: int) -> None:
        """Closes all points below a depth of the last sequence's path; one stands there then."""
        while self.stack[-1].depth > depth:
            c = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(_Point(depth, self._key(depth)))
            self._emit(c, self.stack[-1], self._close(c, self.stack[-1]), not c.left)

    def add(self, keys: np.ndarray, chars: np.ndarray, common: int, conv: int, copies: int, sha: str) -> None:
        """The next sequence, which has its first ``common`` turns from the one before."""
        if self.stack:
            self.cut_to(common)
            self.keys, self.sizes = keys, chars
        else:
            self.begin(keys, chars)
        if len(chars) > self.stack[-1].depth:
            self.stack.append(_Point(len(chars), self._key(len(chars))))
        p = self.stack[-1]
        p.conv, p.n, p.sha = conv, copies, sha

    def end(self) -> None:
        """Closes everything; nodes that reach into the next task are handed on one by one."""
        if not self.stack:
            return
        if self.after < 0:
            self.cut_to(0)
            root = self.stack.pop()
            root.leaves = root.leaves if root.has else 1
            self._emit(root, None, [0], not root.left)
            return
        self.cut_to(self.after)
        self.stack[-1].has = True  # the next task has the child
        while self.stack:
            c = self.stack.pop()
            while c.depth and (not self.stack or self.stack[-1].depth < c.depth - 1):
                between = _Point(c.depth - 1, self._key(c.depth - 1))
                self._emit(c, between, self._close(c, between), False)
                c = between
            if self.stack:
                self._emit(c, self.stack[-1], self._close(c, self.stack[-1]), False)
            else:
                self._emit(c, None, [0], False)

    def taken(self) -> pa.RecordBatch:
        columns, self.rows = list(zip(*self.rows, strict=True)) or [[]] * len(_KIND), []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _KIND, strict=True)], schema=_KIND)


def _prefix_keys(syms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128-bit keys of all prefixes: sums of the turns' digests, each mixed with its place.

    One row for each sequence's empty prefix, followed by those of its turns.
    """
    begins = np.cumsum(sizes) - sizes
    place = np.arange(len(syms)) - np.repeat(begins, sizes)
    x = (syms + (place[:, None].astype(np.uint64) + np.uint64(1)) * _STEP) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    total = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(x, axis=0, dtype=np.uint64)])
    at = np.arange(len(syms) + len(sizes)) - np.repeat(np.arange(len(sizes)), sizes + 1)
    return (total[at] - np.repeat(total[begins], sizes + 1, axis=0)).view(np.int64)


def _points(sequences: DataFrame, edges: dict[int, tuple[int, int]]) -> DataFrame:
    """The points of every task's sorted sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, at, last = None, None, []
        for b in batches:
            lists = b.column("syms")
            sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_pylist()
            keys = _prefix_keys(np.frombuffer(b"".join(flat), "<u8").reshape(-1, 2), sizes)
            chars = b.column("chars").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            for k, (pid, conv, n, sha) in enumerate(zip(*(b.column(c).to_pylist() for c in ("pid", "conv", "n", "sha")), strict=True)):
                if pid != at:
                    if walk:
                        walk.end()
                        yield walk.taken()
                    walk, at, last = _Walk(*edges[pid]), pid, []
                lo, hi = int(ends[k] - sizes[k]), int(ends[k])
                own = flat[lo:hi]
                common = next((i for i, (x, y) in enumerate(zip(last, own)) if x != y), min(len(last), len(own)))
                walk.add(keys[lo + k : hi + k + 1], chars[lo:hi], common, conv, n, sha)
                last = own
                if len(walk.rows) >= ROWS:
                    yield walk.taken()
        if walk:
            walk.end()
            yield walk.taken()

    return sequences.mapInArrow(run, _POINT)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of ``(conv, turns)``, as ``ordered_turns`` or ``rebuilt`` give them.

    Returns ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (of the node
    above; null for the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and
    ``ends_sha256`` for each node, the textless root included.  A conversation without a
    turn is a member of the root alone; a table without conversations has no node.  The
    turns of one conversation (24 bytes each) are held together; nothing else that grows is.
    """
    syms = F.transform("turns", lambda t: t["sym"])
    whole = conversations.select("conv", "turns", F.md5(F.array_join(F.transform(syms, F.hex), "")).alias("key"))
    distinct = whole.groupBy("key").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.first("turns").alias("turns"))
    named = distinct.join(_ends(whole.select("key", "conv")), "key")
    dealt = named.select(syms.alias("syms"), F.transform("turns", lambda t: t["chars"]).alias("chars"), "conv", "n", "sha").repartitionByRange("syms")
    dealt = cut(dealt.withColumn("pid", F.spark_partition_id()), "sequences")
    bounds = dealt.groupBy("pid").agg(F.min("syms").alias("lo"), F.max("syms").alias("hi"))
    # one row for each task, with the prefix that it shares with the one before
    earlier = F.lag("hi").over(Window.orderBy("pid"))
    before = sorted((r.pid, r.before) for r in bounds.select("pid", F.when(earlier.isNull(), -1).otherwise(_common(earlier, F.col("lo"))).alias("before")).collect())
    edges = {pid: (at, before[k + 1][1] if k + 1 < len(before) else -1) for k, (pid, at) in enumerate(before)}
    sequences = dealt.repartitionById(max(edges, default=0) + 1, F.col("pid")).sortWithinPartitions("pid", "syms")
    made = cut(_points(sequences, edges), "points")
    delete(dealt)
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "weighed", "chars")]
    kept = ["k1", "k2", "depth", "p1", "p2", "from", "suffix", "conv", "n", "children", "leaves", "weighed", "chars", "sha"]
    border = made.filter("not whole").groupBy("k1", "k2", "depth", "p1", "p2", "from", "suffix").agg(F.min("conv").alias("conv"), *sums, F.max("sha").alias("sha"))
    points = made.filter("whole").select(kept).unionByName(border.select(kept))
    above = points.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("depth").alias("from"), F.col("conv").alias("above"))
    full = points.join(above, ["p1", "p2", "from"], "left")
    last = F.col("i") == F.size("suffix") - 1
    nodes = full.select("*", F.posexplode("suffix").alias("i", "below"))
    return nodes.select(
        F.col("conv").alias("conv_id"),
        (F.col("from") + 1 + F.col("i")).cast("long").alias("depth"),
        F.when(F.col("i") == 0, F.col("above")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("weighed") - F.col("chars") + (F.col("n") - 1) * F.col("below")).alias("saved_tokens"),
        F.when(last, F.coalesce("sha", F.lit(EMPTY))).otherwise(EMPTY).alias("ends_sha256"),
    )
