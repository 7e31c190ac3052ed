"""Exact substring deduplication by a column-wise multi-document suffix order.

Every window of ``length`` bytes is filed under its minimizer: of the 32-byte pieces it
holds, the leftmost one with the least hash.  Equal windows have equal minimizers at the
same place, so they meet in one group, and the windows of one minimizer are one short
segment of text.  Groups that only one segment belongs to are dropped by their hash before
any text moves.

Within a task the segments of its groups, aligned at their minimizers, are a collection of
short documents that is built column by column from the right: each round takes one symbol
of every document, sorts the documents stably by it (the symbols in that order are the
column of the collection's Burrows-Wheeler transform) and updates the common prefix of
each two neighbours.  The columns lie in a temporary file that is read in sequence.
Neighbours with a common prefix of ``length`` or more share the window that begins there.
Rounds number at most twice ``length``, whatever the length of the documents.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverbed.llm.common import cut, delete, text_of

PIECE = 32
#: Windows are handled in slabs of so many starts, so that a place fits in 20 bits.
SLAB = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
#: Documents of a collection are taken up to about so many at a time, whole groups each.
COLLECTION = 20_000
ABSENT = 256

_RNG = np.random.Generator(np.random.PCG64(5))
_SYMBOL = _RNG.integers(0, 2**63, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(2**62, 2**63)) | 1


def _piece_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the PIECE bytes from each place, by doubling."""
    h, power = _SYMBOL[data], _BASE
    k = 1
    while k < PIECE:
        h = h[:-k] * np.uint64(power) + h[k:]
        power = power * power % 2**64
        k *= 2
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def segments(data: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first window, last window, minimizer place, minimizer hash)`` of each run of windows with one minimizer."""
    span, n = length - PIECE + 1, len(data) - length + 1
    whole = np.frombuffer(data, np.uint8)
    for base in range(0, n, SLAB):
        h = _piece_hashes(whole[base : base + min(SLAB, n - base) + length - 1])
        least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        k = 1
        while 2 * k <= span:
            least = np.minimum(least[:-k], least[k:])
            k *= 2
        if span > k:
            least = np.minimum(least[: len(least) - (span - k)], least[span - k :])
        place = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(first[1:], len(place)) - 1
        at = place[first]
        yield first + base, last + base, at + base, h[at].view(np.int64)


def shared_windows(columns: np.ndarray, group: np.ndarray, anchors: int, length: int) -> np.ndarray:
    """Which windows of a collection occur in two of its documents.

    ``columns[c, d]`` is symbol c of document d (ABSENT outside it), documents sorted by
    ``group``; returns ``(window start, document)`` for the first ``anchors`` columns.
    """
    rounds, docs = columns.shape
    shared = np.zeros((anchors, docs), bool)
    order, common = np.arange(docs), np.zeros(docs, np.int16)
    base = group.astype(np.int64) * (ABSENT + 1)
    for c in range(rounds - 1, -1, -1):
        symbol = columns[c][order]
        key = base[order] + symbol
        to = np.argsort(key, kind="stable")
        # the least common prefix between two old places is that of the documents there
        levels = [common]
        gap = np.diff(to)
        same = (key[to][1:] == key[to][:-1]) & (symbol[to][1:] != ABSENT)
        reach = int(gap[same].max()) if same.any() else 1
        while 2 << (len(levels) - 1) <= reach:
            k = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-k], levels[-1][k:]))
        new = np.zeros(docs, np.int16)
        at = np.flatnonzero(same)
        if len(at):
            lo, hi = to[at] + 1, to[at + 1]  # neighbours of one symbol stand at lo - 1 < hi
            level = np.log2(hi - lo + 1).astype(np.int64)
            for one in np.unique(level):
                pick = level == one
                table = levels[one]
                new[at[pick] + 1] = 1 + np.minimum(table[lo[pick]], table[hi[pick] - (1 << one) + 1])
        order, common = order[to], new
        if c < anchors:
            twin = np.flatnonzero(common >= length)
            shared[c, order[twin]] = True
            shared[c, order[twin - 1]] = True
    return shared


class _Collection:
    """Segments of whole groups; see the module's docstring."""

    def __init__(self, length: int):
        self.length, self.before = length, length - PIECE
        self.documents: dict[tuple[int, bytes, int], list] = {}

    def add(self, group: int, content: bytes, anchor: int, text: tuple[int, int], starts: list[int]) -> None:
        self.documents.setdefault((group, content, anchor), []).append((text, starts))

    def spans(self) -> Iterator[tuple[int, int, int, int]]:
        """``(k1, k2, from, to)`` of the runs of bytes that shared windows cover."""
        keys = list(self.documents)
        groups = np.unique(np.array([k[0] for k in keys], np.int64), return_inverse=True)[1]
        rounds = self.before + self.length
        by = np.argsort(groups, kind="stable")
        with tempfile.TemporaryFile() as file:
            file.truncate(rounds * len(keys) * 2)
            columns = np.memmap(file, np.uint16, "r+", shape=(rounds, len(keys)))
            for lo in range(0, len(keys), 2048):
                block = np.full((rounds, min(2048, len(keys) - lo)), ABSENT, np.uint16)
                for j, d in enumerate(by[lo : lo + 2048].tolist()):
                    _, content, anchor = keys[d]
                    left = self.before - anchor
                    block[left : left + len(content), j] = np.frombuffer(content, np.uint8)[: rounds - left]
                columns[:, lo : lo + block.shape[1]] = block
            shared = shared_windows(columns, groups[by], self.before + 1, self.length)
            del columns
        for j, d in enumerate(by.tolist()):
            _, content, anchor = keys[d]
            left, windows, held = self.before - anchor, len(content) - self.length + 1, self.documents[keys[d]]
            twice = len(held) > 1 or len(held[0][1]) > 1
            on = np.ones(windows, bool) if twice else shared[left : left + windows, j]
            edge = np.diff(np.concatenate(([0], on.astype(np.int8), [0])))
            for lo, hi in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                for (k1, k2), starts in held:
                    for s in starts:
                        yield k1, k2, s + lo, s + hi - 1 + self.length


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte that a repeated string of ``length`` bytes covers.

    A string counts if it starts at two places of the corpus, of the same document or not,
    overlaps included, and never crosses documents.  Returns ``id_col, n_bytes, n_removed,
    n_spans, kept_sha256`` for each input row.  A null text is an empty text; texts
    shorter than ``length`` lose nothing; repeated rows repeat each other; a null id is
    kept; further columns are ignored; an empty table gives no rows.
    """
    if length < 2 * PIECE:
        raise ValueError(f"length must be at least {2 * PIECE}")
    id_type = docs.schema[id_col].dataType
    text = text_of(docs, text_col)
    # 128 bits name a text; equal texts are one text
    texts = docs.select(docs[id_col].alias("id"), text.alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    long = texts.filter(F.octet_length("text") >= length)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, many, sizes = [], [], []
            for t in b.column("text").to_pylist():
                found = [h for *_, h in segments(t.encode(), length)]
                h, n = np.unique(np.concatenate(found), return_counts=True)
                hs.append(h)
                many.append(n > 1)
                sizes.append(len(h))
            of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*hs, np.zeros(0, np.int64)])), b.column("k1").take(of), b.column("k2").take(of), pa.array(np.concatenate([*many, np.zeros(0, bool)]))], names=["h", "k1", "k2", "many"])

    filed = cut(long.select("text", "k1", "k2").mapInArrow(keys, "h long, k1 long, k2 long, many boolean"), "minimizers")
    shared = filed.groupBy("h").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi"), F.max("many").alias("many")).filter("lo <> hi or many").select("h")
    wanted = cut(filed.join(shared, "h").groupBy("k1", "k2").agg(F.collect_set("h").alias("hs")), "wanted")
    delete(filed)
    copies = cut(long.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "copies")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "anchor", "content", "k1", "k2", "starts"]
        for b in batches:
            for t, k1, k2, hs in zip(*(b.column(n).to_pylist() for n in ("text", "k1", "k2", "hs")), strict=True):
                data, hs = t.encode(), np.array(hs, np.int64)
                own: dict[tuple[int, int, bytes], list[int]] = {}
                for first, last, at, h in segments(data, length):
                    on = np.isin(h, hs)
                    for f, e, a, g in zip(first[on].tolist(), last[on].tolist(), at[on].tolist(), h[on].tolist(), strict=True):
                        own.setdefault((g, a - f, data[f : e + length]), []).append(f)
                rows = list(own)
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array([k1] * n, pa.int64()), pa.array([k2] * n, pa.int64()), pa.array([own[r] for r in rows], pa.list_(pa.int32()))], names=names)

    one_each = long.join(wanted.join(copies, ["k1", "k2"]), ["k1", "k2"]).filter("id <=> rep").select("text", "k1", "k2", "hs")
    pieces = one_each.mapInArrow(cut_out, "h long, anchor int, content binary, k1 long, k2 long, starts array<int>")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "lo", "hi"]

        def out(c: _Collection) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for r in c.spans():
                rows.append(r)
                if len(rows) == 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)

        c, group = _Collection(length), None
        for b in batches:
            for h, anchor, content, k1, k2, starts in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if h != group and len(c.documents) >= COLLECTION:
                    yield from out(c)
                    c = _Collection(length)
                group = h
                c.add(h, content, anchor, (k1, k2), starts)
        if c.documents:
            yield from out(c)

    runs = pieces.repartition("h").sortWithinPartitions("h").mapInArrow(collect, "k1 long, k2 long, lo long, hi long")
    spans = runs.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    found = cut(spans.join(copies.filter("copies > 1").select("k1", "k2", "copies"), ["k1", "k2"], "full_outer"), "spans")
    schema = T.StructType([T.StructField(id_col, id_type), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, spans, n in zip(*(b.column(c).to_pylist() for c in ("text", "spans", "copies")), strict=True):
                data = t.encode()
                gone = [(0, len(data))] if n else _merged([(s["lo"], s["hi"]) for s in spans or ()])
                kept, at = hashlib.sha256(), 0
                for lo, hi in gone:
                    kept.update(data[at:lo])
                    at = hi
                kept.update(data[at:])
                rows.append((len(data), sum(hi - lo for lo, hi in gone), len(gone), kept.hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=schema.names)

    return texts.join(found, ["k1", "k2"], "left").select("id", "text", "spans", "copies").mapInArrow(remove, schema)
