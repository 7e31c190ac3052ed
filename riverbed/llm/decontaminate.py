"""Benchmark decontamination by edit distance.

The CGK random walk copies a text symbol by symbol, staying or stepping on by a random
bit for each place and symbol; texts at a small edit distance fall into step again after
each edit, so their walks differ in few places.  Repeated samples of walk places are the
LSH keys under which windows of documents meet windows of items.  Windows are as long as
the items (sizes go by quarters) and begin at several places of an item, so that a
rewritten head does not matter.

Windows of documents begin at every place but those that a count of q-grams excludes: an
item within so many edits leaves so many of its q-grams as they were, all at nearly one
distance from their places in the item; where no item has as many, none can be.  This
filter loses nothing, so the walks alone decide about recall.  Items too short for sampled
walks are taken as the filter (of shorter q-grams) leaves them.  What has met is confirmed
by the exact edit distance.  Nothing of a document is shuffled, and each is read once for
SCAN bytes of items.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.llm.common import text_of

#: An item is found where its edit distance is at most this share of its length.
MAX_EDITS = 0.1
#: q-grams by which places are excluded: of items for walks, and of shorter ones.
GRAM, SHORT_GRAM = 8, 4
#: Shorter q-grams by which a stretch is tried before the edit distance, and the bits of their hashes.
TRIED_GRAM, TRIED_BITS = 5, 16
#: Items of fewer bytes, or of which the edits may leave fewer q-grams, are short.
SHORT, LEAST = 80, 4
#: Keys are WALKS walks with KEYS samples of PLACES places each.
WALKS, KEYS, PLACES = 4, 12, 3
#: Eighths of an item at which its windows begin.
BEGINS = (0, 2)
#: Bits of the table of q-grams, bytes of items in a block and in one pass over the documents.
BITS, BLOCK, SCAN = 22, 1 << 20, 1 << 22
#: Meetings of q-grams that are counted, and windows that are walked, at a time.
COUNTS, STARTS = 1 << 22, 10_000
#: Bytes of text that are searched at a time.
SLICE = 1 << 21

_ODD = np.random.Generator(np.random.PCG64(11)).integers(0, 2**62, PLACES + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def normal(text: str | None) -> bytes:
    """Lower case, runs of ASCII white space as one space, none at the ends; UTF-8."""
    return b" ".join((text or "").lower().encode(errors="ignore").split())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def size_of(length: int) -> int:
    """The largest window size up to a length: 32 bytes, and a quarter more each time."""
    size = 32
    while size + size // 4 <= length:
        size += size // 4
    return size


class Walks:
    """The walks over windows of one size and the keys sampled from them."""

    def __init__(self, size: int):
        rng = np.random.Generator(np.random.PCG64(size))
        self.steps, self.size = 2 * size, size
        self.bits = rng.integers(0, 2, (WALKS, self.steps, 256), dtype=np.uint8)
        self.places = np.array([[rng.choice(self.steps, PLACES, replace=False) for _ in range(KEYS)] for _ in range(WALKS)])

    def keys(self, w: int, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The keys ``(key, window)`` of a walk over the windows at the starts; the data go on for ``steps`` bytes behind the last."""
        wanted, at, met = set(self.places[w].ravel().tolist()), starts.copy(), {}
        for t in range(max(wanted) + 1):
            symbol = data[at]
            if t in wanted:
                met[t] = symbol.astype(np.uint64)
            at += self.bits[w, t][symbol]
        out = np.empty((KEYS, len(starts)), np.uint64)
        for k, places in enumerate(self.places[w].tolist()):
            key = sum(met[t] * o for t, o in zip(places, _ODD[:PLACES], strict=True))
            out[k] = _mix(key + np.array([self.size * 1000 + w * KEYS + k], np.uint64) * _ODD[PLACES])
        return out


@functools.lru_cache(maxsize=64)
def walks_of(size: int) -> Walks:
    return Walks(size)


def best_distance(item: str, text: str, most: int) -> int:
    """The least edit distance between the item and any stretch of the text (bit-parallel), or most + 1."""
    m, masks = len(item), {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = m
    for c in text:
        eq = masks.get(c, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | x
        plus, minus = down | ~(d | up) & full, up & d
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(d | plus) & full, plus & d
        best = min(best, score)
    return min(best, most + 1)


def packed(data: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes (8 at most) from each place, as one number."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    out, have = data.astype(np.uint64), 1
    while have < size:  # each step joins two numbers, which overlap in the last one
        more = min(have, size - have)
        out = out[:-more] << np.uint64(8 * more) | out[more:] & np.uint64((1 << 8 * more) - 1)
        have += more
    return out


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges that begin at ``first`` and are so long, one after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first, size)


class Filter:
    """Where in a text items can begin, by the q-grams that their edits must leave."""

    def __init__(self, items: list[int], data: list[np.ndarray], edits: list[int], wide: list[int], gram: int):
        self.items, self.gram = np.array(items), gram
        self.reach = max(len(data[i]) for i in items)
        # an edit changes the q-grams that overlap one character, and moves what is behind it by as much
        self.need = np.array([max(1, len(data[i]) - gram + 1 - edits[i] * (gram - 1 + wide[i])) for i in items])
        self.room = np.array([edits[i] * wide[i] for i in items])
        slots = [self._slots(data[i]) for i in items]
        order = np.argsort(np.concatenate(slots), kind="stable")
        self.item = np.repeat(np.arange(len(items)), [len(s) for s in slots])[order]
        self.off = np.concatenate([np.arange(len(s)) for s in slots])[order]
        self.first = np.searchsorted(np.concatenate(slots)[order], np.arange((1 << BITS) + 1)).astype(np.int32)
        self.hit = np.diff(self.first) > 0

    def _slots(self, data: np.ndarray) -> np.ndarray:
        return (_mix(packed(data, self.gram)) >> np.uint64(64 - BITS)).astype(np.int64)

    def stride(self, size: int) -> int:
        """``item * stride + begin + reach`` tells items and places apart, and items by more than their room."""
        return size + 2 * self.reach + 4 * int(self.room.max()) + 1

    def left(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where items may begin: the first and last ``item * stride + begin + reach`` of each stretch, in order."""
        slots = self._slots(data)
        at = np.flatnonzero(self.hit[slots]) if len(slots) else np.zeros(0, np.int64)
        slots = slots[at]
        n = (self.first[slots + 1] - self.first[slots]).astype(np.int64)
        turn = np.cumsum(n) // COUNTS
        parts, stride = [], self.stride(len(data))
        for lo, hi in itertools.pairwise(np.append(np.flatnonzero(np.diff(turn, prepend=-1)), len(turn)).tolist()):
            p = spans(self.first[slots[lo:hi]].astype(np.int64), n[lo:hi])
            met = self.item[p] * stride + (np.repeat(at[lo:hi], n[lo:hi]) - self.off[p] + self.reach)
            met.sort()
            if not turn[-1]:
                parts.append((met, None))
            else:
                new = np.flatnonzero(np.diff(met, prepend=-1))
                parts.append((met[new], np.diff(np.append(new, len(met)))))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = parts[0][0]
        item = keys // stride
        if len(parts) == 1 and parts[0][1] is None:
            last = np.arange(len(keys)) + self.need[item] - 1
        else:
            keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            item = keys // stride
            total = np.cumsum(np.bincount(inverse, np.concatenate([c for _, c in parts])).astype(np.int64))
            last = np.searchsorted(total, np.append(0, total[:-1]) + self.need[item])
        # so many q-grams at places that differ by no more than the edits can move them
        i = np.flatnonzero(last < len(keys))
        room = self.room[item[i]]
        near = keys[last[i]] - keys[i] <= 2 * room
        i, room = i[near], room[near]
        lo, hi = keys[last[i]] - room, keys[i] + room
        new = np.append(True, lo[1:] > np.maximum.accumulate(hi)[:-1] + 1)[: len(lo)]
        first = np.flatnonzero(new)
        return (lo[first], np.maximum.reduceat(hi, first)) if len(lo) else (lo, hi)


class Block:
    """A block of items, with all that a task needs to find them."""

    def __init__(self, rows: tuple[tuple[int, str], ...], max_edits: float):
        self.rows = rows
        self.most = [int(np.floor(len(t) * max_edits)) for _, t in rows]
        self.data = [np.frombuffer(t.encode(), np.uint8) for _, t in rows]
        self.wide = [max(len(c.encode()) for c in set(t)) for _, t in rows]
        self.exact = [i for i, k in enumerate(self.most) if not k]
        remains = [len(d) - GRAM + 1 - k * (GRAM - 1 + w) for d, k, w in zip(self.data, self.most, self.wide, strict=True)]
        long = [i for i, d in enumerate(self.data) if self.most[i] and len(d) >= SHORT and remains[i] >= LEAST]
        short = [i for i in range(len(rows)) if self.most[i] and not (len(self.data[i]) >= SHORT and remains[i] >= LEAST)]
        self.filters = [(Filter(own, self.data, self.most, self.wide, gram), walked) for own, gram, walked in ((long, GRAM, True), (short, SHORT_GRAM, False)) if own]
        self.tried = [self._tried(d) for d in self.data]
        self.held = np.zeros(1 << TRIED_BITS, bool)
        # windows of the long items: number in the filter, begin, size
        self.windows = np.array([(k, len(self.data[i]) * e // 8, size_of(len(self.data[i]) - len(self.data[i]) * e // 8)) for k, i in enumerate(long) for e in BEGINS], np.int64).reshape(-1, 3)
        self.first = np.searchsorted(self.windows[:, 0], np.arange(len(long) + 1))
        self.known = {}
        for size in np.unique(self.windows[:, 2]).tolist():
            own = self.windows[self.windows[:, 2] == size]
            text = np.concatenate([x for k, begin, _ in own.tolist() for x in (self.data[long[k]][begin:], np.zeros(2 * size, np.uint8))])
            sizes = np.array([len(self.data[long[k]]) - begin + 2 * size for k, begin, _ in own.tolist()])
            for w in range(WALKS):
                keys = walks_of(size).keys(w, text, np.cumsum(sizes) - sizes).ravel()
                order = np.argsort(keys, kind="stable")
                self.known[size, w] = keys[order], np.tile(np.arange(len(own)), KEYS)[order], own

    @staticmethod
    def _tried(data: np.ndarray) -> np.ndarray:
        return (_mix(packed(data, TRIED_GRAM)) >> np.uint64(64 - TRIED_BITS)).astype(np.int64)

    def _distance(self, i: int, text: bytes) -> int:
        """The least edit distance of an item in a stretch, or what is more than it may be."""
        most, grams = self.most[i], self._tried(np.frombuffer(text, np.uint8))
        # the edits leave so many of the item's shorter q-grams somewhere in the stretch
        self.held[grams] = True
        enough = np.count_nonzero(self.held[self.tried[i]]) >= len(self.tried[i]) - most * (TRIED_GRAM - 1 + self.wide[i])
        self.held[grams] = False
        return best_distance(self.rows[i][1], text.decode(errors="ignore"), most) if enough else most + 1

    def _met(self, f: Filter, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """In which of the stretches that are left a window has met its item under a key."""
        stride, out = f.stride(len(data)), np.zeros(len(lo), bool)
        padded = np.concatenate([data, np.zeros(2 * int(self.windows[:, 2].max()) + 1, np.uint8)])
        for w in range(WALKS):  # the next walk for those that have not met their item
            open_ = np.flatnonzero(~out)
            items = lo[open_] // stride
            n = self.first[items + 1] - self.first[items]
            windows = self.windows[spans(self.first[items], n)]
            begin = np.repeat(lo[open_] % stride - f.reach, n) + windows[:, 1]
            end = begin + np.repeat(hi[open_] - lo[open_] + 1, n)
            for size in np.unique(windows[:, 2]).tolist():
                mine, (known, number, own) = windows[:, 2] == size, self.known[size, w]
                a, b = np.clip(begin[mine], 0, len(data)), np.clip(end[mine], 0, len(data))
                starts = np.unique(spans(a, b - a))
                for at in range(0, len(starts), STARTS):
                    some = starts[at : at + STARTS]
                    keys = walks_of(size).keys(w, padded, some).ravel()
                    a, b = np.searchsorted(known, keys), np.searchsorted(known, keys, side="right")
                    on = np.flatnonzero(b > a)
                    window = own[number[spans(a[on], b[on] - a[on])]]
                    start = np.repeat(np.tile(some, KEYS)[on], b[on] - a[on]) - window[:, 1] + f.reach
                    place = window[:, 0] * stride + np.maximum(start, 0)
                    of = np.searchsorted(lo, place, side="right") - 1
                    out[of[(of >= 0) & (place <= hi[of])]] = True
        return out

    def find(self, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """``(number of the text, item, least edit distance)`` of all items found."""
        gap = bytes(GRAM)
        data = np.frombuffer(gap.join(texts) + gap, np.uint8)
        sizes = np.array([len(x) for x in texts], np.int64)
        begins = np.cumsum(sizes + len(gap)) - sizes - len(gap)
        for i in self.exact:
            word = self.data[i].tobytes()
            yield from ((d, i, 0) for d, t in enumerate(texts) if word in t)
        for f, walked in self.filters:
            first, last = f.left(data)
            met = self._met(f, data, first, last) if walked and len(first) else np.ones(len(first), bool)
            pairs: dict[tuple[int, int], list[tuple[int, int, bool]]] = {}
            stride = f.stride(len(data))
            for a, b, hit in zip(first.tolist(), last.tolist(), met.tolist(), strict=True):
                i, room = int(f.items[a // stride]), int(f.room[a // stride])
                lo, hi = a % stride - f.reach - room, b - a // stride * stride - f.reach + len(self.data[i]) + 2 * room
                for d in range(int(np.searchsorted(begins + sizes, lo, side="right")), int(np.searchsorted(begins, hi))):
                    if sizes[d]:
                        pairs.setdefault((d, i), []).append((max(0, lo - int(begins[d])), max(0, hi - int(begins[d])), hit))
            for (d, i), stretches in pairs.items():
                if any(hit for *_, hit in stretches):
                    near = lambda met: min((self._distance(i, texts[d][lo:hi]) for lo, hi, hit in stretches if hit is met), default=self.most[i] + 1)  # noqa: E731,B023
                    least = near(True)
                    if least <= self.most[i]:  # whatever is that near lies in one of the stretches
                        yield d, i, min(least, near(False))


@functools.lru_cache(maxsize=SCAN // BLOCK)
def block_of(rows: tuple[tuple[int, str], ...], max_edits: float) -> Block:
    """A worker builds a block once for all of its tasks."""
    return Block(rows, max_edits)


def contaminated(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Documents that hold a benchmark item, up to a share of edits.

    Returns a row ``id_col, item_col, edit_distance, item_chars`` for each pair found:
    the least edit distance between the item and a stretch of the document, both in lower
    case with white space collapsed, is at most ``max_edits`` of the item's length.  Null
    texts hold nothing; null items and items without a character but white space are in
    nothing; rows with a null id are passed over; repeated rows give one row; further
    columns are ignored; empty tables give no rows.
    """
    bench = items.select(items[item_col].cast("long").alias("item"), text_of(items, "text").alias("text")).filter("item is not null")
    size = int(bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    scans = -(-size // SCAN)
    flat = docs.select(docs[id_col].cast("long").alias("doc"), text_of(docs, text_col).alias("text")).filter("doc is not null and text <> ''")
    numbered = bench.withColumn("scan", F.pmod(F.xxhash64("item", "text"), F.lit(max(scans, 1))))

    def search(blocks: list[tuple]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def found(ids: list, texts: list[bytes]) -> pa.RecordBatch:
                hits = [(ids[d], rows[i][0], e, len(rows[i][1])) for rows in shared.value for d, i, e in block_of(rows, max_edits).find(texts)]
                return pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], pa.int64()) for k in range(4)], names=["doc", "item", "d", "n"])

            for b in batches:
                ids, texts, size = [], [], 0
                for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), strict=True):
                    ids.append(doc)
                    texts.append(normal(text))
                    size += len(texts[-1]) + GRAM
                    if size >= SLICE:
                        yield found(ids, texts)
                        ids, texts, size = [], [], 0
                if ids:
                    yield found(ids, texts)

        return flat.mapInArrow(run, "doc long, item long, d long, n long")

    sure = docs.sparkSession.createDataFrame([], "doc long, item long, d long, n long")
    for k in range(scans):
        read = numbered.filter(F.col("scan") == k).select("item", "text").distinct().collect()  # about SCAN bytes
        blocks, now, size = [], [], 0
        for row in sorted({(r.item, text) for r in read if (text := normal(r.text).decode())}):
            now.append(row)
            size += len(row[1].encode())
            if size >= BLOCK:
                blocks.append(tuple(now))
                now, size = [], 0
        blocks += [tuple(now)] if now else []
        if blocks:
            sure = sure.unionByName(search(blocks))
    return sure.groupBy("doc", "item").agg(F.min("d").alias("edit_distance"), F.min_by("n", "d").alias("item_chars")).select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "edit_distance", "item_chars")
