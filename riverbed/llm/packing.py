"""Hierarchical packing of documents into sequences of several context sizes.

Every task packs the documents of its own input split, so token ids never cross the
network.  A document's whole windows of the longest size stand alone; what is left is
routed to the smallest tier that holds it.  Each tier is packed largest first; gaps in
a long window are filled with whole remainders from its own and the shorter tiers, and
the last gap with a cut from the shortest remainder there is.  What is still open when
the split ends is closed as sequences whose lengths are powers of two, so nothing is
padded.  Sequences of one tier are counted off into step groups of an equal number of
tokens.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverbed.llm.common import text_of

TIERS = (2048, 1024, 512, 256)
#: The pre-tokenizer of byte-level BPE (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct chunks whose ids a task remembers; beyond it the memory is emptied and refilled.
MEMORY = 500_000
#: Chunks of documents that are turned into ids at a time.
SLICE = 250_000


class _Ids:
    """Token ids of whole texts, little-endian, from the ids of their distinct chunks.

    A chunk starts where white space follows something else, or a comma or full stop an
    ASCII letter; byte-level BPE with the usual pattern never joins tokens across such a
    place.  Where the vocabulary is given as ranks too, chunks without special strings
    are encoded by those, which is faster and gives the same ids.
    """

    def __init__(self, tokenizer_file: str, end_id: int, ranks_file: str | None):
        from tokenizers import Tokenizer

        self.tok, self.end, self.fast = Tokenizer.from_file(tokenizer_file), end_id, None
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        if ranks_file:
            import tiktoken

            with open(ranks_file, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memory: dict[str, bytes] = {}

    def learn(self, chunks: list[str]) -> None:
        slow = chunks
        if self.fast:
            slow, encode = [], self.fast.encode_ordinary
            for c in chunks:
                if "<" in c and any(s in c for s in self.special):
                    slow.append(c)
                else:
                    self.memory[c] = array("I", encode(c)).tobytes()
        for k in range(0, len(slow), 1000):
            part = slow[k : k + 1000]
            for c, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.memory[c] = array("I", e.ids).tobytes()

    def of(self, lists: pa.ListArray) -> Iterator[np.ndarray]:
        """The ids of each document of a batch, with its end id."""
        codes = lists.flatten().dictionary_encode()
        distinct = codes.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.memory) > MEMORY:
            self.memory = {}
        self.learn([c for c in distinct if c not in self.memory])
        known = [self.memory[c] for c in distinct]
        parts = list(map(known.__getitem__, codes.indices.to_numpy().tolist()))
        end, begin = np.array([self.end], "<u4").tobytes(), 0
        for stop in np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)).tolist():
            yield np.frombuffer(b"".join(parts[begin:stop]) + end, "<u4")
            begin = stop


class _Packer:
    """Packs pieces ``(doc row, start, ids)`` of one split; see the module's docstring."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, first_sequence: int):
        self.tiers, self.step_tokens, self.next, self.first = tiers, step_tokens, first_sequence, first_sequence
        self.rest: dict[int, list[tuple[int, int]]] = {t: [] for t in tiers}  # (length, key), ascending
        self.pieces: dict[int, tuple] = {}
        self.key = 0
        self.made: dict[int, int] = {t: 0 for t in tiers}
        self.open: list[tuple] = []
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple], size: int) -> None:
        tier = min((t for t in self.tiers if t >= size), default=size)
        step = self.first + self.made.setdefault(tier, 0) * tier // self.step_tokens
        self.made[tier] += 1
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, at, tier, step))
            at += len(ids)
        self.next += 1

    def put(self, piece: tuple) -> None:
        n = len(piece[2])
        self.key += 1
        self.pieces[self.key] = piece
        insort(self.rest[min(t for t in self.tiers if t >= n)], (n, self.key))

    def add(self, doc, ids: np.ndarray) -> None:
        longest, total = self.tiers[0], len(ids)
        whole = total // longest * longest
        for start in range(0, whole, longest):
            self.emit([(doc, start, ids[start : start + longest], total)], longest)
        if total > whole:
            self.put((doc, whole, ids[whole:].copy(), total))

    def take(self, gap: int, tiers: tuple[int, ...]) -> tuple | None:
        """The longest remainder of these tiers that fits the gap, else the gap's length of the shortest."""
        for t in tiers:
            if (k := bisect_right(self.rest[t], (gap, self.key)) - 1) >= 0:
                return self.pieces.pop(self.rest[t].pop(k)[1])
        for t in reversed(self.tiers):
            if self.rest[t]:
                doc, start, ids, total = self.pieces.pop(self.rest[t].pop(0)[1])
                self.put((doc, start + gap, ids[gap:], total))
                return doc, start, ids[:gap], total
        return None

    def pack(self) -> None:
        """Close every window that can be filled; the last open one waits for more."""
        for k, size in enumerate(self.tiers):
            while self.rest[size] or (k == 0 and self.open):
                window, self.open = self.open, []
                gap = size - sum(len(p[2]) for p in window)
                while gap and (piece := self.take(gap, self.tiers[k:])):
                    window.append(piece)
                    gap -= len(piece[2])
                if gap:
                    self.open = window
                    return
                self.emit(window, size)

    def finish(self) -> None:
        left = list(self.open)
        n = sum(len(p[2]) for p in left)
        for size in (1 << b for b in reversed(range(n.bit_length())) if n >> b & 1):
            window, need = [], size
            while need:
                doc, start, ids, total = left.pop(0)
                window.append((doc, start, ids[:need], total))
                if len(ids) > need:
                    left.insert(0, (doc, start + need, ids[need:], total))
                need -= len(window[-1][2])
            self.emit(window, size)
        self.open = []


def pack_documents(docs: DataFrame, tokenizer_file: str, ranks_file: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = 1, step_tokens: int = 65536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document's ids (with ``end_id`` after them) into sequences.

    Returns a row for each piece: ``id_col, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, tier, step_group``.  ``tiers`` are powers of two, longest first.
    A step group is a number of sequences of one tier with ``step_tokens`` tokens together;
    only a split's last group of a tier may be shorter.
    A null or empty text is a document of one id.  Repeated rows are packed each; a null
    id is kept; further columns are ignored; an empty table gives no rows.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers, reverse=True):
        raise ValueError("tiers must be powers of two, longest first")
    chunks = F.split(text_of(docs, text_col), r"(?=[ \n])(?<=[^\s\x85\x1C-\x1F\p{Z}])|(?<=[A-Za-z])(?=[.,])")
    cut = docs.select(docs[id_col].alias("id"), chunks.alias("chunks"))
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in names)])
    arrow_id = pa.int64() if isinstance(docs.schema[id_col].dataType, T.LongType) else None

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task = _Ids(tokenizer_file, end_id, ranks_file), TaskContext.get().partitionId()
        packer = _Packer(tiers, step_tokens, task << 36)

        def out() -> pa.RecordBatch:
            cols = list(zip(*packer.rows, strict=True)) or [[] for _ in schema.names]
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(cols[0], arrow_id), *(pa.array(c, pa.int64()) for c in cols[1:])], names=schema.names)

        for b in batches:
            keys, lists = b.column("id"), b.column("chunks")
            bounds = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(keys):  # so many documents that their ids stay small
                end = max(at + 1, int(np.searchsorted(bounds, (bounds[at - 1] if at else 0) + SLICE)))
                for doc, own in zip(keys.slice(at, end - at).to_pylist(), ids.of(lists.slice(at, end - at)), strict=True):
                    packer.add(doc, own)
                packer.pack()
                at = end
                if packer.rows:
                    yield out()
        packer.finish()
        if packer.rows:
            yield out()

    return cut.mapInArrow(split, schema)
