"""Substring deduplication by content-defined chunks.

A gear rolling hash places chunk ends by content, so an insertion changes the chunks
around it and no others.  Each distinct chunk (by digest) is kept at its first place in the
smallest document that has it; everywhere else it is removed where it stands in a run of
such chunks of LEAST bytes or more, or where these are the whole text.  Small chunks find
most of a passage that repeats; the run keeps what two texts have in common by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverbed.llm.common import cut, text_of

#: Chunk sizes in bytes: none ends before MIN (but a text's last), ends are 1 in 2**BITS bytes after it.
MIN_BYTES, BITS, MAX_BYTES = 32, 5, 1024
#: Bytes of a run of repeated chunks from which it is removed.
LEAST = 96
#: A chunk ends where the top BITS bits of the gear hash, which 32 bytes decide, are zero.
_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 2**32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash at every byte: h[i] = (h[i - 1] << 1) + G[data[i]], by doubling."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[k:] += h[:-k] << np.uint32(k)
        h = longer
    return h


def chunk_ends(data: bytes) -> list[int]:
    array = np.frombuffer(data, np.uint8)
    out, last, n = [], 0, len(data)
    for e in (np.flatnonzero(gear(array) >> np.uint32(32 - BITS) == 0) + 1).tolist():
        while e - last > MAX_BYTES:
            last += MAX_BYTES
            out.append(last)
        if e - last >= MIN_BYTES:
            out.append(e)
            last = e
    while n - last > MAX_BYTES:
        last += MAX_BYTES
        out.append(last)
    if n > last:
        out.append(n)
    return out


def chunks(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """``(start, end, digest)`` of a text's chunks."""
    start = 0
    for end in chunk_ends(data):
        yield start, end, hashlib.blake2b(data[start:end], digest_size=16).digest()
        start = end


def dedup_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove the runs of chunks that an earlier place of the corpus holds.

    Returns ``id_col, n_bytes, n_chunks, n_shared_chunks, n_removed, n_spans,
    kept_sha256`` for each input row: ``n_shared_chunks`` counts chunks that another
    document holds too, ``n_removed`` the bytes removed, ``n_spans`` their maximal runs,
    and the digest is of the remaining bytes.  A null text is an empty text.  Rows with a
    null id are returned whole and take no part.  Rows of one id are one document: equal
    repeats get equal rows.  Further columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found = [], []
            for doc, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = {d for _, _, d in chunks(text.encode())}
                ids += [doc] * len(own)
                found += own
            pair = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(ids, pa.int64())], names=["d1", "d2", "id"])

    held = texts.filter("id is not null").mapInArrow(digests, "d1 long, d2 long, id long")
    shared = held.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first <> last").select("d1", "d2", "first")
    hits = held.join(shared, ["d1", "d2"]).groupBy("id").agg(F.collect_set(F.struct("d1", "d2", (F.col("first") == F.col("id")).alias("first"))).alias("hits"))
    hits = cut(hits, "chunks")
    schema = T.StructType([T.StructField(id_col, T.LongType()), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_chunks", "n_shared_chunks", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, hits in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                data = text.encode()
                known = {np.array([h["d1"], h["d2"]], np.int64).tobytes(): h["first"] for h in hits or ()}
                seen: set[bytes] = set()
                runs, n, shared = [], 0, 0
                for start, end, digest in chunks(data):
                    n += 1
                    shared += digest in known
                    if doc is not None and (digest in seen or known.get(digest) is False):
                        if runs and runs[-1][1] == start:
                            runs[-1][1] = end
                        else:
                            runs.append([start, end])
                    seen.add(digest)
                gone = [(a, z) for a, z in runs if z - a >= LEAST or z - a == len(data)]
                kept, at = hashlib.sha256(), 0
                for a, z in [*gone, (len(data), len(data))]:
                    kept.update(data[at:a])
                    at = z
                rows.append((doc, len(data), n, shared, sum(z - a for a, z in gone), len(gone), kept.hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[] for _ in schema.names]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.string())], names=schema.names)

    return texts.join(hits, "id", "left").select("id", "text", "hits").mapInArrow(remove, schema)
