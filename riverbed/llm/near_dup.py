"""Near-duplicate documents: banded MinHash, odd sketches, exact confirmation.

Each document's word shingles give MinHash samples; bands of samples are the candidate
buckets.  Folded by parity into a short bitmap (an odd sketch), the samples of two
documents differ in as many bits as their XOR has ones, which estimates a high similarity
far better than counting equal samples of that size; only pairs whose estimate is
plausible are confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverbed.llm.common import cut, delete, text_of, words_of
from riverbed.llm.near import bits_apart, near_links, shared_buckets

BANDS, ROWS = 32, 8
SAMPLES = BANDS * ROWS
#: Bits of the odd sketch, and how far below a similarity an estimate may fall.
SKETCH_BITS, SLACK = 512, 0.16

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Distinct words whose hashes a task remembers; beyond it the memory is emptied.
MEMORY = 250_000
_RNG = np.random.Generator(np.random.PCG64(20240601))
_ODD = _RNG.integers(0, 2**63, 4096, dtype=np.uint64) * 2 + 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class ShingleSets:
    """Sorted distinct 64-bit shingle hashes of documents given as word lists."""

    def __init__(self, words: int):
        self.words, self.memory = words, {}

    def of(self, lists: pa.ListArray) -> Iterator[np.ndarray]:
        codes = lists.flatten().dictionary_encode()
        distinct = codes.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.memory) > MEMORY:
            self.memory = {}
        for w in distinct:
            if w not in self.memory:
                self.memory[w] = xxhash.xxh3_64_intdigest(w.translate(_LOWER))
        hashes = np.fromiter((self.memory[w] for w in distinct), np.uint64, len(distinct))[codes.indices.to_numpy()]
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        for end in ends.tolist():
            h = hashes[begin:end]
            begin, n = end, self.words
            if not len(h):
                yield np.zeros(0, np.uint64)
            elif len(h) < n:  # the whole sequence is one shingle, told apart by its length
                yield _mix(np.array([(_mix(h) * _ODD[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64))
            else:
                m = _mix(h)
                yield np.unique(_mix(sum((m[k : len(h) - n + 1 + k] * _ODD[k] for k in range(1, n)), m[: len(h) - n + 1] * _ODD[0])))


def minhash(items: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each of SAMPLES permutations."""
    best = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(items), 1024):
        np.minimum(best, (items[k : k + 1024, None] * _ODD[None, 1000 : 1000 + SAMPLES]).min(axis=0), out=best)
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = _mix(samples).reshape(BANDS, ROWS) * _ODD[2000 : 2000 + ROWS]
    return _mix(rows.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Bit b is the parity of the numbered samples that hash to b."""
    bits = (_mix(samples + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits(np.bincount(bits, minlength=SKETCH_BITS).astype(np.uint8) & 1).view(np.int64)


def plausible(a: Column, b: Column, similarity: float) -> Column:
    """Whether two odd sketches can come from sets of at least this similarity.

    With k samples and n bits, sets of similarity j differ in about
    ``n / 2 * (1 - exp(-4 k (1 - j) / n))`` bits.
    """
    j = max(0.0, similarity - SLACK)
    return bits_apart(a, b) <= SKETCH_BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - j) / SKETCH_BITS))


_SKETCH = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))])


def sketches(flat: DataFrame, words: int) -> DataFrame:
    """``(id, words)`` -> set size, 128-bit key of the set, band keys and odd sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = ShingleSets(words)
        for b in batches:
            n, k1, k2, bands, odd = [], [], [], [], []
            for s in sets.of(b.column("words")):
                n.append(len(s))
                key = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                k1.append(key[0])
                k2.append(key[1])
                if len(s):
                    m = minhash(s)
                    bands.append(band_keys(m).view(np.int64))
                    odd.append(odd_sketch(m))
                else:
                    bands.append(None)
                    odd.append(None)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, pa.int64()) for c in (n, k1, k2)), pa.array(bands, lists), pa.array(odd, lists)], names=_SKETCH.names)

    return flat.mapInArrow(run, _SKETCH)


def shingle_sets(flat: DataFrame, words: int) -> DataFrame:
    """``(id, words)`` -> ``(id, items)``: the full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = ShingleSets(words)
        for b in batches:
            items = [s.view(np.int64) for s in sets.of(b.column("words"))]
            for k in range(0, len(items), 500):
                yield pa.RecordBatch.from_arrays([b.column("id").slice(k, 500), pa.array(items[k : k + 500], pa.list_(pa.int64()))], names=["id", "items"])

    return flat.mapInArrow(run, "id long, items array<long>")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose shingle sets have ``100 * intersection >= percent * union``.

    Returns ``id_col, n_shingles, component_id, kept`` for each input row.  A null or
    wordless text has no shingles and is its own component; so is a row with a null id
    (its component is null and it is kept).  Rows of one id are one document: equal
    repeats get equal rows.  Further columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    with_words = lambda df: df.select("id", words_of(F.col("text")).alias("words"))
    every = cut(sketches(with_words(texts), words), "sketches")
    usable = every.filter("n > 0 and id is not null")
    # equal sets are one node, named by their smallest id
    first = usable.groupBy("k1", "k2").agg(F.min("id").alias("id"))
    nodes = usable.join(first, ["k1", "k2", "id"], "left_semi").select("id", "n", "bands", "sketch").dropDuplicates(["id"])

    def sets_of(ids: DataFrame) -> DataFrame:
        return shingle_sets(with_words(texts.join(ids.hint("merge"), "id", "left_semi")), words).dropDuplicates(["id"])

    links, groups = near_links(shared_buckets(nodes), nodes, sets_of, percent, plausible)
    delete(links)
    named = first.join(groups.select(F.col("node").alias("id"), "component"), "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("component"))
    # a set that stands alone and has one row needs no join; its name is the row's own id
    several = named.join(usable.groupBy("k1", "k2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")), ["k1", "k2"]).filter("lo <> hi or component <> lo").select("k1", "k2", "component")
    out = every.select("id", "n", "k1", "k2").join(several, ["k1", "k2"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("component", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
