"""Token counts without token ids.

A document is cut into pre-tokens (words between ASCII white space) by the JVM.
Inside each task the pre-tokens of a block of documents are dictionary-encoded, every
distinct pre-token is counted once by the tokenizer, and the counts are joined back to
the documents' pre-token occurrences by dictionary code and summed.  Nothing is
shuffled, so no frequent word or large source can gather in one task, and a lost
executor costs only its own blocks.

The cut is safe for tokenizers that drop white space (no token spans it).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverbed.llm.common import text_of

#: Letters that lower-case to one letter and that normalisation leaves alone.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A comma or full stop after such a letter, at the end of a word, is a piece of its own.
_TAIL = rf"([{_LETTER}])([.,])(?=[ \t\n\x0B\f\r]|\z)"
_PLAIN = re.compile(rf"[!-~{_LETTER}]+")
#: Distinct pre-tokens that a task remembers; beyond it the memory is emptied and refilled.
MEMORY = 400_000


def _counter(tokenizer_file: str):
    """Return ``count(words) -> list[int]`` for a tokenizers file."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file)
    tok.no_truncation()
    tok.no_padding()

    def run(words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        plain = [i for i, w in enumerate(words) if len(w) < 200 and "<|" not in w and _PLAIN.fullmatch(w)]
        rest = sorted(set(range(len(words))) - set(plain))
        for k in range(0, len(plain), 2000):
            ids = plain[k : k + 2000]
            sizes = np.array([len(words[i]) + 1 for i in ids])
            starts = np.cumsum(sizes) - sizes
            offsets = tok.encode(" ".join(words[i] for i in ids), add_special_tokens=False).offsets
            at = np.searchsorted(starts, np.array([o[0] for o in offsets]), side="right") - 1
            out[ids] = np.bincount(at, minlength=len(ids))
        for k in range(0, len(rest), 2000):
            ids = rest[k : k + 2000]
            out[ids] = [len(e) for e in tok.encode_batch([words[i] for i in ids], add_special_tokens=False)]
        return out

    return run


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the tokens of every whole text.

    Returns ``id_col, n_bytes, n_tokens, over_limit`` for each input row.  A null or
    empty text has 0 bytes and 0 tokens.  Repeated rows are counted each; a null id is
    kept; further columns of ``docs`` are ignored; an empty table gives no rows.
    """
    text = text_of(docs, text_col)
    pieces = F.split(F.regexp_replace(text, _TAIL, "$1 $2"), r"[ \t\n\x0B\f\r]+")
    cut = docs.select(docs[id_col].alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), pieces.alias("pieces"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, memory = _counter(tokenizer_file), {"": 0}
        for b in batches:
            lists = b.column("pieces")
            codes = lists.flatten().dictionary_encode()
            distinct = codes.dictionary.to_numpy(zero_copy_only=False).tolist()
            if len(memory) > MEMORY:
                memory = {"": 0}
            new = [w for w in distinct if w not in memory]
            memory.update(zip(new, count(new).tolist(), strict=True))
            sizes = np.fromiter((memory[w] for w in distinct), np.int64, len(distinct))
            total = np.concatenate(([0], np.cumsum(sizes[codes.indices.to_numpy()])))
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
            starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(total[ends] - total[starts])], names=schema.names)

    return cut.mapInArrow(block, schema).withColumn("over_limit", F.col("n_tokens") > limit)
