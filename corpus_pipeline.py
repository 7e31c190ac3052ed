"""The corpus pipeline: filter, clean, deduplicate, decontaminate and pack documents.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept;
all but the last return the columns of ``documents``, further columns included, whatever
their names.  An empty table gives an empty table.  A null text is an empty text: the
quality rules reject it; the stages behind them, called by themselves, keep it.  Rows with a
null id are judged by the quality rules like any other, have no copies, hold no items and
are packed.  Repeated rows are judged each; those of one id are one document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riverbed.llm.common import cut, table
from riverbed.llm.decontaminate import contaminated
from riverbed.llm.line_dedup import clean_lines
from riverbed.llm.near_dup import near_duplicates
from riverbed.llm.packing import pack_documents
from riverbed.llm.quality_rules import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules or read unlike the trusted ones go."""
    return keep_good(docs, table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of equal or near lines stays; documents left without a word go."""
    return clean_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (a similarity of 0.8, five words a shingle) stays."""
    gone = near_duplicates(docs, percent=80).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    gone = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the documents that are left."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: No SQL: MinHash components, CGK search and tokenization are beyond it; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
