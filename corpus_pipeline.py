"""The corpus pipeline: quality filter, line removal, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next one's docs. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import decontaminate, line_dedup, minhash, packing, quality, store
from tidemark.llm.queries import table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, machine).select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many of a source's documents share go; n_chars follows the text."""
    out = line_dedup.drop_boilerplate(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays."""
    return minhash.keep_one(docs, k=5, percent=80).select(COLUMNS)


def decontaminate_docs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"), least_item=decontaminate.LEAST_ITEM).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens packed into sequences of 1024."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", drop_lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate_docs),
    ("packing", pack_sequences),
]

#: A factorisation machine, MinHash groups and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
