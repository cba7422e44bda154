"""The corpus pipeline: STAGES applied to `documents`, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, linededup, minhash, packing, toxicity
from tessera.llm.base import materialize, table
from tessera.llm.queries import tokenizer


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at or over their language's calibrated cut-off go.

    Null and empty texts are judged like any text without known words; repeated rows stay or go together; an empty table
    gives no rows.
    """
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go from the texts; n_chars follows. No document goes, though a text may become empty.

    Null texts stay null (n_chars too), empty ones empty; of repeated rows all but one are later copies; an empty table gives no rows.
    """
    kept = linededup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (5-word shingles, similarity of 0.8 or more) the document with the smallest doc_id stays, once.

    Pairs are proposed by SimHash ball hashing, as in op2, and by MinHash bands where fingerprints differ in more than two bits.
    Null and empty texts are one component; null doc_ids come last; of repeated rows one stays; an empty table gives no rows.
    """
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go.

    Null and empty texts hold none; repeated rows stay or go together; an empty table gives no rows.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, packed into sequences of at most 4096 tokens.

    A null or empty text is its end id alone; repeated rows are packed as often as they occur; an empty table gives no rows.
    """
    return packing.pack(docs, tokenizer())


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontamination),
    ("packing", pack),
]

#: SQL expresses neither the classifier nor the tokenizer; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
