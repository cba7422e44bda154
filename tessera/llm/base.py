"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.scratch import drop_scratch, materialize, scratch_dir

__all__ = ["DOC", "connected_components", "drop_scratch", "free_name", "keep_rows", "keyed", "materialize", "one_of_a_kind", "rows_of", "scratch_dir", "table", "twins"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns that name a document, see keyed().
DOC = ["_k1", "_k2"]


def _names(docs: DataFrame, text: str, key: str) -> list:
    parts = [docs[key].isNull(), docs[key].cast("string"), docs[text]]
    return [F.xxhash64(F.lit(i), *parts).alias(c) for i, c in enumerate(DOC, 1)]


def keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(key, text) of docs with two 64-bit hashes that name a document: rows that agree in both are one document."""
    return docs.select(docs[key].alias("key"), docs[text].alias("text"), *_names(docs, text, key))


def rows_of(docs: DataFrame, text: str, key: str) -> DataFrame:
    """docs as one column `row`, whose names inside clash with no other, and the document's name (see keyed)."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *_names(docs, text, key))


def twins(named: DataFrame) -> DataFrame:
    """A scratch table of the documents that several rows of keyed() or rows_of() name."""
    return materialize(named.groupBy(*DOC).agg(F.count("*").alias("m")).where("m > 1").select(*DOC))


def keep_rows(docs: DataFrame, text: str, key: str, stays: DataFrame, several: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose document is in `stays`; of those in `several` (see twins) one row."""
    named = rows_of(docs, text, key)
    one = named.join(stays.join(several, DOC, "left_anti"), DOC, "left_semi")
    return one.union(named.join(stays.join(several, DOC), DOC, "left_semi").dropDuplicates(DOC)).select("row.*")


def free_name(name: str, taken: list[str]) -> str:
    """`name`, with underscores put before it until no column has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


_HELD: dict[tuple, Any] = {}


def one_of_a_kind(key: tuple, build: Callable[[], Any]) -> Any:
    """A large object of this Python worker, built on first use and let go when a worker needs another one.

    Spark hands its Python workers from stage to stage: what each of them kept for itself would add up in an executor.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]
