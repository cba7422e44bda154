"""Labelled rows for the classifiers: a bounded, repeatable sample, and the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS = 5


def held_out(key: str | Column = "doc_id") -> Column:
    """True for rows whose crc32 of the key as text is divisible by five; labels are learned from the others only.

    A null key counts as the empty text.
    """
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, key: str = "doc_id", text: str = "text", most_bytes: int = 64_000_000) -> DataFrame:
    """At most `most` labelled documents (k, text, y, w) outside the held-out fold, rarer label first served.

    A class gets up to half of the rows and what the other leaves; rows are taken in the order of a hash of the key, so the
    sample is the same however the tables are partitioned; w is how many labelled rows one stands for. A key has one row,
    whatever repeats in either table: the largest of its labels and the text of smallest hash. Together the texts have
    `most_bytes` bytes at most: further rows are left out, none is cut. So the sample is small enough to broadcast and to learn
    from on the driver. Labels other than 0 and 1 and null keys are left out.
    """
    rows = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    rows = rows.where(~held_out("k")).groupBy("k").agg(F.max("y").alias("y"))
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    take = {y: min(n.get(y, 0), max(most // 2, most - n.get(1 - y, 0))) for y in (0, 1)}
    sample = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(take[y]).withColumn("w", F.lit(n.get(y, 0) / max(take[y], 1)))
        sample = part if sample is None else sample.union(part)
    picked = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(sample), "k")
    picked = picked.groupBy("k", "y", "w").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    upto = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("k"), "k"))
    return picked.withColumn("upto", upto).where(F.col("upto") <= most_bytes).drop("upto")
