"""Write semantics over immutable tables: upserts, merges and rewrites as DataFrames to be written as new partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _newest(df: DataFrame, keys: list[str], order: Column, largest: bool = True) -> DataFrame:
    """One row per key: the one with the largest (smallest) order. A partial aggregate, so hot keys do not gather."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if largest else F.min_by
    one = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_r"))
    return one.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """old with the rows of new put in or over: of equal keys the largest version wins, new before old on ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = F.struct(version, "_new") if version else F.col("_new")
    return _newest(both, keys, order).drop("_new")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return _newest(both, keys, F.col("_new"), largest=False).drop("_new")


def guarded_upsert(old: DataFrame, new: DataFrame, keys: list[str], source: str = "fuente", guard: str = "persona") -> DataFrame:
    """Upsert that never overwrites what a person decided."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = F.struct(((F.col("_new") == 0) & (F.col(source) == guard)).cast("int"), "_new")
    return _newest(both, keys, order).drop("_new")


def replace_partition(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Deletes all old rows of the keys that new has and puts the new ones in."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def keep_last(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    return _newest(df, keys, F.col(arrival))


def keep_highest(df: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Rows by key with the highest score; rows that relate a thing to itself go."""
    return df.where("a <> b").groupBy(*keys).agg(F.max(score).alias(score))


def merge_timing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Monotone merge: closed stays closed, the order number of a closed row stays, the rest is new."""
    o = old.select(*keys, F.col("cerrado").alias("o_cerrado"), F.col("orden").alias("o_orden"), F.col("segundos").alias("o_segundos"))
    j = o.join(new, keys, "full")
    return j.select(
        *keys,
        F.coalesce("segundos", "o_segundos").alias("segundos"),
        F.greatest(F.coalesce("o_cerrado", F.lit(0)), F.coalesce("cerrado", F.lit(0))).alias("cerrado"),
        F.when(F.col("o_cerrado") == 1, F.col("o_orden")).otherwise(F.coalesce("orden", "o_orden")).alias("orden"),
    )


def invalidate(times: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Marks measurements as not valid without reopening them."""
    hit = ids.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return times.join(hit, keys, "left").withColumn("valido", F.when(F.col("_hit"), F.lit(False)).otherwise(F.col("valido"))).drop("_hit")


def mark_processed(done: DataFrame, ids: DataFrame) -> DataFrame:
    """Processed ids, those that yielded nothing too."""
    return done.select("wp_id").union(ids.select("wp_id")).distinct()


def undo_extraction(proposals: DataFrame, batch: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proposals without those of the ids, and the batch with their extraction mark taken back."""
    hit = ids.select("wp_id").distinct()
    left = proposals.join(hit, "wp_id", "left_anti")
    marked = batch.join(hit.withColumn("_hit", F.lit(True)), "wp_id", "left").withColumn("extraido", F.when(F.col("_hit"), F.lit(False)).otherwise(F.col("extraido"))).drop("_hit")
    return left, marked


def backfill_bridge(census: DataFrame, column: str = "terms") -> DataFrame:
    """(wp_id, taxonomy, term_id) from a map of taxonomy to ids."""
    return census.select("wp_id", F.explode(column).alias("taxonomy", "ids")).select("wp_id", "taxonomy", F.explode("ids").alias("term_id")).distinct()


def append_once(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Append that a replay does not double."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys))


def connect(connections: DataFrame, new: DataFrame) -> DataFrame:
    """connections with the site of `new` put in or over by its origin; the job fails if a site of another origin is there.

    One archive at a time: two would share batches and graph, and which of them is meant could not be told.
    """
    others = connections.join(new.select("resolved_origin").distinct(), "resolved_origin", "left_anti").agg(F.min("resolved_origin").alias("_other"))
    fine = F.when(F.col("_other").isNull(), F.col("resolved_origin")).otherwise(F.raise_error(F.concat(F.lit("another site is connected: "), F.regexp_replace("_other", "^https?://", ""))))
    guarded = new.crossJoin(F.broadcast(others)).withColumn("resolved_origin", fine).drop("_other")
    return upsert(connections, guarded.select(connections.columns), ["resolved_origin"])


def checked_import(proposals: DataFrame, paragraphs: DataFrame, score: float) -> DataFrame:
    """Validated proposals with a constant score; the job fails if a span's text is not what its paragraph has there."""
    there = F.expr("substring(parrafo, ini + 1, fin - ini)")
    joined = proposals.join(paragraphs, ["wp_id", "pi"], "left")
    ok = F.coalesce(there == F.col("texto"), F.lit(False))
    fine = F.when(ok, F.lit(score)).otherwise(F.raise_error(F.lit("a span does not match its paragraph")).cast("double"))
    return joined.withColumn("score", fine).drop("parrafo")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
