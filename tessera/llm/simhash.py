"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.base import DOC, connected_components, keep_rows, keyed, materialize, twins

SEED = 42


def simhash64(text: str | None, shingle: int) -> int:
    """Fingerprint of a text as a signed 64-bit integer (see `near_duplicates`)."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        grams, n = [b" ".join(words)], 1
    else:
        grams, n = map(b" ".join, zip(*(words[i:] for i in range(shingle)))), len(words) - shingle + 1
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64, count=n))


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprint(text: str = "text", shingle: int = 3):
    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash64(t, shingle) for t in texts], dtype="int64")

    return of(F.col(text))


def ball_masks(radius: int) -> list[int]:
    """All 64-bit masks (signed) with at most `radius` bits set."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def balls(fingerprints: DataFrame, radius: int = 2) -> DataFrame:
    """Arrays `members` of distinct fingerprints (column fp) that share a variant: any two within the radius are together in one.

    Every fingerprint emits all its variants within half the radius (65 of them at radius 2); two fingerprints within an
    even radius share a variant. Variants are shuffled and their members gathered; each variant can have only as many
    members as the ball has points, since fingerprints are distinct, so no group is large whatever the data hold.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = ball_masks(radius // 2)
    # Dealt out before each becomes so many variants: a few small partitions would make them all in a few tasks.
    fingerprints = fingerprints.repartition(int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    if len(masks) <= 65:
        # A member of a variant is the variant with at most one bit flipped: its members fit into a bit mask and a flag.
        bits = F.array(*[F.lit(i).cast("tinyint") for i in range(-1, 64)])
        v = fingerprints.select("fp", F.explode(bits).alias("i")).select(
            F.expr("case when i < 0 then fp else fp ^ shiftleft(1L, i) end").alias("variant"), "i"
        )
        v = v.repartition("variant").groupBy("variant").agg(
            F.expr("bit_or(case when i < 0 then 0L else shiftleft(1L, i) end)").alias("mask"), F.max(F.col("i") < 0).alias("own")
        )
        return v.where("bit_count(mask) + int(own) > 1").select(
            F.expr("concat(if(own, array(variant), array()), transform(filter(sequence(0, 63), i -> (shiftrightunsigned(mask, i) & 1) = 1), i -> variant ^ shiftleft(1L, i)))").alias("members")
        )
    ball = F.array(*[F.lit(m) for m in masks])
    v = fingerprints.select("fp", F.explode(ball).alias("mask")).select("fp", F.expr("fp ^ mask").alias("variant"))
    return v.groupBy("variant").agg(F.collect_list("fp").alias("members")).where("size(members) > 1").select("members")


def links(fingerprints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that connect all pairs at `radius` or fewer differing bits.

    Members of a variant (see balls) are linked to its smallest one: any two are within the radius, as the distance check
    confirms, and the links between the others follow from theirs.
    """
    v = balls(fingerprints, radius)
    pairs = v.select(F.array_min("members").alias("v"), F.explode("members").alias("u")).where("u != v").distinct()
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprint and near-duplicate component of every document.

    A-Z are lower-cased, words are runs of non-white-space (ASCII), shingles are `shingle` words with repeats; a text of
    fewer words is one shingle, one without words (null, empty) has fingerprint zero. Bit i is set if more than half of
    the shingles' XXH64 values (seed 42) have it. Documents link at `radius` or fewer differing bits; component_id is the
    smallest key in the component. Returns one row per input row: key, _fp (long), fingerprint (hex), component_id.
    Rows with a null key keep their fingerprint and count for links; component_id is null only if all keys there are.
    An empty table gives no rows; other columns of `docs` are ignored, so their names cannot clash.
    """
    prints = materialize(docs.select(F.col(key).alias("doc_id"), fingerprint(text, shingle).alias("fp")))
    return prints.join(_components(prints, radius), "fp").select(
        F.col("doc_id").alias(key), F.col("fp").alias("_fp"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def _components(prints: DataFrame, radius: int) -> DataFrame:
    """For each fingerprint its component: fp, root (smallest fingerprint there) and component (smallest doc_id there)."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    labels = connected_components(links(prints.select("fp").distinct(), radius))
    linked = labels.join(nodes, labels["node"] == nodes["fp"]).select("fp", "root", "rep")
    least = linked.groupBy("root").agg(F.min("rep").alias("component"))
    linked = linked.join(least, "root").select(F.col("fp").alias("node"), "root", "component")
    alone = F.col("node").isNull()
    return nodes.join(linked, nodes["fp"] == linked["node"], "left").select(
        "fp", F.when(alone, F.col("fp")).otherwise(F.col("root")).alias("root"), F.when(alone, F.col("rep")).otherwise(F.col("component")).alias("component")
    )


def keep_one(docs: DataFrame, radius: int = 2, shingle: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs, all columns, with one document of each near-duplicate component (see near_duplicates): the one of smallest key.

    Null keys come last; of rows with that key the one of smallest text hash stays, and of rows that agree in key and text one.
    An empty table gives no rows; columns of any other name pass through.
    """
    source = keyed(docs, text, key)
    prints = materialize(source.select(F.col("key").alias("doc_id"), *DOC, fingerprint("text", shingle).alias("fp")))
    best = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *DOC)).alias("x"))
    first = best.join(_components(prints.select("doc_id", "fp"), radius), "fp").groupBy("root").agg(F.min("x").alias("x"))
    return keep_rows(docs, text, key, materialize(first.select("x._k1", "x._k2")), twins(prints))
