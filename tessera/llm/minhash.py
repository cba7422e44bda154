"""Near duplicates by SimHash balls and MinHash bands, every candidate verified by the exact Jaccard similarity of its shingles."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.base import DOC, connected_components, drop_scratch, keep_rows, keyed, materialize, twins

#: Two texts of similarity s share a band with probability 1 - (1 - s**ROWS)**BANDS: 0.9998 at 0.8.
BANDS, ROWS = 16, 4
_DRAWN = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_XOR, _TIMES = _DRAWN[0], _DRAWN[1] * np.uint64(2) + np.uint64(1)

#: Rounds of comparing with one member of a band at most, and pairs for each row of a band that are few enough to compare all.
MOST_ROUNDS, FEW = 3, 4
#: 64-bit words of the bitmap in which a set marks a place for each of its shingles.
WORDS = 16


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 values of all runs of n words; words as in simhash.simhash64, a text of fewer is one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    grams = map(b" ".join, zip(*(words[i:] for i in range(n)))) if len(words) > n else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64))


def bands(h: np.ndarray) -> list[int]:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(h), 1024):
        np.minimum(least, ((h[i : i + 1024, None] ^ _XOR) * _TIMES).min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def bitmap(h: np.ndarray) -> np.ndarray:
    """Bits at the places of the shingles. Each place that one set marks and another does not holds a shingle the other lacks."""
    marks = np.zeros(64 * WORDS, np.uint8)
    marks[(h >> np.uint64(20)) % np.uint64(64 * WORDS)] = 1
    return np.packbits(marks, bitorder="little").view(np.int64)


def _signature(text: str, n: int):
    @F.pandas_udf("node long, n int, fp long, bands array<long>, bits array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        # One set at a time: those of a whole batch would add to an executor's memory.
        rows = [(xxhash.xxh64_intdigest(h.tobytes(), 1), len(h), bands(h), bitmap(h), simhash.majority(h)) for h in (shingles(t, n) for t in texts)]
        node = np.array([x[0] for x in rows], np.uint64).view(np.int64)
        return pd.DataFrame({"node": node, "n": np.array([x[1] for x in rows], np.int32), "fp": np.array([x[4] for x in rows], np.int64), "bands": [x[2] for x in rows], "bits": [x[3] for x in rows]})

    return of(F.col(text))


def _set(text: str, n: int):
    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, n).view(np.int64) for t in texts], dtype=object)

    return of(F.col(text))


def _possible(threshold: float):
    """Whether two sets (n, bits and m, marks) can be similar enough: an exact bound, so no pair that is gets lost.

    A set has at least as many shingles that the other lacks as it has places marked that the other has not.
    """
    lacks = sum((F.bit_count(F.col("bits")[i].bitwiseAND(F.bitwise_not(F.col("marks")[i]))) for i in range(WORDS)), F.lit(0))
    near = F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-6
    return near & (F.col("n") - lacks >= threshold / (1 + threshold) * (F.col("n") + F.col("m")) - 1e-6)


def _members(prints: DataFrame) -> DataFrame:
    """(band, node, n, bits) of the nodes that are to be compared: nodes that share a SimHash ball or a MinHash band.

    A ball is a fingerprint or a variant of several (see simhash.balls): nodes whose fingerprints differ in two bits at most are
    in one. Sets at 0.8 mostly differ in more, and those meet in bands.
    """
    nodes = prints.dropDuplicates(["node"]).select("node", "n", "bits", "fp", "bands")
    banded = nodes.select("node", "n", "bits", F.explode("bands").alias("band"))
    near = simhash.balls(nodes.select("fp").distinct()).select(F.xxhash64(F.lit(2), "members").alias("band"), F.explode("members").alias("fp"))
    balls = nodes.join(near, "fp").select("node", "n", "bits", "band").union(nodes.select("node", "n", "bits", F.xxhash64(F.lit(1), "fp")))
    every = banded.union(balls)
    shared = every.groupBy("band").agg(F.count("*").alias("k")).where("k > 1").select("band")
    return materialize(every.join(shared, "band").select("band", "node", "n", "bits"))


def _components(docs: DataFrame, prints: DataFrame, threshold: float, n: int) -> DataFrame:
    """(node, root) of every node that is linked: nodes are distinct shingle sets, linked at `threshold` or more.

    Balls are treated like bands. A band's members are compared with one of them first, which links large groups in a step for each member. While many
    members are outside a band's largest component, they are compared with another member of it. Then every pair of a band in
    different components is compared: one end of it is outside the band's largest component, so the work is members times
    outsiders. Bitmaps tell most pairs under the threshold apart before sets are fetched. No pair is left out.
    """
    members = _members(prints)
    rows = members.count()
    of = prints.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct(*DOC)).alias("d")).select("node", "d.*")
    sets = materialize(docs.join(of, DOC).select("node", _set("text", n).alias("x")).dropDuplicates(["node"]))
    possible = _possible(threshold)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select("u", "v").distinct()
        pairs = pairs.join(sets.select(F.col("node").alias("v"), F.col("x").alias("y")), "v").join(sets.withColumnRenamed("node", "u"), "u")
        same = pairs.select("u", "v", F.size(F.array_intersect("x", "y")).alias("k"), (F.size("x") + F.size("y")).alias("both"))
        return materialize(same.where(F.col("k") / (F.col("both") - F.col("k")) >= threshold).select("u", "v"))

    def merged(roots: DataFrame, more: DataFrame) -> DataFrame:
        """roots after new links: only components, not nodes, are joined anew."""
        known = lambda c: more.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").select(F.col("u"), F.col("v"), F.coalesce(f"r{c}", c).alias(f"r{c}"))
        ends = known("u").join(known("v"), ["u", "v"]).select(F.col("ru").alias("u"), F.col("rv").alias("v"))
        joined = materialize(connected_components(ends))
        moved = roots.join(joined.withColumnRenamed("root", "to").withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        new = materialize(moved.union(joined.join(roots, "node", "left_anti").select("node", "root")))
        drop_scratch(joined)
        drop_scratch(roots)
        return new

    side = lambda df, node, count, bits: df.select("band", F.col("node").alias(node), F.col("n").alias(count), F.col("bits").alias(bits))
    first = members.groupBy("band").agg(F.min(F.struct("node", "n", "bits")).alias("x")).select("band", "x.*")
    edges = verified(side(members, "u", "n", "bits").join(side(first, "v", "m", "marks"), "band").where((F.col("u") != F.col("v")) & possible))
    roots = materialize(connected_components(edges))
    scratch = [members, sets, edges]
    for turn in range(MOST_ROUNDS):
        placed = members.join(roots, "node", "left").select("band", "node", "n", "bits", F.coalesce("root", "node").alias("c"))
        parts = placed.groupBy("band", "c").agg(F.count("*").alias("k"))
        large = parts.groupBy("band").agg(F.count("*").alias("parts"), F.sum("k").alias("all"), F.max(F.struct("k", "c")).alias("x")).where("parts > 1")
        large = materialize(large.select("band", F.col("x.c").alias("most"), (F.col("all") * (F.col("all") - F.col("x.k"))).alias("work")))
        work = large.agg(F.sum("work")).first()[0] or 0
        scratch.append(large)
        if not work:
            break
        near = materialize(placed.join(large.select("band", "most"), "band"))
        scratch.append(near)
        out = near.where("c != most")
        last = work <= FEW * rows or turn == MOST_ROUNDS - 1
        if last:
            pairs = near.select("band", F.col("node").alias("u"), "n", "bits", "c").join(out.select("band", F.col("node").alias("v"), F.col("n").alias("m"), F.col("bits").alias("marks"), F.col("c").alias("d")), "band")
            pairs = pairs.where((F.col("c") != F.col("d")) & possible).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        else:
            one = near.where("c = most").groupBy("band").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "n", "bits")).alias("x")).select("band", "x.node", "x.n", "x.bits")
            pairs = side(out, "u", "n", "bits").join(side(one, "v", "m", "marks"), "band").where(possible)
        more = verified(pairs)
        scratch.append(more)
        if not more.isEmpty():
            roots = merged(roots, more)
        if last:
            break
    for t in scratch:
        drop_scratch(t)
    return roots


def keep_one(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs, all columns, with one document of each component of near duplicates: the one of smallest key.

    Documents link if the Jaccard similarity of their sets of `shingle` words is `threshold` or more. Balls of SimHash
    fingerprints and bands only propose pairs (see BANDS for how surely), so no pair under the threshold links. Texts without words (null, empty) have equal sets. Null keys
    come last; of rows with that key the one of smallest text hash stays, and of rows that agree in key and text one. An empty
    table gives no rows; columns of any other name pass through.
    """
    source = keyed(docs, text, key)
    prints = materialize(source.select(F.col("key").alias("id"), *DOC, _signature("text", shingle).alias("s")).select("id", *DOC, "s.*"))
    roots = _components(source, prints, threshold, shingle)
    best = prints.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", *DOC)).alias("x"))
    first = best.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("x").alias("x"))
    stays, several = materialize(first.select("x._k1", "x._k2")), twins(prints)
    drop_scratch(prints)
    drop_scratch(roots)
    return keep_rows(docs, text, key, stays, several)
