"""Approximate nearest neighbours by collision counting over single-projection sorted arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Settings:
    #: Random projections, and in how many of them a vector must fall into the query's window to be verified.
    projections: int = 72
    collisions: int = 52
    #: Half width of the first window in standard deviations of the projections; each round of virtual rehashing widens it.
    width: float = 0.9
    widen: float = 1.2
    #: Rounds end when this share of a block and `spare` times k vectors more have been verified.
    verified: float = 0.25
    spare: int = 8
    #: Rows that are indexed together, about: vectors are dealt to blocks by a hash.
    block_rows: int = 8192
    seed: int = 11


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null or zero and has no null or non-finite component, as array<double> `v`; `row` is the input row."""
    row = F.struct(*(df[c] for c in df.columns)).alias("row")
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(row, F.col(vector).cast("array<double>").alias("v")).where(v.isNotNull() & fine)


class Block:
    """Base vectors of one block with one sorted array of projections for each random direction."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, norm: float, s: Settings):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.x, self.s, self.norm = ids[by_id], x[by_id], s, norm
        d = x.shape[1]
        # Largest inner product as nearest point: one more coordinate lifts all vectors onto a sphere of the largest norm.
        lift = np.sqrt(np.maximum(norm**2 - (self.x**2).sum(axis=1), 0))
        self.directions = np.random.default_rng(s.seed).normal(size=(s.projections, d + 1)) / np.sqrt(d + 1)
        p = (self.x @ self.directions[:, :d].T + lift[:, None] * self.directions[:, d]).T
        order = np.argsort(p, axis=1, kind="stable")
        values = np.take_along_axis(p, order, axis=1)
        self.scale = p.std(axis=1).mean() or 1.0
        self.reach = 2 * float(np.abs(values).max()) + 4 * norm
        # All arrays in one, far enough apart that a single binary search finds its place in each of them.
        self.apart = np.arange(s.projections) * (2 * self.reach + 1)
        self.values = (values + self.apart[:, None]).ravel()
        self.first = np.arange(s.projections) * len(ids)
        # Each row's place in each sorted array, in the narrowest type: unsigned, so that places under a window wrap around.
        self.place = np.empty(order.shape, np.min_scalar_type(len(ids)))
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=self.place.dtype)[None, :], axis=1)
        self.inside, self.hits = np.empty_like(self.place), np.empty(order.shape, bool)
        self.counts = np.min_scalar_type(s.projections)
        self.round = 0

    def _collisions(self, at: np.ndarray, half: float) -> np.ndarray:
        """How many of the windows of this half width each row is in: a window is a stretch of places in a sorted array."""
        n = len(self.ids)
        a = np.zeros(len(at), np.int64) if half > self.reach else np.clip(np.searchsorted(self.values, at - half) - self.first, 0, n)
        b = np.full(len(at), n) if half > self.reach else np.clip(np.searchsorted(self.values, at + half, side="right") - self.first, a, n)
        np.subtract(self.place, a[:, None].astype(self.place.dtype), out=self.inside)
        np.less(self.inside, (b - a)[:, None].astype(self.place.dtype), out=self.hits)
        return self.hits.view(np.uint8).sum(axis=0, dtype=self.counts)

    def candidates(self, q: np.ndarray, k: int) -> np.ndarray:
        """Rows that collide with the query often enough, after widening the windows around it until they are enough.

        Virtual rehashing: the same arrays serve for every wider window, and counts only grow with the windows. The first
        round with enough rows is looked for from the last query's, up or down. When the windows hold all, every row collides.
        """
        s, n = self.s, len(self.ids)
        wanted = min(n, int(s.verified * n) + s.spare * k)
        at = self.directions[:, :-1] @ (q * (self.norm / np.linalg.norm(q))) + self.apart
        halves = [s.width * self.scale]
        while halves[-1] <= self.reach:
            halves.append(halves[-1] * s.widen)
        enough = lambda c: np.count_nonzero(c >= s.collisions) >= wanted
        r = min(self.round, len(halves) - 1)
        count = self._collisions(at, halves[r])
        if enough(count):
            while r and enough(fewer := self._collisions(at, halves[r - 1])):
                r, count = r - 1, fewer
        else:
            while r < len(halves) - 1 and not enough(count):
                r += 1
                count = self._collisions(at, halves[r])
        self.round = r
        # The last round may take in many rows at once: the threshold rises as long as enough of them exceed it.
        return np.flatnonzero(count >= max(s.collisions, np.partition(count, n - wanted)[n - wanted]))

    def search(self, qid: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.candidates(q, k + 1)
        score = exact(self.x[rows], q)
        keep = self.ids[rows] != qid
        rows, score = rows[keep], score[keep]
        if len(rows) > k:
            bound = np.partition(score, len(score) - k)[len(score) - k]
            near = score >= bound
            rows, score = rows[near], score[near]
        top = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[top]], score[top]


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the same order for every row so that equal vectors tie exactly."""
    return np.einsum("ij,j->i", x, q)


def nearest(base: DataFrame, queries: DataFrame, k: int = 20, settings: Settings | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each query its k nearest base rows by inner product: query_id, rank, vec_id, score; a row is never its own neighbour.

    Base rows are dealt by a hash to blocks of about `block_rows`, so results depend on neither the cluster nor the order of
    the table. Every query goes to every block: a task sorts its block's rows first, indexes them, and then lets its queries
    pass in batches. Memory is a block and a batch; no vector goes through the driver, and the work is queries times rows. In
    a block, rows are sorted by each of many random projections. A query
    opens a window around itself in every sorted array and widens them all together; vectors that enter enough
    windows are verified by their exact inner product, without any cap. The blocks' top k of a query then meet in one
    ranking. Score is in double precision on the original vectors; equal scores go to the smaller vec_id. Rows with a null
    key or unusable vector (see usable) take no part; vectors are compared with those of their own dimension. Rows that agree
    in key and vector are one; of several vectors under one key each is a candidate, and as queries they share one ranking.
    An empty table on either side gives no rows; other columns are ignored.
    """
    s = settings or Settings()
    side = lambda df: usable(df, vector).select(F.col("row")[key].cast("long").alias("id"), "v", F.size("v").alias("d")).where("id is not null").distinct()
    base, queries = side(base), side(queries)
    norms = F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    out = base.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for d, n, norm in sorted(base.groupBy("d").agg(F.count("*").alias("n"), norms.alias("norm")).collect()):
        out = out.union(_search(base.where(F.col("d") == d), queries.where(F.col("d") == d), -(-n // s.block_rows), norm, k, s))
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(base: DataFrame, queries: DataFrame, blocks: int, norm: float, k: int, s: Settings) -> DataFrame:
    """Each block's k nearest of each query: query_id, vec_id, score."""
    rows = base.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "id", "v")
    rows = rows.union(queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), F.lit(True), "id", "v"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, vectors, block = None, [], [], None
        for batch in batches:
            for (at, asks), part in batch.groupby(["block", "asks"], sort=True):
                if at != now:
                    now, ids, vectors, block = at, [], [], None
                x = np.stack(part["v"].to_numpy()).astype(float)
                if not asks:
                    ids.append(part["id"].to_numpy())
                    vectors.append(x)
                elif ids:
                    block = block or Block(np.concatenate(ids), np.concatenate(vectors), norm, s)
                    found = [(qid, *block.search(qid, q, k)) for qid, q in zip(part["id"], x)]
                    lengths = [len(f[1]) for f in found]
                    yield pd.DataFrame({"query_id": np.repeat([f[0] for f in found], lengths), "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

    dealt = rows.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asks", "id")
    return dealt.mapInPandas(search, "query_id long, vec_id long, score double")
