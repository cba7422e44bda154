"""Compression of vectors into codes: one integer codebook for each part, trained by rounds of exact partial-distance search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import free_name

#: Components become floor(SCALE * x). Beyond LARGEST, sums of squared differences would leave 64 bits.
SCALE, LARGEST = 1024, 1 << 28
#: Vectors that are searched at a time, which bounds the table of accumulated distances.
TOGETHER = 1024


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the nearest entry of `book` and its squared distance, both exact: ties go to the lower index.

    Dimensions are taken in descending variance of the codebook, in which entries differ most. Each row keeps the distance
    of the best entry that was measured completely, and its other entries accumulate one dimension after another: an entry
    is dropped once what it has accumulated is strictly more. The best entry is looked for again, among those that are left,
    each time the dimensions done have doubled.
    """
    order = np.argsort(-book.astype(float).var(axis=0), kind="stable")
    book = np.ascontiguousarray(book[:, order])
    index, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for at in range(0, len(x), TOGETHER):
        part = np.ascontiguousarray(x[at : at + TOGETHER][:, order])
        index[at : at + TOGETHER], distance[at : at + TOGETHER] = _search(part, book)
    return index, distance


def _search(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m, dims = x.shape
    entries = len(book)
    first = min(2, dims)
    total = sum((x[:, k, None] - book[None, :, k]) ** 2 for k in range(first))
    guess = total.argmin(axis=1)
    best = ((x - book[guess]) ** 2).sum(axis=1)
    left = np.flatnonzero((total <= best[:, None]).ravel())
    total, row, entry = total.ravel()[left], left // entries, left % entries
    again = 2 * first
    for k in range(first, dims):
        total += (x[row, k] - book[entry, k]) ** 2
        keep = total <= best[row]
        if k + 1 == again and k + 1 < dims:
            again *= 2
            heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            low = np.minimum.reduceat(total, heads)
            # The first entry of a row that has accumulated least is measured completely.
            least = np.flatnonzero(total == np.repeat(low, np.diff(np.r_[heads, len(row)])))
            least = least[np.r_[True, row[least][1:] != row[least][:-1]]]
            best[row[least]] = np.minimum(best[row[least]], ((x[row[least]] - book[entry[least]]) ** 2).sum(axis=1))
            keep = total <= best[row]
        total, row, entry = total[keep], row[keep], entry[keep]
    # Rows come in order, entries in order within a row: the first one at the row's least distance has the lower index.
    heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    low = np.minimum.reduceat(total, heads)
    least = np.flatnonzero(total == np.repeat(low, np.diff(np.r_[heads, len(row)])))
    least = least[np.r_[True, row[least][1:] != row[least][:-1]]]
    return entry[least], total[least]


def _whole(vectors: pd.Series) -> np.ndarray:
    scaled = np.floor(np.stack(vectors.to_numpy()).astype(float) * SCALE)
    if len(scaled) and np.abs(scaled).max() >= LARGEST:
        raise ArithmeticError(f"a component of {np.abs(scaled).max() / SCALE:g} is too large for exact 64-bit distances")
    return scaled.astype(np.int64)


def usable(vectors: DataFrame, vector: str, parts: int) -> DataFrame:
    """`row` and array<double> `v` of the rows whose vector has no null or non-finite component and can be cut into parts."""
    rows = vectors.select(F.struct(*(vectors[c] for c in vectors.columns)).alias("row"), vectors[vector].cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("v").isNotNull() & fine & (F.size("v") > 0) & (F.size("v") % parts == 0))


def first_books(rows: DataFrame, parts: int, entries: int, key: str) -> np.ndarray:
    """(part, entry, position): the parts of the vectors with the smallest keys. Of several vectors of one key the smallest counts."""
    named = rows.where(F.col("row")[key].isNotNull()).select(F.col("row")[key].alias("id"), "v")
    # Keys alone are shuffled; the vectors of the few that start are then looked up.
    first = named.select("id").distinct().orderBy("id").limit(entries)
    start = named.join(F.broadcast(first), "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"))
    found = [r["v"] for r in start.orderBy("id").collect()]
    if not found:
        return np.zeros((parts, 0, 0), np.int64)
    whole = _whole(pd.Series([np.array(v) for v in found]))
    return whole.reshape(len(whole), parts, -1).transpose(1, 0, 2)


def improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every part goes to its nearest entry, each entry becomes the componentwise floor of its parts' mean.

    A task adds up its own parts for each entry, so at most parts * entries short rows leave it, and as many reach the driver.
    """
    parts, entries, width = books.shape
    held = rows.sparkSession.sparkContext.broadcast(books)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if len(batch):
                x = _whole(batch["v"]).reshape(len(batch), parts, width)
                for p in range(parts):
                    index, _ = nearest_entries(x[:, p], held.value[p])
                    np.add.at(sums[p], index, x[:, p])
                    count[p] += np.bincount(index, minlength=entries)
        p, e = np.nonzero(count)
        if len(p):
            yield pd.DataFrame({"p": p, "e": e, "n": count[p, e], "s": list(sums[p, e])})

    per_task = rows.select("v").mapInPandas(add_up, "p int, e int, n long, s array<long>")
    totals = per_task.groupBy("p", "e").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)))
    books = books.copy()
    for r in totals.collect():
        books[r["p"], r["e"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    held.destroy()
    return books


def train(rows: DataFrame, parts: int, entries: int, rounds: int, key: str) -> np.ndarray:
    books = first_books(rows, parts, entries, key)
    for _ in range(rounds if books.size else 0):
        books = improved(rows, books)
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The input's columns, and `codes`: struct of code (two hex digits for each part), error, dimension and codebooks_sha256.

    Components become integers floor(1024 * x), and vectors are cut into `parts` equal consecutive parts. Each part's
    codebook (at most 256 entries) starts with the vectors of the smallest keys and is improved in `rounds` rounds over all
    vectors. Vectors of different dimensions have codebooks of their own; a pass over the table for each round and
    dimension, nothing is shuffled but sums by entry. The driver holds codebooks alone, whose size is fixed by the parameters.
    Error is the sum of the squared distances of all parts to their entries; equal distances go to the lower index.

    Rows with a null vector or a null or non-finite component, and vectors that cannot be cut into equal parts, are left
    out. Rows with a null key are coded and improve the codebooks, but start none; repeated rows count as often as they
    occur, but start one entry together. An empty table, or one of null keys alone, gives no rows. Components of 2**18 and
    more are an error. If the input has a column `codes`, the new one is `_codes`.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number has two hex digits")
    spark = vectors.sparkSession
    rows = usable(vectors, vector, parts)
    name = free_name("codes", vectors.columns)
    out = None
    for d in sorted(r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect()):
        some = rows.where(F.size("v") == d)
        books = train(some, parts, entries, rounds, key)
        if books.size:
            coded = _coded(some, books).select("row.*", F.struct("_c.code", "_c.error", F.lit(d).alias("dimension"), F.lit(books_digest(books)).alias("codebooks_sha256")).alias(name))
            out = coded if out is None else out.union(coded)
    if out is None:
        return vectors.limit(0).withColumn(name, F.lit(None).cast("struct<code:string,error:bigint,dimension:int,codebooks_sha256:string>"))
    return out


def _coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    parts, _, width = books.shape
    held = rows.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf("code string, error long")
    def code(vectors: pd.Series) -> pd.DataFrame:
        x = _whole(vectors).reshape(len(vectors), parts, width) if len(vectors) else np.zeros((0, parts, width), np.int64)
        found = [nearest_entries(x[:, p], held.value[p]) for p in range(parts)]
        codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
        return pd.DataFrame({"code": [c.tobytes().hex() for c in codes], "error": sum(f[1] for f in found)})

    return rows.select("row", code("v").alias("_c"))


def with_label_error(coded: DataFrame, label: str = "label", codes: str = "codes") -> DataFrame:
    """encode()'s rows and label_error, the errors summed over equal labels (null ones together).

    Labels are added up before the shuffle, so a label with very many rows is one short row for each task; each total then
    meets its rows in many tasks, dealt by the row's code.
    """
    spread = 64
    label_error = free_name("label_error", coded.columns)
    totals = coded.groupBy(F.col(label).alias("_l")).agg(F.sum(F.col(codes)["error"]).alias("_e"))
    totals = totals.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    rows = coded.withColumn("_d", F.pmod(F.xxhash64(F.col(codes)["code"]), F.lit(spread)).cast("int"))
    joined = rows.join(totals, rows[label].eqNullSafe(totals["_l"]) & (rows["_d"] == totals["_s"]))
    return joined.select(*(rows[c] for c in coded.columns), totals["_e"].alias(label_error))
