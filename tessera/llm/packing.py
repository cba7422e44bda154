"""Packing documents into fixed-length token sequences: shortest pack first over the length histogram."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.base import materialize
from tessera.llm.tokens import id_bytes, word_bpe

#: Ranks of equal lengths stay below 2**RANK_BITS.
RANK_BITS = 44


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns (count, lengths) for a histogram {length: count} of lengths up to `size`.

    Lengths are placed longest first, each into the shortest pack that has room (the one with the largest gap), many
    equal packs at a time; where none has room, new packs take as many of that length as they hold. The work and the
    number of patterns depend on the number of distinct lengths, not on the number of documents.
    """
    gaps: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        for gap in range(size, length - 1, -1):
            while n and gaps[gap]:
                count, pack = gaps[gap].pop()
                take = min(count, n)
                if count > take:
                    gaps[gap].append((count - take, pack))
                gaps[gap - length].append((take, (*pack, length)))
                n -= take
            if not n:
                break
        each = size // length
        for count, copies in ((n // each, each), (1 if n % each else 0, n % each)):
            if count:
                gaps[size - copies * length].append((count, (length,) * copies))
    return [x for group in gaps for x in group]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, ...]:
    """Patterns as intervals of ranks: rank r of a length in interval j goes to sequence base[j] + r - first[j], offset[j]."""
    following: dict[int, int] = {}
    rows, sequence = [], 0
    for count, pack in patterns:
        offset = 0
        for length in pack:
            first = following.get(length, 0)
            following[length] = first + count
            rows.append((length << RANK_BITS | first, first, sequence, offset))
            offset += length
        sequence += count
    rows.sort()
    key, first, base, offset = (np.array(x, dtype=np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
    return key, first, base, offset


def pieces(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, text: str = "text", key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Token pieces of every document, numbered within their length by (pid, idx)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, end, pid, seen = word_bpe(tokenizer), id_bytes(end_id), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = []
            for doc, t in zip(batch["doc_id"], batch["text"]):
                raw = bpe.encode(t or "") + end
                total = len(raw) // 4
                for start in range(0, total, size):
                    part = raw[4 * start : 4 * (start + size)]
                    n = len(part) // 4
                    idx = seen[n] = seen.get(n, -1) + 1
                    rows.append((doc, start, n, zlib.crc32(part), total, pid, idx, *([np.frombuffer(part, "<u4").astype(np.int64)] if keep_ids else [])))
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64") if whole else out["doc_id"]
            yield out

    kind = dict(docs.dtypes)[key]
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, pid long, idx long" + ", ids array<long>" * keep_ids
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInPandas(cut, schema)


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, text: str = "text", key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most `size` tokens.

    A document is its ids and then `end_id`; a null or empty text is that one id. Documents longer than a sequence are cut
    into whole sequences and a rest. The histogram of piece lengths (at most `size` rows) goes to the driver, which plans
    the patterns; pieces find their pattern slot by their rank among pieces of equal length, which is a per-partition
    number plus an offset, so neither a very common length nor a very long document gathers anywhere.
    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and `ids` (array<long>)
    if keep_ids. Repeated rows and keys are packed as often as they occur; a null key stays null; an empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, size, end_id, text, key, keep_ids))
    counts = cut.groupBy("pid", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(slots(shortest_pack_first(histogram, size)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at, first, base, offset = plan.value
        r = rank.to_numpy()
        j = np.searchsorted(at, length.to_numpy() << RANK_BITS | r, side="right") - 1
        return pd.DataFrame({"sequence_id": base[j] + r - first[j], "offset": offset[j]})

    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pid", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(offsets, ["pid", "length"]).withColumn("_s", place("length", F.col("before") + F.col("idx")))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return ranked.select(*columns, "_s.sequence_id", "_s.offset", *(["ids"] if keep_ids else []))


def assemble(packed: DataFrame) -> DataFrame:
    """Training sequences of a pack(keep_ids=True) result: input_ids, and for each token its document's number in the sequence.

    A sequence has at most `size` tokens, which bounds every group. Repeated documents stand as often as they were packed, a null
    or empty text is its end id alone; an empty table gives no rows; other columns are ignored.
    """
    grouped = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    return grouped.select(
        "sequence_id",
        F.flatten(F.transform("p", lambda x: x["ids"])).alias("input_ids"),
        F.flatten(F.transform("p", lambda x, i: F.array_repeat(i, x["length"].cast("int")))).alias("document_index"),
    )
