"""Passages of a given number of words that also stand in another document, wherever lines break."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import DOC, drop_scratch, materialize

#: Words that choose the anchors, and how many bytes of text are looked at in one go.
GRAM, PIECE = 6, 1 << 17
_LOW = np.uint64((1 << 24) - 1)
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_BYTES = np.random.default_rng(42).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, 2**bits of each."""
    out = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(1 << bits, x, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _pieces(raws: list[bytes], words: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text, offset, bytes) of about PIECE bytes. Longer texts are cut between words, with words - 1 words twice."""
    now, room = [], PIECE
    for i, raw in enumerate(raws):
        base, size = 0, PIECE
        while len(raw) - base > size:
            cut = _GAP.search(raw, base + size)
            part = raw[base : cut.start() if cut else len(raw)]
            solid = ~_SPACE[np.frombuffer(part, np.uint8)]
            starts = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
            if len(starts) < words:
                size *= 2
                continue
            yield [(i, base, part)]
            base, size = base + int(starts[1 - words]), PIECE
        now.append((i, base, raw[base:]))
        room -= len(raw) - base
        if room <= 0:
            yield now
            now, room = [], PIECE
    if now:
        yield now


def hashed(raws: list[bytes], words: int) -> Iterator[tuple]:
    """For each piece: the text and the first word of each window of `words` words, start and end of all words in their
    texts, and a function that hashes the words from a to z of the piece."""
    for parts in _pieces(raws, words):
        buf = np.frombuffer(b"\n".join([*(x for _, _, x in parts), b""]), np.uint8)
        power, inverse = _powers(max(18, len(buf).bit_length()))
        edge = np.diff(_SPACE[buf].astype(np.int8), prepend=1)
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        m = len(start)
        if m < words:
            continue
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[buf] * power[: len(buf)], dtype=np.uint64)])
        word = _mix((sums[end] - sums[start]) * inverse[start])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * power[:m], dtype=np.uint64)])
        length = np.array([len(x) + 1 for _, _, x in parts])
        begins = np.cumsum(length) - length
        part = np.searchsorted(begins, start, side="right") - 1
        first = np.flatnonzero(part[: m - words + 1] == part[words - 1 :])
        if len(first):
            shift = np.array([b for _, b, _ in parts]) - begins
            owner = np.array([i for i, _, _ in parts])

            def between(a: np.ndarray, z: np.ndarray, sums=sums, inverse=inverse) -> np.ndarray:
                return _mix((sums[z] - sums[a]) * inverse[a])

            yield owner[part[first]], first, start + shift[part], end + shift[part], between


def word_runs(raws: list[bytes], words: int) -> pd.DataFrame:
    """Runs of windows of `words` words that share an anchor: text i, bytes p and len, anchor h, hash c of the run's words.

    A window's anchor is its leftmost string of `GRAM` words of least hash, so equal windows have equal anchors at equal
    offsets (see substrings.anchors). Every window is in exactly one run.
    """
    out = []
    for owner, first, start, end, between in hashed(raws, words):
        m = len(start) - GRAM + 1
        gram = between(np.arange(m), np.arange(GRAM, GRAM + m))
        key = (gram & ~_LOW) | np.arange(m, dtype=np.uint64)
        width, have = words - GRAM + 1, 1
        while 2 * have <= width:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        if have < width:
            key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
        at = (key[first] & _LOW).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        a, z = first[new], first[np.append(new[1:], len(first)) - 1] + words
        c = between(a, z) ^ _mix((z - a).astype(np.uint64))
        out.append((owner[new], start[a], end[z - 1] - start[a], gram[at[new]].view(np.int64), c.view(np.int64)))
    columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
    return pd.DataFrame(dict(zip(("i", "p", "len", "h", "c"), columns)))


def candidates(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """(documents that share a whole run of windows with another one, runs _k1, _k2, p, len, h that need a look at each window).

    Both are scratch tables; docs is what keyed() returns. Only anchors that stand in several documents go on. A document
    that shares a whole run is settled; the runs of all others go on, with one of each kind of run around the same anchors.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in (batch.iloc[at : at + 500] for batch in batches for at in range(0, len(batch), 500)):
            found = word_runs([(t or "").encode("utf-8", "replace") for t in rows["text"]], words)
            yield found.assign(_k1=rows["_k1"].to_numpy()[found["i"]], _k2=rows["_k2"].to_numpy()[found["i"]])[[*DOC, "p", "len", "h", "c"]].astype("int64")

    every = materialize(docs.select(*DOC, "text").mapInPandas(scan, "_k1 long, _k2 long, p long, len long, h long, c long"))
    low_high = (F.min("_k1").alias("low"), F.max("_k1").alias("high"))
    common = materialize(every.groupBy("h").agg(*low_high).where("low < high").select("h"))
    left = materialize(every.join(common, "h"))
    contents = materialize(left.groupBy("h", "c").agg(*low_high, F.min(F.struct(*DOC, "p", "len")).alias("at")))
    settled = materialize(left.join(contents.where("low < high").select("h", "c"), ["h", "c"]).select(*DOC).distinct())
    # All runs of an unsettled document are its own; of equal runs of others one is enough to find them by.
    alone = contents.where("low = high").select("at.*", "h").join(settled, DOC, "left_anti")
    unsettled = alone.select("h").distinct()
    open_runs = materialize(contents.join(unsettled, "h").select("at.*", "h"))
    for t in (every, common, left, contents):
        drop_scratch(t)
    return settled, open_runs


def sharing(slices: DataFrame, words: int) -> DataFrame:
    """Documents (_k1, _k2) that have a window of `words` words in common with another one, of runs `raw` around anchors h."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = batch[[*DOC, "h"]].to_numpy()
            for owner, first, _, _, between in hashed(batch["raw"].tolist(), words):
                yield pd.DataFrame(names[owner], columns=[*DOC, "h"]).assign(v=between(first, first + words).view(np.int64))

    every = slices.select(*DOC, "h", "raw").mapInPandas(windows, "_k1 long, _k2 long, h long, v long")
    several = every.groupBy("h", "v").agg(F.min("_k1").alias("low"), F.max("_k1").alias("high")).where("low < high").select("h", "v")
    return every.join(several, ["h", "v"]).select(*DOC).distinct()
