"""Exact substring deduplication with suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import passages
from tessera.llm.base import DOC, drop_scratch, keyed, materialize

#: Bytes that choose the anchors, and how many bytes of a text are looked at in one go.
GRAM, SEGMENT = 32, 1 << 23
#: Longest shard of suffixes, in bytes, and most texts around one anchor that may share a shard.
SHARD_BYTES, MOST_TOGETHER = 4_000_000, 1500
_LOW = np.uint64((1 << 24) - 1)


def anchors(raw: bytes, size: int) -> list[tuple[int, int, int, int]]:
    """(first, windows, offset, hash) of the runs of `size`-byte windows that share an anchor.

    A window's anchor is its leftmost `GRAM`-byte string of least hash, which depends on the window's bytes alone: equal
    windows, wherever they are, have equal anchors at equal offsets. Every window is in exactly one run, of `size` at most.
    """
    out = []
    for base in range(0, len(raw) - size + 1, SEGMENT):
        part = raw[base : base + SEGMENT + size - 1]
        n = len(part)
        w8 = np.ndarray((n - 7,), "<u8", part, strides=(1,))
        m = n - GRAM + 1
        h = w8[:m] * np.uint64(0x9E3779B97F4A7C15)
        for i in range(8, GRAM, 8):
            h ^= h >> np.uint64(29)
            h += w8[i : i + m]
            h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        key = (h & ~_LOW) | np.arange(m, dtype=np.uint64)
        width, have = size - GRAM + 1, 1
        while 2 * have <= width:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        if have < width:
            key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
        at = (key & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.append(first, len(at)))
        signed = h.view(np.int64)
        out += [(base + int(f), int(c), int(a - f), int(signed[a])) for f, c, a in zip(first, count, at[first])]
    return out


def halves(d: int) -> tuple[int, int]:
    """A 128-bit digest as two signed integers."""
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def runs(docs: DataFrame, size: int) -> DataFrame:
    """The anchored runs of all documents, each with a 128-bit digest of its bytes."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k1, k2, t in zip(batch["_k1"], batch["_k2"], batch["text"]):
                raw = (t or "").encode("utf-8", "replace")
                if len(raw) >= size:
                    for first, count, offset, h in anchors(raw, size):
                        d = xxhash.xxh3_128_intdigest(raw[first : first + count - 1 + size])
                        rows.append((k1, k2, first, count, offset, h, *halves(d)))
            yield pd.DataFrame(rows, columns=["_k1", "_k2", "p", "n", "o", "h", "c1", "c2"]).astype("int64")

    return docs.select(*DOC, "text").mapInPandas(scan, "_k1 long, _k2 long, p long, n long, o long, h long, c1 long, c2 long")


def suffix_array(data: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Positions p with p + size <= end[p] that share their first `size` bytes with another, in suffix order.

    Larsson-Sadakane refinement: suffixes are sorted by their first 8 bytes, then by pairs of ranks at twice the length,
    and so on; a rank is the place where its group begins, and groups of one leave. Positions whose text ends before the
    next length leave as well, so no comparison runs past the end of a text.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).tobytes()
    act = np.flatnonzero(np.arange(n) + 8 <= end)
    keys = np.ndarray((n,), ">u8", padded, strides=(1,))[act].astype(np.uint64)
    rank = np.zeros(n, np.int64)
    have, old = 8, np.zeros(len(act), np.int64)
    while True:
        order = np.argsort(keys)
        act, keys, old = act[order], keys[order], old[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        length = np.diff(np.append(new, len(keys)))
        # Where the old group of each position begins in this order; the new rank counts from there.
        head = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]])) if len(old) else new
        begins = np.repeat(head, np.diff(np.append(head, len(old))))
        rank[act] = old + np.repeat(new, length) - begins
        several = np.repeat(length > 1, length)
        act = act[several]
        if have >= size or not len(act):
            return act
        step = min(have, size - have)
        act = act[act + have + step <= end[act]]
        old = rank[act]
        keys = (old.astype(np.uint64) << np.uint64(32)) | rank[act + step].astype(np.uint64)
        have += step


def kasai(data: np.ndarray, end: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix in `sa` with the one before it, within their texts.

    As in Kasai's algorithm the prefix of the next position is one shorter if its neighbour is the neighbour's next
    position; only where that chain breaks are bytes compared, eight at a time and all such places at once.
    """
    n = len(data)
    before = np.full(n + 1, -2, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.sort(sa[1:])
    fresh = (before[at] != before[at - 1] + 1) | (before[at - 1] < 0) | (at == 0) | (end[at] != end[at - 1]) | (end[before[at]] != end[np.maximum(before[at] - 1, 0)])
    lcp = np.zeros(n, np.int64)
    a, b = at[fresh], before[at[fresh]]
    room = np.minimum(end[a] - a, end[b] - b)
    w8 = np.ndarray((n,), ">u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    done, live = np.zeros(len(a), np.int64), np.arange(len(a))
    while len(live):
        x = w8[np.minimum(a[live] + done[live], n - 1)] ^ w8[np.minimum(b[live] + done[live], n - 1)]
        same = np.full(len(live), 8)
        off = x != 0
        same[off] = 7 - np.floor(np.log2((x[off] >> np.uint64(1)).astype(np.float64) + 0.5) + 1).astype(np.int64) // 8
        done[live] += same
        live = live[(same == 8) & (done[live] < room[live])]
    lcp[a] = np.minimum(done, room)
    chain = np.flatnonzero(fresh)
    source = np.repeat(chain, np.diff(np.append(chain, len(at))))
    lcp[at] = lcp[at[source]] - (at - at[source])
    return np.concatenate([[0], lcp[sa[1:]]])


def repeated_windows(texts: list[bytes], counts: np.ndarray, size: int) -> np.ndarray:
    """Positions in the joined texts (window starts only) whose `size` bytes occur at another window start."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    length = np.array([len(t) for t in texts])
    start = np.cumsum(length) - length
    end = np.repeat(start + length, length)
    sa = suffix_array(data, end, size)
    if not len(sa):
        return sa
    lcp = kasai(data, end, sa)
    hit = lcp >= size
    hit[:-1] |= hit[1:]
    return np.sort(sa[hit])


def duplicate_spans(docs: DataFrame, size: int = 400, text: str = "text", key: str = "doc_id", words: int = 51) -> DataFrame:
    """Byte stretches of documents that are covered by strings of `size` bytes which also start elsewhere.

    One row per document that has any, or that shares `words` words in a row with another one: _k1, _k2 (see keyed), p and n
    (arrays of starts and lengths, in no order), shares (true for the latter, else null).

    1. Texts are cut into runs of windows by content-defined anchors, about one for 190 bytes.
    2. Runs are counted by their bytes: equal runs repeat as a whole, and one of each goes on. Anchors with a single text are done.
    3. The rest are dealt by anchor to shards of bounded size; a suffix array and its common prefixes find repeated windows
       in each. A shard holds all texts around an anchor, unless those are very many: they are merged by binary search instead
       (see merged).

    Shared words are found from runs of word windows (see passages); the few that need it are cut from the texts along with 3.
    """
    docs = keyed(docs, text, key)
    settled, open_runs = passages.candidates(docs, words)
    all_runs = materialize(runs(docs, size))
    place = F.struct(*DOC, "p")
    contents = materialize(all_runs.groupBy("h", "c1", "c2").agg(F.count("*").alias("m"), F.min(place).alias("at"), F.min("n").alias("n"), F.min("o").alias("o")))
    whole = all_runs.join(contents.where("m > 1").select("h", "c1", "c2"), ["h", "c1", "c2"]).select(*DOC, "p", (F.col("n") + (size - 1)).alias("len"))
    several = contents.groupBy("h").agg(F.count("*").alias("g")).where("g > 1")
    left = contents.join(several, "h").select("h", "g", (F.col("m") == 1).alias("once"), "n", "o", "at.*")
    total = left.agg(F.sum(F.col("n") + (size - 1)).alias("b")).first()["b"] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    left = left.withColumn("many", F.col("g") > MOST_TOGETHER).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    parts = ["p", "n", "o", "h", "once", "many", "shard"]
    none = {"o": F.lit(None).cast("long"), "once": F.lit(None).cast("boolean"), "many": F.lit(None).cast("boolean"), "shard": F.lit(None).cast("long")}
    by_word = open_runs.withColumns({"n": F.col("len") - (size - 1), "word": F.lit(True)} | none)
    left = left.withColumn("word", F.lit(False)).unionByName(by_word.drop("len"), allowMissingColumns=True)
    wanted = left.groupBy(*DOC).agg(F.collect_list(F.struct(*parts, "word")).alias("w"))

    @F.pandas_udf("array<binary>")
    def slices(texts: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([[raw[x["p"] : x["p"] + x["n"] - 1 + size] for x in xs] for raw, xs in zip((t.encode("utf-8", "replace") for t in texts), w)])

    # Of rows that agree in key and text one is cut.
    one = docs.join(wanted, DOC).dropDuplicates(DOC)
    cut = one.select(*DOC, "w", slices("text", "w").alias("raw"))
    cut = materialize(cut.select(*DOC, F.explode(F.arrays_zip("w", "raw")).alias("x")).select(*DOC, "x.w.*", "x.raw"))
    many, of_bytes = cut.where("many").drop("word"), cut.where("not word").drop("word")

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["h", "_k1", "_k2", "p"]).reset_index(drop=True)
        texts, n = frame["raw"].tolist(), frame["n"].to_numpy()
        length = np.array([len(t) for t in texts])
        start = np.cumsum(length) - length
        hit = repeated_windows(texts, n, size)
        owner = np.searchsorted(start, hit, side="right") - 1
        rel = hit - start[owner]
        # The rest of a run whose like has been found as a whole needs no second answer.
        ok = (rel < n[owner]) & frame["once"].to_numpy()[owner]
        o, r = owner[ok], rel[ok]
        first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (r[1:] != r[:-1] + 1)])) if len(o) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(o)))
        f = frame.iloc[o[first]]
        return pd.DataFrame({"_k1": f["_k1"].to_numpy(), "_k2": f["_k2"].to_numpy(), "p": f["p"].to_numpy() + r[first], "len": count - 1 + size}).astype("int64")

    found = of_bytes.where("not many").groupBy("shard").applyInPandas(search, "_k1 long, _k2 long, p long, len long")
    shares = settled.union(passages.sharing(cut.where("word"), words)).withColumn("shares", F.lit(True))
    spans = whole.union(found).union(merged(many, size)).unionByName(shares, allowMissingColumns=True)
    spans = materialize(spans.groupBy(*DOC).agg(F.collect_list("p").alias("p"), F.collect_list("len").alias("n"), F.max("shares").alias("shares")))
    for t in (all_runs, contents, cut, settled, open_runs):
        drop_scratch(t)
    return spans


def merged(many: DataFrame, size: int) -> DataFrame:
    """Repeated windows (_k1, _k2, p, len) among texts around anchors that have too many for one shard, by binary search.

    Windows are searched by their anchor's offset, in ranges of offsets. All windows of a range hold the range's core;
    together they make up its content. A core that is unique settles a range: nothing repeats. A content that is not settles it as
    well: everything repeats, and one text stays as a witness for the others. Other ranges are cut into eighths and
    searched again, down to single windows, whose core is their content. So a text sends a few digests a round, not one
    for each window, and all counts are partial aggregates.
    """
    place = F.struct(*DOC, "p")
    found = many.select(*DOC, "p", F.lit(0).cast("long").alias("len")).limit(0)
    if many.isEmpty():
        return found
    todo, wide = many.select(*DOC, "p", "n", "o", "h", "once", "raw", F.lit(0).cast("long").alias("b")), 0
    for width in (64, 8, 1):

        def digests(batches: Iterator[pd.DataFrame], width=width, wide=wide) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for k1, k2, p, n, o, h, once, raw, b in batch.itertuples(index=False, name=None):
                    least, most = (max(o - n + 1, b * wide), min(o, b * wide + wide - 1)) if wide else (o - n + 1, o)
                    for part in range(least // width, most // width + 1):
                        a, z = part * width, part * width + width - 1
                        lo, hi = max(a, least), min(z, most)
                        core = xxhash.xxh3_128_intdigest(raw[o - a : o + size - z])
                        content = xxhash.xxh3_128_intdigest(raw[o - hi : o - lo + size], seed=lo << 16 | hi)
                        rows.append((k1, k2, p, h, once, part, p + o - hi, hi - lo + size, *halves(core), *halves(content)))
                out = pd.DataFrame(rows, columns=["_k1", "_k2", "p", "h", "once", "b", "at", "len", "c1", "c2", "d1", "d2"])
                yield out.astype({c: "int64" for c in out.columns if c != "once"} | {"once": bool})

        dg = materialize(todo.mapInPandas(digests, "_k1 long, _k2 long, p long, h long, once boolean, b long, at long, len long, c1 long, c2 long, d1 long, d2 long"))
        core, content = ["h", "b", "c1", "c2"], ["h", "b", "c1", "c2", "d1", "d2"]
        kinds = dg.groupBy(*content).agg(F.count("*").alias("m"), F.min(place).alias("first"))
        found = found.union(dg.where("once").join(kinds.where("m > 1").select(*content), content).select(*DOC, F.col("at").alias("p"), "len"))
        if width > 1:
            open_cores = kinds.groupBy(*core).agg(F.count("*").alias("k")).where("k > 1").select(*core)
            left = kinds.join(open_cores, core).select("first.*", "b", (F.col("m") == 1).alias("alone"))
            todo = many.select(*DOC, "p", "n", "o", "h", "once", "raw").join(left, [*DOC, "p"]).select(*DOC, "p", "n", "o", "h", (F.col("once") & F.col("alone")).alias("once"), "raw", "b")
            wide = width
    return found


def remove_duplicates(docs: DataFrame, size: int = 400, text: str = "text", key: str = "doc_id", words: int = 51) -> DataFrame:
    """Every document without the bytes covered by a `size`-byte string that also starts anywhere else.

    All copies go, the first one too; matches never cross documents, overlaps within one count, and strings are judged on
    the input. Returns one row per input row: key, n_bytes, n_removed, n_spans, kept_sha256, kept (binary, the remaining
    bytes; a cut may fall inside a character) and shares_passage (1 if `words` words in a row, whatever blanks or line ends are
    between them, also stand in another document, else 0; these may be shorter than `size` bytes and stay then). A null text counts as empty; repeated rows are copies of each other; other
    columns are ignored; an empty table gives no rows.
    """
    spans = duplicate_spans(docs, size, text, key, words)

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    def keep(texts: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.DataFrame:
        rows = []
        for t, p, n in zip(texts, starts, lengths):
            raw = (t or "").encode("utf-8", "replace")
            spans = []
            for a, m in sorted(zip(p, n)) if p is not None else ():
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], a + m)
                else:
                    spans.append([a, a + m])
            kept, at = [], 0
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            kept = b"".join([*kept, raw[at:]])
            rows.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = keyed(docs, text, key).join(spans, DOC, "left")
    shares = F.coalesce("shares", F.lit(False)).cast("int").alias("shares_passage")
    return joined.select("key", keep("text", "p", "n").alias("x"), shares).select(F.col("key").alias(key), "x.*", "shares_passage")
