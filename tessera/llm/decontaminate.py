"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import one_of_a_kind

GAP = re.compile(r"[\W_]+")
WORD = re.compile(r"[^\W_]+")


def lower(text: str) -> str:
    """Lower case of the same length: the few letters whose lower case is longer stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normalise(text: str) -> str:
    """Lower case, with everything between words reduced to one space."""
    return GAP.sub(" ", lower(text)).strip(" ")


def places(text: str) -> list[int]:
    """For each character of normalise(text) the place of its source in text."""
    at: list[int] = []
    for m in WORD.finditer(lower(text)):
        if at:
            at.append(m.start() - 1)
        at.extend(range(m.start(), m.end()))
    return at


def myers(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """Smallest edit distance of the pattern to a substring of text, and where the first such substring ends.

    Myers' bit-parallel recurrence: a column of the distance matrix is two bit vectors of the pattern's length. `anchored`
    holds the substring's start at the text's.
    """
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    eq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        eq[c] |= 1 << i
    up, down, score, best, end, carry = full, 0, m, m, 0, int(anchored)
    for j, c in enumerate(text, 1):
        e = eq[c] if c in eq else 0
        xv = e | down
        xh = (((e & up) + up) ^ up) | e
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1 | carry) & full
        up = ((mh << 1) & full) | (full & ~(xv | ph))
        down = ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """Finds benchmark items within their error budget in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = items
        self.budget = [int(rate * len(t)) for _, t in items]
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, t) in enumerate(items):
            pieces = self.budget[i] + 1
            cuts = [len(t) * j // pieces for j in range(pieces + 1)]
            for a, b in zip(cuts, cuts[1:]):
                found[t[a:b]].append((i, a))
        self.pieces = ahocorasick.Automaton()
        for piece, owners in found.items():
            self.pieces.add_word(piece, (len(piece), owners))
        if found:
            self.pieces.make_automaton()

    def windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each item the stretches of text where it can be, from exact hits of its pieces."""
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (n, owners) in self.pieces.iter(text) if len(self.pieces) else ():
            for i, a in owners:
                starts[i].add(end + 1 - n - a)
        out = {}
        for i, found in starts.items():
            k, m, spans = self.budget[i], len(self.items[i][1]), []
            for s in sorted(found):
                a, b = max(0, s - k), s + m + k
                if spans and a <= spans[-1][1] - m:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
            out[i] = spans
        return out

    def search(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item number, distance, start, end) in the normalised text: each item's closest match within its budget."""
        for i, spans in self.windows(text).items():
            pattern, k, best = self.items[i][1], self.budget[i], None
            m = len(pattern)
            for a, b in spans:
                window = text[a:b]
                at = window.find(pattern)
                d, end = (0, at + m) if at >= 0 else myers(pattern, window)
                if d <= k and (best is None or d < best[0]):
                    best = (d, a + end)
                    if d == 0:
                        break
            if best:
                d, end = best
                start = end - m
                if d:
                    start = end - myers(pattern[::-1], text[max(0, end - m - k) : end][::-1], anchored=True)[1]
                yield i, d, start, end

    def any(self, text: str) -> bool:
        return next(self.search(text), None) is not None


def _matcher(held) -> Matcher:
    """Built once per worker and broadcast."""
    return one_of_a_kind((Matcher, held.id), lambda: Matcher(*held.value))


class _Held:
    """A broadcast with an identity that survives pickling."""

    def __init__(self, spark, items, rate):
        self._b = spark.sparkContext.broadcast((items, rate))
        self.id = self._b._jbroadcast.id() if hasattr(self._b, "_jbroadcast") else id(self._b)

    @property
    def value(self):
        return self._b.value

    def __getstate__(self):
        return {"_b": self._b, "id": self.id}


def blocks(benchmark: DataFrame, rate: float, least_words: int, block_chars: int, text: str) -> list:
    """Distinct benchmark texts, each under two hashes, in broadcast blocks of about `block_chars` characters."""
    texts = benchmark.select(F.col(text).alias("text")).where("text is not null").distinct()
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // block_chars)
    held = []
    for b in range(n):
        rows = texts.select(*_hashes("text"), "text").where(F.pmod("h", F.lit(n)) == b).collect()
        keep = sorted(((r["h"], r["g"]), t) for r in rows if (t := normalise(r["text"])).count(" ") + 1 >= least_words)
        held.append(_Held(benchmark.sparkSession, keep, rate))
    return held


def _hashes(text: str) -> list[Column]:
    return [F.xxhash64(F.lit(i), F.col(text)).alias(c) for i, c in ((1, "h"), (2, "g"))]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = 0.08,
    least_words: int = 5,
    block_chars: int = 8_000_000,
    text: str = "text",
    key: str = "doc_id",
    bench_text: str = "text",
    item: str = "item_id",
) -> DataFrame:
    """All pairs of a document and a benchmark item that it holds within the item's error budget.

    Texts are compared in lower case with all that separates words reduced to one space. An item of n characters may be
    off by int(rate * n) edits (insertions, deletions, substitutions); it is cut into one piece more than that, so at least
    one piece is in the document as it is. An automaton finds every exact piece hit, each hit gives a stretch of text, and
    Myers' bit-parallel distance decides. Items of fewer than `least_words` words take no part. The benchmark's distinct texts are
    broadcast in blocks of about `block_chars` characters, as many as it takes; documents are scanned where they lie, never shuffled.
    Returns doc_id, item_id, distance, similarity (1 - distance / n), start, end (characters of the original text) of the
    closest match, the earliest-ending one of equals. Null or empty texts match nothing; repeated documents or items each
    give their rows; other columns are ignored; an empty table on either side gives no rows.
    """
    kind = dict(docs.dtypes)[key]
    schema = f"doc_id {kind}, h long, g long, distance int, similarity double, start long, end long"
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found = docs.sparkSession.createDataFrame([], schema)
    for held in blocks(benchmark, rate, least_words, block_chars, bench_text):

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            m = _matcher(held)
            for batch in batches:
                rows = []
                for doc, t in zip(batch["doc_id"], batch["text"]):
                    if t:
                        hits = list(m.search(normalise(t)))
                        at = places(t) if hits else []
                        rows += [(doc, *m.items[i][0], d, 1 - d / len(m.items[i][1]), at[a], at[b - 1] + 1) for i, d, a, b in hits if b > a]
                out = pd.DataFrame(rows, columns=["doc_id", "h", "g", "distance", "similarity", "start", "end"])
                yield out.astype({"doc_id": batch["doc_id"].dtype}) if rows else out

        found = found.union(source.mapInPandas(scan, schema))
    items = benchmark.where(F.col(bench_text).isNotNull()).select(F.col(item).alias("item_id"), *_hashes(bench_text))
    return found.join(items, ["h", "g"]).select("doc_id", "item_id", "distance", "similarity", "start", "end")


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, least_words: int = 5, block_chars: int = 8_000_000, text: str = "text", bench_text: str = "text") -> DataFrame:
    """The documents, all columns, that hold no benchmark item within its error budget (see contaminated).

    Null and empty texts hold none and stay; repeated rows stay or go together; an empty benchmark takes nothing, an empty
    table gives no rows; columns of any other name pass through.
    """

    def holds(held) -> Column:
        @F.pandas_udf("boolean")
        def any_of(texts: pd.Series) -> pd.Series:
            m = _matcher(held)
            return pd.Series([bool(t) and m.any(normalise(t)) for t in texts], dtype="bool")

        return any_of(F.col(text))

    for held in blocks(benchmark, rate, least_words, block_chars, bench_text):
        docs = docs.where(~holds(held))
    return docs
