"""Runs (maximal periodic stretches) of word sequences in linear time over an ordered alphabet: Lyndon arrays, no suffix structure, no hashes."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a word is (fixed value): a stretch without blank, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def lyndon_array(w: Sequence[Any], flip: bool = False) -> tuple[list[int], list[int]]:
    """(after, match): the next smaller suffix of each place, and how far both suffixes agree.

    w[i:after[i]] is the longest Lyndon word at i. `flip` turns the order of the symbols round; a proper prefix is smaller
    in both orders. Only == and < of symbols are used. Places come left to right; those without a smaller suffix yet are a
    chain of previous smaller suffixes, and each new place is compared along it. A comparison seldom looks at symbols:

    * If the chain's upper pair agrees for P and the new place with the upper one for k, then the lower one agrees with the
      new place for min(P, k) unless both are equal, and from there on it is matched further.
    * w[b - d : r - d] == w[b:r] is the match that reaches farthest. Two places inside [b, r) agree as their images d to
      the left do, which have been compared; only what reaches r is matched further, so r moves on with each match.
    """
    n = len(w)
    after, match = [n] * n, [0] * n
    below, agrees = [-1] * n, [0] * n
    b = d = r = 0
    for j in range(1, n):
        t, k, settled = j - 1, 0, False
        wj = w[j]
        while t >= 0:
            if not settled:
                if j + k < r and t >= b:
                    s, u = t - d, j - d
                    m = match[s] if after[s] == u else agrees[u] if below[u] == s else k
                    if m > k:
                        k = m if j + m < r else r - j
                if k or w[t] == wj:
                    while j + k < n and w[t + k] == w[j + k]:
                        k += 1
                    if j + k > r:
                        b, d, r = j, j - t, j + k
            if j + k < n and (w[j + k] < w[t + k]) == flip:
                below[j], agrees[j] = t, k
                break
            after[t], match[t] = j, k
            p = agrees[t]
            t = below[t]
            settled = p != k
            if p < k:
                k = p
    return after, match


def _left(w: Sequence[Any], after: list[int], match: list[int], least: int, exponent: int) -> set[tuple[int, int, int]]:
    """Runs (start, length, period) whose Lyndon root is an edge (i, after[i]) and that reach `least` and exponent * period.

    Edges come right to left, and matches to the left reuse the one that reaches farthest as those to the right do. A match
    of a whole period means that the same run's root stands one period before, where it is found.
    """
    n, found = len(w), set()
    matched: dict[int, int] = {}
    a = d = low = n
    for i in range(n - 1, -1, -1):
        j = after[i]
        p = j - i
        need = max(least, exponent * p)
        if j == n or match[i] + 2 * p - 1 < need:
            continue
        e, most = 0, min(p, i)
        if j <= a and low < i:
            known = matched.get(i + d) if after[i + d] == j + d else None
            if known is not None:
                e = min(known, i - low, most)
        if e == 0 or i - e <= low:
            while e < most and w[i - 1 - e] == w[j - 1 - e]:
                e += 1
        matched[i] = e
        if i - e < low:
            a, d, low = i, p, i - e
        if e < p and e + p + match[i] >= need:
            found.add((i - e, e + p + match[i], p))
    return found


def find_runs(w: Sequence[Any], least: int = 2, exponent: int = 2) -> list[tuple[int, int, int]]:
    """All runs of w as (start, length, period) in order: maximal stretches of smallest period `period` with length >= max(least, exponent * period).

    Every run has a Lyndon word of its period's length as root in one of the two orders of the alphabet, and the longest
    Lyndon word there is that root. exponent is 2 or more.
    """
    if exponent < 2:
        raise ValueError("a run holds its period twice at least")
    found: set[tuple[int, int, int]] = set()
    for flip in (False, True):
        found |= _left(w, *lyndon_array(w, flip), least, exponent)
    return sorted(found)


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 6, exponent: int = 4) -> DataFrame:
    """For each row of docs: key, n_words, runs (array of start, length, period in words from 0, by start and period), collapsed.

    A run is a stretch of words with smallest period q and length >= max(least, exponent * q) that no neighbouring word
    extends. `collapsed` is the text's words joined by one space, without those that some run holds after its first q words.
    Work and memory are linear in a text, whole texts are read, nothing is shuffled. A null or empty text has no words, no
    runs and an empty collapsed text; repeated rows and keys are judged each by itself; a null key stays null; an empty
    table gives no rows; other columns are ignored, whatever their names.
    """

    @F.pandas_udf("n_words long, start array<long>, length array<long>, period array<long>, collapsed string")
    def judge(texts: pd.Series) -> pd.DataFrame:
        cut, rows = re.compile(WORD).findall, []
        for t in texts:
            words = cut(t or "")
            found = find_runs(words, least, exponent)
            kept, gone = words, 0
            if found:
                kept = []
                for start, end in sorted((start + period, start + length) for start, length, period in found):
                    kept += words[gone : max(gone, start)]
                    gone = max(gone, end)
                kept += words[gone:]
            rows.append((len(words), [f[0] for f in found], [f[1] for f in found], [f[2] for f in found], " ".join(kept)))
        return pd.DataFrame(rows, columns=["n_words", "start", "length", "period", "collapsed"])

    judged = docs.select(docs[key].alias("doc_id"), judge(docs[text]).alias("_j"))
    zipped = F.arrays_zip("_j.start", "_j.length", "_j.period")
    return judged.select("doc_id", "_j.n_words", zipped.alias("runs"), "_j.collapsed")


def digests(found: DataFrame) -> DataFrame:
    """periodic_runs() as one row of figures: the longest run (ties: smallest start, then period), digests of runs and collapsed text."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.withColumn("_t", top)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_t.s")).alias("start"),
        F.col("_t.l").alias("length"),
        (-F.col("_t.p")).alias("period"),
        F.floor(1000 * F.col("_t.l") / -F.col("_t.p")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text) of docs, with the words of those keys periodic from one place on whose CRC-32 is divisible by 10.

    Place and period follow from the checksum h of the decimal key and the number of words n: with g = h div 10, word i >=
    a = g mod n becomes word a + (i - a) mod p, where p = 1 + (n - a) div (3 + g mod 8). Null keys and texts stay as they are.
    """
    h = F.crc32(docs[key].cast("string").cast("binary"))
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"), h.alias("_h"))
    rows = rows.withColumn("_w", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    n, g = F.size("_w").cast("long"), F.floor(F.col("_h") / 10)
    rows = rows.withColumn("_n", n).withColumn("_a", F.pmod(g, F.greatest(n, F.lit(1)))).withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8)))
    places = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)
    source = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    periodic = F.array_join(F.transform(places, lambda i: F.element_at("_w", (source(i) + 1).cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("_n") > 0, periodic).otherwise(F.col("text")).alias("text"))
