"""Licence scans: an exact set-similarity join of licence templates with text blocks."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words are runs of digits, a-z and all characters beyond ASCII, after A-Z became a-z; in UTF-8 the latter are bytes from 0x80.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

#: Fixed phrases and their labels: found wherever their words stand consecutively.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Licence notices and their labels: found where a block holds enough of their words.
NOTICES = {
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-notice",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-notice",
    "released under the mit license": "mit-release",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-notice",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution": "cc-notice",
    "copyright all rights reserved": "reserved",
}


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    #: A base phrase must stand as it is; of a notice, a share of the distinct words must stand within `span` words.
    base: bool
    needed: int
    span: int


def templates(phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, threshold: float = 0.8, slack: float = 1.25) -> list[Template]:
    out = [Template(label, (w := tuple(text.encode().split())), True, len(set(w)), len(w)) for text, label in phrases.items()]
    for text, label in notices.items():
        w = tuple(text.encode().split())
        out.append(Template(label, w, False, int(np.ceil(threshold * len(set(w)) - 1e-9)), int(np.ceil(slack * len(w)))))
    return out


class Index:
    """Templates by the tokens of their prefixes.

    Tokens are ordered by how many documents of the whole corpus hold them, rarest first. A block that holds `needed` of
    a template's n distinct tokens holds one of its n - needed + 1 rarest, its prefix: blocks are looked for around those alone.
    """

    def __init__(self, found: list[Template], frequency: dict[bytes, int]):
        self.found = found
        self.prefix: dict[bytes, list[int]] = defaultdict(list)
        self.rare: list[set[bytes]] = []
        self.anchor = []
        for i, t in enumerate(found):
            order = sorted(set(t.words), key=lambda w: (frequency.get(w, 0), w))
            self.anchor.append(t.words.index(order[0]))
            self.rare.append(set(order[: len(order) - t.needed + 1]))
            for w in self.rare[i]:
                self.prefix[w].append(i)
        self.vocabulary = {w for t in found for w in t.words}

    def blocks(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of words, and (template, first word, containment) of every place of a phrase and every block of a notice."""
        raw = (text or "").encode("utf-8", "replace").lower()
        if not raw:
            return 0, []
        mask = _IS_WORD[np.frombuffer(raw, np.uint8)]
        n = int(mask[0]) + int(np.count_nonzero(mask[1:] > mask[:-1]))
        # A text that does not even hold a prefix token's letters needs no cutting into words.
        near = {i for w, owners in self.prefix.items() if w in raw for i in owners}
        near = [i for i in sorted(near) if n >= self.found[i].needed]
        if not near:
            return n, []
        words = WORD.findall(raw)
        at: dict[bytes, list[int]] = defaultdict(list)
        for j, w in enumerate(words):
            if w in self.vocabulary:
                at[w].append(j)
        out = []
        for i in near:
            t = self.found[i]
            if t.base:
                a, m = self.anchor[i], len(t.words)
                # Positional filter: the rarest word fixes where the phrase must start, which must lie within the text.
                starts = [p - a for p in at.get(t.words[a], ()) if p >= a and p - a + m <= n]
                out += [(i, s, 1.0) for s in starts if tuple(words[s : s + m]) == t.words]
            else:
                out += [(i, s, c / len(set(t.words))) for s, c in self._notice(t, self.rare[i], at)]
        return n, out

    @staticmethod
    def _notice(t: Template, rare: set[bytes], at: dict[bytes, list[int]]) -> list[tuple[int, int]]:
        """(first word, distinct tokens) of the template's blocks, from left to right.

        A block is a window of at most `span` words that starts at a template token and holds `needed` distinct ones. From
        the first such start, the window with the most distinct tokens among those that start inside it is a block
        (the earliest of equals), which ends where it has them all; the next one is looked for after that end.
        """
        tokens = [w for w in set(t.words) if w in at]
        if len(tokens) < t.needed:
            return []
        # Prefix filter: windows that hold a prefix token lie within `span` words of it.
        marks = sorted(p for w in rare if w in at for p in at[w])
        kind = {w: k for k, w in enumerate(tokens)}
        places = sorted((p, kind[w]) for w in tokens for p in at[w])
        pos = np.array([p for p, _ in places])
        marks = np.array(marks)
        lo, hi = np.searchsorted(marks, pos - t.span, side="right"), np.searchsorted(marks, pos + t.span)
        close = hi > lo
        # Length filter: a window of fewer template tokens, repeats included, cannot hold enough distinct ones.
        ends = np.searchsorted(pos, pos + t.span)
        close &= ends - np.arange(len(pos)) >= t.needed
        starts = np.flatnonzero(close).tolist()
        size: dict[int, tuple[int, int]] = {}

        def window(j: int) -> tuple[int, int]:
            """Distinct tokens in the window from place j on, and the place after which it has them all."""
            if j not in size:
                seen: set[int] = set()
                last = j
                for i in range(j, int(ends[j])):
                    if places[i][1] not in seen:
                        seen.add(places[i][1])
                        last = i
                size[j] = len(seen), last
            return size[j]

        out, after, i = [], -1, 0
        while i < len(starts):
            j = starts[i]
            if j <= after or window(j)[0] < t.needed:
                i += 1
                continue
            best, r = j, i + 1
            while r < len(starts) and starts[r] < ends[j]:
                if window(starts[r])[0] > window(best)[0]:
                    best = starts[r]
                r += 1
            out.append((int(pos[best]), window(best)[0]))
            after = window(best)[1]
            while i < len(starts) and starts[i] <= after:
                i += 1
        return out


def frequencies(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> dict[bytes, int]:
    """How many documents hold each template token, over all documents; at most as many rows as there are tokens come back."""
    words = sorted(vocabulary)

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for t in batch["text"]:
                raw = (t or "").encode("utf-8", "replace").lower()
                # Most tokens are nowhere near: a plain search spares cutting the text into words.
                near = [w for w in words if w in raw]
                if near:
                    total.update(set(near).intersection(WORD.findall(raw)))
        yield pd.DataFrame({"w": [w.decode() for w in total], "n": list(total.values())}, columns=["w", "n"]).astype({"w": object, "n": "int64"})

    rows = docs.select(F.col(text).alias("text")).mapInPandas(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return {r["w"].encode(): r["n"] for r in rows.collect()}


def scan(docs: DataFrame, found: list[Template] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Licence blocks of every document: doc_id, n_words, blocks (array of label, base, start, containment).

    A base phrase counts at every place where its words stand consecutively, lines or not. A notice counts at every block
    of at most `span` words that holds the threshold's share of its distinct words; blocks of a notice do not overlap (see
    Index._notice). Null and empty texts have no words and no blocks; one row per input row, whatever its key and however
    often it is repeated (repeats count for the token order, which changes no result); an empty table gives no rows; other
    columns are ignored.
    """
    found = found or templates()
    index = Index(found, frequencies(docs, {w for t in found for w in t.words}, text))
    held = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("n_words long, template array<int>, start array<long>, containment array<double>")
    def blocks(texts: pd.Series) -> pd.DataFrame:
        rows = [held.value.blocks(t) for t in texts]
        return pd.DataFrame({"n_words": [n for n, _ in rows], **{c: [[b[k] for b in bs] for _, bs in rows] for k, c in enumerate(("template", "start", "containment"))}})

    names = F.array(*[F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base")) for t in found])
    rows = docs.select(F.col(key).alias("doc_id"), blocks(F.col(text)).alias("b")).select("doc_id", "b.*")
    zipped = F.transform(
        F.arrays_zip("template", "start", "containment"),
        lambda x: F.struct(names[x["template"]]["label"].alias("label"), names[x["template"]]["base"].alias("base"), x["start"].alias("start"), x["containment"].alias("containment")),
    )
    return rows.select("doc_id", "n_words", zipped.alias("blocks"))


def summary(scanned: DataFrame) -> DataFrame:
    """A scan() result as one flat row per document."""
    base = F.filter("blocks", lambda x: x["base"])
    joined = lambda blocks: F.array_join(F.array_sort(F.array_distinct(F.transform(blocks, lambda x: x["label"]))), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["start"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("blocks")).alias("labels"),
        F.coalesce(F.array_max(F.transform("blocks", lambda x: x["containment"])), F.lit(0.0)).alias("score"),
    )
