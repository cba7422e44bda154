"""Token counts of byte-level BPE tokenizers: a heap of adjacent pairs over a linked list of symbols, no ids emitted."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import one_of_a_kind

#: How the byte-level pre-tokenizer cuts a text (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words up to so many characters are remembered, in two generations of so many words at most; forgetting changes no result.
CACHED_CHARS, CACHED_WORDS = 64, 600_000
#: Characters of a text that are cut into words at a time.
STRETCH = 1 << 20
_POSITION_BITS = 40
_GAP = re.compile(r"(?<=[^\s])\s(?=[^\s])")


def _byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def _newer_letters() -> re.Pattern | None:
    """Letters and digits that only newer Unicode versions know: there the library's own cut decides."""
    known = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
    newer = [ord(c) for c in known if unicodedata.category(c) == "Cn"]
    spans: list[list[int]] = []
    for c in newer:
        if spans and c == spans[-1][1] + 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in spans) + "]") if spans else None


class TokenCounter:
    """Counts the tokens that encode(text, add_special_tokens=False) of a byte-level BPE tokenizer file would give."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        odd = model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges")
        added = spec.get("added_tokens") or []
        if model.get("type") != "BPE" or not plain or odd or spec.get("normalizer") or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        vocab = model["vocab"]
        self.byte = [vocab[c] for c in _byte_symbols()]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 32 | vocab[b]] = r
            self.merged.append(vocab[a + b])
        special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.cut, self.newer, self.library = regex.compile(PATTERN), _newer_letters(), Tokenizer.from_file(path).pre_tokenizer
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Symbols of one word after all merges: as many as it has bytes, less one for each merge.

        The heap holds (rank, position) of adjacent pairs; a popped entry is stale if the pair that now starts there has
        another rank. Each merge unlinks one symbol and pushes at most two pairs, so a word of n bytes takes n log n steps.
        """
        get, merged, push, pop = self.rank.get, self.merged, heapq.heappush, heapq.heappop
        symbol = [self.byte[b] for b in word.encode()]
        n = left = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << _POSITION_BITS | i for i, (a, b) in enumerate(zip(symbol, symbol[1:])) if (r := get(a << 32 | b)) is not None]
        heapq.heapify(heap)
        low = (1 << _POSITION_BITS) - 1
        while heap:
            top = pop(heap)
            i = top & low
            j, a, r = after[i], symbol[i], top >> _POSITION_BITS
            if a < 0 or j >= n or get(a << 32 | symbol[j]) != r:
                continue
            symbol[i] = a = merged[r]
            symbol[j] = -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(a << 32 | symbol[k])) is not None:
                    push(heap, r << _POSITION_BITS | i)
            h = before[i]
            if h >= 0 and (r := get(symbol[h] << 32 | a)) is not None:
                push(heap, r << _POSITION_BITS | h)
        return left

    def _words(self, text: str) -> Iterator[list[str]]:
        """The pre-tokenizer's words, a stretch of text at a time: a blank between two solids always begins a word."""
        at = 0
        while at < len(text):
            gap = _GAP.search(text, at + STRETCH) if len(text) - at > STRETCH else None
            end = gap.start() if gap else len(text)
            yield self.cut.findall(text[at:end] if at or gap else text)
            at = end

    def _plain(self, text: str) -> int:
        known, total = self.known, 0
        for words in self._words(text):
            for word, times in Counter(words).items():
                n = known.get(word)
                if n is None:
                    n = self.older.get(word)
                    if n is None:
                        if self.newer and not word.isascii() and self.newer.search(word):
                            # Never remembered, so no text with such a letter goes past this line.
                            return sum(self.word(text[a:b]) for _, (a, b) in self.library.pre_tokenize_str(text))
                        n = self.word(word)
                    if len(word) <= CACHED_CHARS:
                        if len(known) >= CACHED_WORDS:
                            # What has not come up again since the last turn is forgotten.
                            self.older, self.known = known, {}
                            known = self.known
                        known[word] = n
                total += n * times
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(map(self._plain, parts))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each row of docs: key, n_bytes (UTF-8), n_tokens as the tokenizer file gives them, over_limit (n_tokens > limit).

    Texts are cut into words as the byte-level pre-tokenizer does, and each word's pairs are merged lowest rank first
    from a heap over a linked list; special strings inside a text are one token each. Whole texts count, with neither begin
    nor end tokens, truncation or padding. Nothing is shuffled; a worker holds the vocabulary and a bounded cache of words.
    Null and empty texts have 0 bytes and tokens; repeated rows and keys count as often as they occur; a null key stays null;
    an empty table gives no rows; other columns are ignored, whatever their names.
    """

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        counter = one_of_a_kind((TokenCounter, tokenizer), lambda: TokenCounter(tokenizer))
        return pd.Series([counter.count(t) for t in texts], dtype="int64")

    rows = docs.select(docs[key].alias("doc_id"), F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long").alias("n_bytes"), counted(docs[text]).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
