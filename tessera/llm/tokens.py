"""Fast exact ids of the lower-casing word BPE tokenizer: distinct words are encoded once per worker."""

from __future__ import annotations

import json
import re
import struct

import numpy as np

from tessera.llm.base import one_of_a_kind

#: A word of printable ASCII (no apostrophe) and Latin-1 letters: normalisation leaves it alone but for its case, and the
#: tokenizer cuts it into runs of letters, single digits and runs of the rest.
SIMPLE = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
RUNS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
MOST_WORDS, MOST_RUNS = 500_000, 400_000


class WordBpe:
    """Ids as little-endian unsigned 32-bit bytes, equal to encode(text, add_special_tokens=False).ids.

    White space never survives the tokenizer and never joins two tokens, so a text is the concatenation of its words. Both
    caches are emptied when full, which bounds a worker's memory and changes no result.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.full = Tokenizer.from_file(path)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.words: dict[str, bytes] = {"": b""}
        self.runs: dict[str, bytes] = {}
        self.bare = None
        if self.suffix and not model.get("dropout"):
            byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
            line = {"type": "Split", "pattern": {"String": "\n"}, "behavior": "Removed", "invert": False}
            bare = spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [line, byte_level]}}
            self.bare = Tokenizer.from_str(json.dumps(bare))
            self.last = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.last[[i for t, i in model["vocab"].items() if t.endswith(self.suffix)]] = True

    def _encode_runs(self, runs: list[str]) -> None:
        for i in range(0, len(runs), 256):
            part = runs[i : i + 256]
            ids = np.array(self.bare.encode("\n".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                raise RuntimeError("the tokenizer's words could not be told apart")
            raw, at = ids.tobytes(), 0
            for run, end in zip(part, ends.tolist()):
                self.runs[run] = raw[4 * at : 4 * end]
                at = end

    def _encode_words(self, words: set[str], needed: set[str]) -> None:
        if len(self.words) + len(words) > MOST_WORDS:
            self.words, words = {"": b""}, needed.difference({""})
        if len(self.runs) > MOST_RUNS:
            self.runs = {}
        simple = {}
        for w in words:
            if self.bare and SIMPLE.fullmatch(w) and "<|" not in w:
                simple[w] = RUNS.findall(w.lower())
            else:
                self.words[w] = np.array(self.full.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        self._encode_runs(list({r for runs in simple.values() for r in runs}.difference(self.runs)))
        for w, runs in simple.items():
            self.words[w] = b"".join([self.runs[r] for r in runs])

    def encode(self, text: str) -> bytes:
        if any(s in text and re.search(r"\s", s) for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        missing = set(words).difference(self.words)
        if missing:
            self._encode_words(missing, set(words))
        return b"".join(map(self.words.__getitem__, words))


def word_bpe(path: str) -> WordBpe:
    return one_of_a_kind((WordBpe, path), lambda: WordBpe(path))


def id_bytes(i: int) -> bytes:
    return struct.pack("<I", i)
