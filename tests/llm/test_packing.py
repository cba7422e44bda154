import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.packing import assemble, pack, shortest_pack_first, slots
from tessera.llm.tokens import WordBpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12), st.integers(40, 60))
@settings(max_examples=150, deadline=None)
def test_patterns_hold_every_length_once(histogram, size):
    patterns = shortest_pack_first(histogram, size)
    seen = {}
    for count, lengths in patterns:
        assert count > 0 and sum(lengths) <= size
        for n in lengths:
            seen[n] = seen.get(n, 0) + count
    assert seen == histogram
    key, first, base, offset = slots(patterns)
    taken = set()
    for n, total in histogram.items():
        for r in range(total):
            j = np.searchsorted(key, n << 44 | r, side="right") - 1
            spot = (int(base[j] + r - first[j]), int(offset[j]), n)
            assert spot not in taken
            taken.add(spot)
    by = {}
    for s, o, n in taken:
        by.setdefault(s, []).append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n


TEXTS = ["don't I'll ÀÉ x y ß×÷ª<|endoftext|>x  \x1c İstanbul ΣΑΣ é ' ́ {|}~ 中文1234 a_b<|endoftext|>", "", " \n\t", "µº¿¡ ÿŸ", "a b <|startoftext|> c", "Straße's 12,5"]


def test_cached_ids_equal_the_tokenizer(monkeypatch):
    full = Tokenizer.from_file(PATH)
    monkeypatch.setattr("tessera.llm.tokens.MOST_WORDS", 6)
    monkeypatch.setattr("tessera.llm.tokens.MOST_RUNS", 4)
    small, r = WordBpe(PATH), random.Random(0)
    letters = "abcdeé fgß ÀÖ'12.,!#\n\t <|>x"
    for t in TEXTS + ["".join(r.choices(letters, k=r.randint(0, 60))) for _ in range(300)]:
        assert np.frombuffer(small.encode(t), "<u4").tolist() == full.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("size", [16, 4096])
def test_round_trip(spark, size):
    r = random.Random(1)
    texts = [None, "", "word " * 3000] + [" ".join(r.choices(["one", "two", "three's", "vier", "cinco,"], k=r.randint(1, 90))) for _ in range(60)] + ["same text"] * 20
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    packed = pack(docs, PATH, size=size, keep_ids=True)
    rows = packed.collect()
    full = Tokenizer.from_file(PATH)
    by, seqs = {}, {}
    for p in rows:
        by.setdefault(p.doc_id, []).append(p)
        seqs.setdefault(p.sequence_id, []).append(p)
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and len(p.ids) == p.length
    for i, t in enumerate(texts):
        ids = full.encode(t or "", add_special_tokens=False).ids + [2]
        assert sum((p.ids for p in sorted(by[i], key=lambda p: p.start)), []) == ids and by[i][0].doc_tokens == len(ids)
    for parts in seqs.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
    assert sorted(seqs) == list(range(len(seqs)))
    for s in assemble(packed).collect():
        assert len(s.input_ids) == len(s.document_index) == sum(p.length for p in seqs[s.sequence_id])
    assert pack(docs.limit(0), PATH).count() == 0
