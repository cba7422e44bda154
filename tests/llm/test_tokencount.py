import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import tokencount
from tessera.llm.tokencount import TokenCounter, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(PATH)


def ids(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_every_character(library, counter):
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    for i in range(0, len(points), 64):
        text = "".join(f"a{c}1{c}{c} {c}'s" for c in points[i : i + 64])
        assert counter.count(text) == ids(library, text), hex(ord(points[i]))


def test_random_texts(library, counter):
    r = random.Random(5)
    letters = ["a", "b", "th", "ing", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "'ll", "'", "7", "½", "é", "日本", "ß", "🙂", "\U00011bc0", "\x00", "<|endoftext|>", "<|endof", "|>", "-", "..."]
    for _ in range(3000):
        text = "".join(r.choices(letters, k=r.randint(0, 40)))
        assert counter.count(text) == ids(library, text), repr(text)


def test_stretches_of_a_long_text(library, counter, monkeypatch):
    r = random.Random(6)
    texts = ["".join(r.choices(["word", " ", "  ", "\n", " \n", "x'll", "1", "é"], k=400)) for _ in range(40)]
    monkeypatch.setattr(tokencount, "STRETCH", 7)
    for text in texts:
        assert counter.count(text) == ids(library, text), repr(text)


def test_long_words(library, counter):
    for text in ("a" * 50_000, "ab" * 20_000, "".join(random.Random(2).choices("etaoin", k=30_000)), "日本語" * 5_000, " " * 10_000, "=" * 10_000):
        assert counter.count(text) == ids(library, text)


def test_rows(spark):
    rows = [(None, "a b", 1), (1, None, 1), (2, "", 1), (3, "hello world", 1), (3, "hello world", 1), (4, "<|endoftext|>x<|endoftext|>", 1), (5, "word " * 600, 1), (6, "é", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").withColumnRenamed("n_tokens", "n_bytes")
    got = [tuple(r) for r in count_tokens(df, PATH).collect()]
    assert got == [(None, 3, 2, False), (1, 0, 0, False), (2, 0, 0, False), (3, 11, 2, False), (3, 11, 2, False), (4, 27, 3, False), (5, 3000, 601, True), (6, 2, 1, False)]
    assert [r.over_limit for r in count_tokens(df, PATH, limit=2).where("n_tokens = 2").collect()] == [False] * 3
    assert count_tokens(df.limit(0), PATH).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        TokenCounter(public_tokenizers.path("word_bpe_49k.json"))


def test_whole_table(spark, library):
    from tessera.llm.queries import op11_token_counts
    from tests.test_queries import DATA

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = op11_token_counts(spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        n = ids(library, texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
