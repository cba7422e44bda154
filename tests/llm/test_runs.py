import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.queries import op12_periodic_runs
from tessera.llm.runs import WORD, digests, find_runs, lyndon_array, periodic_runs, planted
from tests.test_queries import DATA


def brute(w, least, exponent):
    found = set()
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, exponent * p):
                root = w[i : i + length]
                if not any(root[q:] == root[:-q] for q in range(1, p)):
                    found.add((i, length, p))
            i = max(j, i + 1)
    return sorted(found)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=50), st.integers(1, 12))
def test_all_runs(w, k):
    for text in (w, (w[:k] * 12)[:60], w + w[-k:] * 4 + w[:3]):
        for least, exponent in ((2, 2), (6, 4), (1, 3)):
            assert find_runs(text, least, exponent) == brute(text, least, exponent)


def test_lyndon_array_by_suffixes():
    r = random.Random(3)
    for _ in range(300):
        w = "".join(r.choices("abc", k=r.randint(1, 30)))
        for flip in (False, True):
            order = str.maketrans("abc", "cba") if flip else {}
            suffixes = [w[i:].translate(order) for i in range(len(w))]
            after, match = lyndon_array(w, flip)
            for i, s in enumerate(suffixes):
                j = next((j for j in range(i + 1, len(w)) if suffixes[j] < s), len(w))
                assert after[i] == j
                if j < len(w):
                    assert match[i] == next((k for k in range(len(w) - j) if w[i + k] != w[j + k]), len(w) - j)


class Counted(str):
    seen = 0

    def __eq__(self, other):
        Counted.seen += 1
        return str.__eq__(self, other)

    def __lt__(self, other):
        Counted.seen += 1
        return str.__lt__(self, other)

    __hash__ = str.__hash__


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize(
    "make",
    [
        lambda n: "a" * n,
        lambda n: "ab" * (n // 2),
        fibonacci,
        lambda n: fibonacci(n)[::-1],
        lambda n: "".join("ab"[i.bit_count() & 1] for i in range(n)),
        lambda n: "".join("a" * k + "b" for k in range(int((2 * n) ** 0.5))),
        lambda n: "".join("a" * k + "b" for k in range(int((2 * n) ** 0.5), 0, -1)),
        lambda n: (("a" * 50 + "b") * 5 + "c") * (n // 256),
    ],
)
def test_comparisons_are_linear(make):
    for n in (4_000, 32_000):
        w = [Counted(c) for c in make(n)]
        Counted.seen = 0
        find_runs(w)
        assert Counted.seen <= 14 * len(w)


def test_a_period_is_at_least_twice_in_a_run():
    with pytest.raises(ValueError):
        find_runs("aa", 1, 1)


def test_rows(spark):
    long = "w " * 30_000
    rows = [(None, "a a a a a a"), (1, None), (2, ""), (3, " \n\x0b\x0c\r\t "), (4, "x\x85y"), (5, long), (6, "p q r p q r p q r p q r s s s s s s"), (6, "a b"), (6, "a b")]
    df = spark.createDataFrame([(*r, "q", [1]) for r in rows], "doc_id long, text string, runs string, start array<int>")
    got = {(r.doc_id, r.n_words): ([tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df).collect()}
    assert got[None, 6] == ([(0, 6, 1)], "a")
    assert got[1, 0] == got[2, 0] == got[3, 0] == ([], "")
    assert got[4, 1] == ([], "x\x85y")
    assert got[5, 30_000] == ([(0, 30_000, 1)], "w")
    assert got[6, 18] == ([(0, 12, 3), (12, 6, 1)], "p q r s")
    assert got[6, 2] == ([], "a b")
    assert periodic_runs(df).count() == len(rows) and periodic_runs(df.limit(0)).count() == 0
    figures = {(r.doc_id, r.n_runs): r for r in digests(periodic_runs(df)).collect()}
    assert tuple(figures[6, 2][2:6]) == (0, 12, 3, 4000)
    assert tuple(figures[1, 0][2:6]) == (None,) * 4 and figures[1, 0].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert figures[6, 2].runs_sha256 == hashlib.sha256(b"0,12,3\n12,6,1\n").hexdigest()
    # The longest run; of equal ones the first.
    ties = spark.createDataFrame([(1, "a a a a a a b b b b b b")], "doc_id long, text string")
    assert tuple(digests(periodic_runs(ties)).first()[1:5]) == (2, 0, 6, 1)


def test_words_between_overlapping_runs_are_kept_once(spark):
    r = random.Random(8)
    texts = [" ".join(r.choices("ab", k=r.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in periodic_runs(df, least=2, exponent=2).collect():
        words = texts[row.doc_id].split()
        gone = {i for s, n, p in row.runs for i in range(s + p, s + n)}
        assert row.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op12_periodic_runs(spark, DATA).collect()}
    assert got.keys() == docs.keys()
    made = 0
    for k, text in docs.items():
        words = re.findall(WORD, text or "")
        h, n = zlib.crc32(str(k).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            made += 1
        runs = brute(words, 6, 4) if n < 800 else find_runs(words, 6, 4)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert (got[k].n_runs, got[k].runs_sha256) == (len(runs), hashlib.sha256(lines.encode()).hexdigest())
        assert got[k].collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert made


def test_planting_leaves_null_keys_and_texts(spark):
    df = spark.createDataFrame([(None, "a b"), (7, None), (8, "")] + [(i, None) for i in range(40)], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in planted(df).collect()} == {(r.doc_id, r.text) for r in df.collect()}
