import hashlib
import random

import numpy as np

from tessera.llm import substrings as S


def brute(texts, size):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for raw in raws:
        for p in range(len(raw) - size + 1):
            seen[raw[p : p + size]] = seen.get(raw[p : p + size], 0) + 1
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - size + 1):
            if seen[raw[p : p + size]] > 1:
                gone[p : p + size] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 7)))
    passage = " ".join(word() for _ in range(150))
    texts = [" ".join(word() for _ in range(r.randint(0, 400))) for _ in range(30)]
    for i in range(0, 30, 2):
        a = r.randint(0, 300)
        cut = r.randint(0, len(texts[i]))
        texts[i] = texts[i][:cut] + passage[a : a + r.randint(100, 900)] + texts[i][cut:]
    texts += [texts[3], texts[3], texts[4] + "x", "y" + texts[5], passage, "ab" * 700, "z" * 401, "z" * 399, None, "", "q" * 400]
    return texts


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, "h", 1) for i, t in enumerate(texts)], "doc_id long, text string, h string, p int")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in S.remove_duplicates(docs).collect()}
    want = brute(texts, 400)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[1] for w in want) > 0


def test_equals_brute_force(spark):
    check(spark, corpus(1))


def test_spread_anchors(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_TOGETHER", 2)
    monkeypatch.setattr(S, "SHARD_BYTES", 5000)
    check(spark, corpus(2))


def test_suffix_array_and_common_prefixes():
    r = np.random.default_rng(0)
    for size in (16, 20, 31, 64):
        data = r.integers(97, 99, 900).astype(np.uint8)
        data[300:420] = data[100:220]
        data[600:700] = 97
        end = np.repeat([450, 900], 450)
        sa = S.suffix_array(data, end, size)
        raw = data.tobytes()
        rows = {p: raw[p : p + size] for p in range(900) if p + size <= end[p]}
        seen = list(rows.values())
        assert sorted(sa) == [p for p, x in rows.items() if seen.count(x) > 1]
        assert [rows[p] for p in sa] == sorted(rows[p] for p in sa)
        lcp = S.kasai(data, end, sa)
        for i in range(1, len(sa)):
            a, b = raw[sa[i - 1] : end[sa[i - 1]]], raw[sa[i] : end[sa[i]]]
            want = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[i] == want, (i, lcp[i], want)


def test_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "k" * 500), (1, "k" * 500), (None, "".join(map(str, range(500)))), (None, None)], "doc_id long, text string")
    rows = sorted(((x.doc_id or 0, x.n_removed) for x in S.remove_duplicates(docs).collect()))
    assert rows == [(0, 0), (0, 0), (1, 500), (1, 500)]
    assert S.remove_duplicates(docs.limit(0)).count() == 0
