import random
import re

import numpy as np
import xxhash

from tessera.llm import simhash
from tessera.llm.base import connected_components


def ref(text, n=3):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    grams = [" ".join(w)] if len(w) < n else [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, edges):
    root = list(range(n))
    for _ in range(n):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_fingerprint_matches_definition():
    r = random.Random(0)
    texts = [None, "", " \t\n", "one", "One two", "ONE two\x0bthree É", "a b c d e"] + [" ".join(r.choices("ab c dé F g".split(), k=r.randint(1, 50))) for _ in range(50)] + ["w x " * 9000]
    for t in texts:
        assert simhash.simhash64(t, 3) % (1 << 64) == ref(t)


def test_links_connect_exactly_the_ball_graph(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base[:25]:
        for _ in range(12):
            x = b
            for _ in range(r.randint(1, 5)):
                x ^= 1 << r.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    want = components(len(prints), near)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    place = {x: i for i, x in enumerate(signed)}
    found = {place[x.node]: place[x.root] for x in connected_components(simhash.links(df)).collect()}
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(found.get(i, i), set()).add(i)
    expected = {}
    for i, w in enumerate(want):
        expected.setdefault(w, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 150)}


def test_near_duplicates_and_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(3, text), (5, text), (4, text.upper()), (4, text.upper()), (9, None), (None, ""), (8, "   "), (2, "alone in here"), (None, "only null here"), (2, "other text of two")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, fp string")
    out = {}
    for r in simhash.near_duplicates(docs).collect():
        assert len(r.fingerprint) == 16
        out.setdefault((r.doc_id, r.component_id), 0)
        out[(r.doc_id, r.component_id)] += 1
    assert out == {(3, 3): 1, (5, 3): 1, (4, 3): 2, (9, 8): 1, (None, 8): 1, (8, 8): 1, (2, 2): 2, (None, None): 1}
    kept = sorted(((r.doc_id or -1), r.text) for r in simhash.keep_one(docs).collect())
    assert kept == [(-1, "only null here"), (2, "alone in here"), (2, "other text of two"), (3, text), (8, "   ")]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0
