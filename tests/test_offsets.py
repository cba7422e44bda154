"""Places after cuts and back, by random cuts of texts of distinct characters."""

import random

from tessera.operators import offsets


def test_round_trip_of_random_cuts(spark):
    r = random.Random(4)
    texts, cuts, spans = {}, [], []
    for k in range(150):
        n = r.randint(0, 40)
        texts[k] = "".join(chr(0x4E00 + i) for i in range(n))
        for _ in range(r.randint(0, 5)):
            a = r.randint(0, n)
            cuts.append((k, a, min(n, a + r.randint(0, 8))))
        for i in range(r.randint(0, 6)):
            a = r.randint(0, n)
            spans.append((k, i, a, r.randint(a, n)))
    c = spark.createDataFrame(cuts, "k int, ini int, fin int")
    s = spark.createDataFrame(spans, "k int, i int, ini int, fin int")
    short = {x.k: x.parrafo for x in offsets.without_cuts(spark.createDataFrame(list(texts.items()), "k int, parrafo string"), c, ["k"]).collect()}
    gone = {k: {p for q, a, b in cuts if q == k for p in range(a, b)} for k in texts}
    assert short == {k: "".join(x for p, x in enumerate(t) if p not in gone[k]) for k, t in texts.items()}
    after = offsets.after_cuts(s, c, ["k"])
    rows = {(x.k, x.i): (x.ini, x.fin) for x in after.collect()}
    for k, i, a, b in spans:
        left = "".join(texts[k][p] for p in range(a, b) if p not in gone[k])
        assert ((k, i) in rows) == bool(left or a == b)
        if (k, i) in rows:
            x, y = rows[k, i]
            assert short[k][x:y] == left
    back = {(x.k, x.i): (x.ini, x.fin) for x in offsets.before_cuts(after, c, ["k"]).collect()}
    where = {(k, i): (a, b) for k, i, a, b in spans}
    for (k, i), (x, y) in rows.items():
        if y > x:
            a, b = back[k, i]
            kept = [p for p in range(*where[k, i]) if p not in gone[k]]
            assert (a, b) == (kept[0], kept[-1] + 1)


def test_a_label_taken_off(spark):
    spans = spark.createDataFrame([(1, 0, 0, 3, "Ana"), (1, 1, 2, 4, "no"), (2, 0, 5, 6, "x")], "wp_id long, pi int, ini int, fin int, texto string")
    bases = spark.createDataFrame([(1, 0, 9), (2, 0, 0)], "wp_id long, pi int, base int")
    got = offsets.back_to_paragraph(spans, bases, ["wp_id", "pi"])
    assert got.schema == spans.schema and sorted(tuple(r) for r in got.collect()) == [(1, 0, 9, 12, "Ana"), (1, 1, 2, 4, "no"), (2, 0, 5, 6, "x")]
