import random

from tessera.llm.decontaminate import Matcher, myers, normalise, places


def distances(p, t):
    col = list(range(len(p) + 1))
    best, end = col[-1], 0
    for j, c in enumerate(t, 1):
        new = [0]
        for i, x in enumerate(p, 1):
            new.append(min(col[i] + 1, new[i - 1] + 1, col[i - 1] + (x != c)))
        col = new
        if col[-1] < best:
            best, end = col[-1], j
    return best, end


def test_myers_equals_dynamic_programming():
    r = random.Random(1)
    for _ in range(400):
        p = "".join(r.choices("abc ", k=r.randint(1, 80)))
        t = "".join(r.choices("abc ", k=r.randint(0, 120)))
        assert myers(p, t) == distances(p, t)


def test_places_map_back():
    t = "  Ab, c_d\n--É1 "
    assert normalise(t) == "ab c d é1"
    assert [t[i].lower() for i, c in zip(places(t), normalise(t)) if c != " "] == list("abcdé1")


def test_every_item_within_its_budget_is_found():
    r = random.Random(2)
    words = ["".join(r.choices("abcdef", k=r.randint(1, 6))) for _ in range(60)]
    items = [(i, " ".join(r.choices(words, k=r.randint(5, 30)))) for i in range(30)]
    m = Matcher(items, 0.08)
    for _ in range(60):
        i, t = r.choice(items)
        text = list(t)
        for _ in range(r.randint(0, m.budget[i] + 2)):
            j = r.randrange(len(text))
            r.choice([lambda: text.pop(j), lambda: text.insert(j, "x"), lambda: text.__setitem__(j, "y")])()
        doc = " ".join(r.choices(words, k=20)) + " " + "".join(text) + " " + " ".join(r.choices(words, k=20))
        got = {n: (d, e) for n, d, _, e in m.search(doc)}
        want = {n: distances(p, doc) for n, (_, p) in enumerate(items)}
        assert {n: d for n, (d, _) in got.items()} == {n: d for n, (d, _) in want.items() if d <= m.budget[n]}
        assert m.any(doc) == bool(got)
        for n, d, a, b in m.search(doc):
            assert distances(items[n][1], doc[a:b])[0] <= d


def test_frames(spark):
    from tessera.llm.decontaminate import clean, contaminated

    item = "The quick brown fox jumps over the lazy dog near the river bank"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "Well. " + item.upper() + "!!", "x"), (1, "Well. " + item.upper() + "!!", "x"), (2, None, "x"), (3, "", None), (None, item.replace("lazy", "lazzy"), "y"), (5, "nothing here", "z")],
        "doc_id long, text string, item_id string",
    )
    for limit in (8_000_000, 40):
        rows = contaminated(docs, bench, block_chars=limit).collect()
        found = sorted((r.doc_id or -1, r.item_id, r.distance, r.start, r.end) for r in rows)
        n = len(item)
        assert found == [(-1, 1, 1, 0, n + 1), (1, 1, 0, 6, n + 6), (1, 1, 0, 6, n + 6)]
        assert sorted(r.doc_id for r in clean(docs, bench, block_chars=limit).collect()) == [2, 3, 5]
    assert contaminated(docs.limit(0), bench).count() == 0
    assert clean(docs, bench.limit(0)).count() == 6
