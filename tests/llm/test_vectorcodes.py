import hashlib
import math

import numpy as np
import pytest

from tessera.llm.queries import op13_vector_codes
from tessera.llm.vectorcodes import encode, nearest_entries, with_label_error
from tests.test_queries import DATA


def plain(rows, parts=4, entries=256, rounds=4):
    """(vec_id, label) -> code, error; and the digest: whole distances to every entry, in Python's own integers."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    start = sorted({i: v for i, v, _ in kept if i is not None}.items())[:entries]
    books = [[cut(v, p) for _, v in start] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [tuple(sum(c) // len(groups[e]) for c in zip(*groups[e])) if e in groups else old for e, old in enumerate(books[p])]
    out = []
    for i, v, lab in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), lab))
    text = ",".join(str(x) for book in books for c in book for x in c)
    return out, hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("entries,dims,spread", [(1, 1, 5), (7, 3, 2), (256, 16, 300), (40, 5, 3), (256, 1, 9)])
def test_nearest_entry_equals_all_distances(entries, dims, spread):
    r = np.random.default_rng(entries + dims)
    x, book = r.integers(-spread, spread, (2500, dims)), r.integers(-spread, spread, (entries, dims))
    book[entries // 2] = book[0]
    all_of_them = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    index, distance = nearest_entries(x, book)
    assert (index == all_of_them.argmin(axis=1)).all() and (distance == all_of_them.min(axis=1)).all()


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want, digest = plain(rows)
    total = {}
    for _, _, e, lab in want:
        total[lab] = total.get(lab, 0) + e
    got = sorted(tuple(r) for r in op13_vector_codes(spark, DATA).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == sorted((i, c, e, total[lab], digest) for i, c, e, lab in want)


def test_nulls_ties_and_repeated_rows(spark):
    names = ["row", "v", "codes", "_l", "_s", "label_error"]
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.5, 0.25, 0.1], 7), (1, [0.5, -0.5, 0.25, 0.1], 7), (2, None, 7), (3, [1.0, None, 0.0, 0.0], 7), (4, [nan, 0.0, 0.0, 0.0], None), (5, [inf, 0.0, 0.0, 0.0], None)]
    rows += [(6, [0.0, 0.0, 0.0, -0.0001], None), (None, [0.5, 0.5, 0.5, 0.5], None), (8, [0.5, -0.5, 0.25, 0.1], 9), (9, [0.0, 0.0, 0.0, 0.0], None)]
    schema = "vec_id long, embedding array<double>, label int, " + ", ".join(f"`{n}` string" for n in names)
    df = spark.createDataFrame([(*r, *("q" for _ in names)) for r in rows], schema)
    coded = encode(df, entries=3)
    assert coded.columns == [*df.columns, "_codes"]
    want, digest = plain(rows, entries=3)
    got = with_label_error(coded, codes="_codes")
    assert got.columns == [*coded.columns, "_label_error"]
    total = {}
    for _, _, e, lab in want:
        total[lab] = total.get(lab, 0) + e
    key = lambda r: (str(r[0]), r[1], str(r[3]))
    rows = [(r.vec_id, r._codes.code, r._codes.error, r.label, r._label_error, r._codes.codebooks_sha256, r.row) for r in got.collect()]
    assert sorted(rows, key=key) == sorted(((*w, total[w[3]], digest, "q") for w in want), key=key)


def test_empty_tables_and_other_dimensions(spark):
    df = spark.createDataFrame([(1, [1.0] * 4, 1), (2, [2.0] * 4, 1), (3, [1.0] * 8, 1), (4, [1.0] * 3, 1), (5, [], 1)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.codes.code, r.codes.error, r.codes.dimension) for r in encode(df).collect()}
    assert got == {1: ("00000000", 0, 4), 2: ("01010101", 0, 4), 3: ("00000000", 0, 8)}
    for none in (df.limit(0), df.where("vec_id > 3"), df.withColumn("vec_id", df.vec_id * None)):
        assert with_label_error(encode(none)).collect() == []


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e9] * 4, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="too large"):
        encode(df).collect()
    with pytest.raises(ValueError):
        encode(df, entries=257)
