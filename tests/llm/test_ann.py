import os

import numpy as np
import pytest

from tessera.llm.ann import Settings, nearest


def brute(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = np.einsum("ij,j->i", x, x[i])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def run(spark, ids, x, k, settings):
    df = spark.createDataFrame([(int(i), [float(c) for c in v], "x") for i, v in zip(ids, x)], "vec_id long, embedding array<double>, score string")
    rows = nearest(df, df.where("vec_id % 20 = 0"), k, settings).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_scores(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(1500, 32)) * r.uniform(0.5, 2, size=(1500, 1))
    ids = np.arange(1500)
    want = brute(ids, x, 20)
    got = run(spark, ids, x, 20, Settings(block_rows=600))
    assert got.keys() == want.keys()
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9
    for q, rows in got.items():
        assert len(rows) == 20
        for v, s in rows:
            assert s == np.einsum("ij,j->i", x[[v]], x[q])[0]
        assert rows == sorted(rows, key=lambda p: (-p[1], p[0]))


def test_ties_few_rows_and_unusable_vectors(spark):
    x = np.array([[1.0, 0.0]] * 30 + [[0.0, 1.0]])
    got = run(spark, np.arange(31), x, 20, Settings())
    assert [v for v, _ in got[0]] == list(range(1, 21)) and [v for v, _ in got[20]] == list(range(20))
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [3.0, 1.0]), (None, [1.0, 1.0]), (20, [1.0]), (40, []), (0, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in nearest(df, df.where("vec_id % 20 = 0")).collect()] == [(0, 1, 6, 5.0)]
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def test_recall_by_verified_share():
    from tessera.llm.ann import Block

    r = np.random.default_rng(3)
    x = r.normal(size=(4000, 32)) + 3 * r.normal(size=(40, 32))[r.integers(0, 40, 4000)]
    block, found, share = Block(np.arange(4000), x, float(np.linalg.norm(x, axis=1).max()), Settings()), [], []
    for i in range(0, 4000, 100):
        rows = block.candidates(x[i], 20)
        near = set(np.argsort(-(x @ x[i]), kind="stable")[:20].tolist())
        found.append(len(near & set(rows.tolist())) / 20)
        share.append(len(rows) / 4000)
    assert np.mean(found) >= 0.9 and np.mean(share) <= 0.35


def test_counts_grow_with_the_windows(spark):
    from tessera.llm.ann import Block

    x = np.random.default_rng(1).normal(size=(300, 8))
    block = Block(np.arange(300), x, float(np.linalg.norm(x, axis=1).max()), Settings(verified=1.0))
    # All windows end up holding everything, and each row has then been counted once for each array.
    assert len(block.candidates(x[0], 1000)) == 300


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_given_tables(spark, sf):
    from tessera.llm.queries import op4_ann

    at = f"/root/testdata/{sf}"
    if not os.path.isdir(at):
        pytest.skip("no test tables")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect() if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding) and any(r.embedding)]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    want, got = brute(ids, x, 20), {}
    for r in op4_ann(spark, at).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert got.keys() == want.keys()
    assert np.mean([len(got[q] & {v for v, _ in want[q]}) / len(want[q]) for q in want]) >= 0.93


def test_results_depend_on_settings_alone(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(900, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    once = lambda d: sorted(tuple(r) for r in nearest(d, d.where("vec_id % 20 = 0"), 5, Settings(block_rows=200)).collect())
    assert once(df.repartition(3)) == once(df.orderBy("vec_id", ascending=False).coalesce(1))


def test_few_passes_find_the_rows_of_round_after_round(monkeypatch):
    """Candidates are those of widening from the first window on, in about two passes over a block for each query."""
    from tessera.llm.ann import Block

    r, s, passes = np.random.default_rng(5), Settings(), []
    x = r.normal(size=(700, 24)) + 2 * r.normal(size=(9, 24))[r.integers(0, 9, 700)]
    block, once = Block(np.arange(700), x, float(np.linalg.norm(x, axis=1).max()), s), Block._collisions
    monkeypatch.setattr(Block, "_collisions", lambda *a: passes.append(1) or once(*a))
    lift = np.sqrt(np.maximum(block.norm**2 - (x**2).sum(axis=1), 0))
    p = x @ block.directions[:, :-1].T + lift[:, None] * block.directions[:, -1]
    wanted = int(s.verified * 700) + s.spare * 20
    for i in range(0, 700, 7):
        away, half = np.abs(p - block.directions[:, :-1] @ (x[i] * block.norm / np.linalg.norm(x[i]))), s.width * block.scale
        while np.count_nonzero((away <= half).sum(axis=1) >= s.collisions) < wanted:
            half *= s.widen
        count = (away <= half).sum(axis=1)
        assert block.candidates(x[i], 20).tolist() == np.flatnonzero(count >= max(s.collisions, np.sort(count)[-wanted])).tolist()
    assert len(passes) <= 3 * 100
