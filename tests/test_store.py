"""Cascades over a store of several sites, broken off after every step and resumed."""

import pytest

from tessera.sources import store

TABLES = ("connections", "census", "census_terms", "anomalies", "census_windows", "content_probe", "articles", "lotes", "extraidas", "anotaciones", "own_table")


def fill(spark, root, sites=(1, 2, 3)):
    rows = [(s, k) for s in sites for k in range(4)]
    for t in TABLES:
        store.write(spark.createDataFrame(rows, "connection_id int, k int"), root, t)


def state(spark, root):
    return {t: sorted(f for f in store.children(spark, f"{root}/{t}") if f.startswith("connection_id=")) for t in TABLES}


def folders(*sites):
    return [f"connection_id={s}" for s in sites]


def broken_after(monkeypatch, n):
    """store.remove and store.rename fail at their n-th call."""
    left = [n]
    for name in ("remove", "rename"):

        def f(*a, whole=getattr(store, name)):
            left[0] -= 1
            if left[0] < 0:
                raise OSError("broken off")
            return whole(*a)

        monkeypatch.setattr(store, name, f)


def test_a_site_goes_with_all_that_hangs_on_it(spark, tmp_path):
    root = str(tmp_path)
    fill(spark, root)
    store.delete_site(spark, root, 2)
    assert state(spark, root) == {t: folders(1, 3) for t in TABLES} and store.sites(spark, root) == [1, 3]
    store.delete_site(spark, root, 9)
    assert store.sites(spark, root) == [1, 3]
    # Rubbish of a site that is no longer there goes with the last site.
    store.write(spark.createDataFrame([(7, 0)], "connection_id int, k int"), root, "articles")
    store.delete_site(spark, root, 1)
    assert state(spark, root)["articles"] == folders(3, 7)
    store.delete_site(spark, root, 3)
    assert all(store.children(spark, f"{root}/{t}") == [] for t in TABLES) and store.children(spark, f"{root}/_pending") == []


@pytest.mark.parametrize("step", [0, 3, 7, 14, 15, 16])
def test_a_broken_deletion_is_resumed(spark, tmp_path, step):
    root = str(tmp_path)
    fill(spark, root, (1,) if step == 16 else (1, 2))
    with pytest.MonkeyPatch.context() as m:
        broken_after(m, step)
        with pytest.raises(OSError, match="broken off"):
            store.delete_site(spark, root, 1)
    # The site itself goes after what hangs on it.
    if state(spark, root)["connections"] == folders(2):
        assert all(x == folders(2) for t, x in state(spark, root).items())
    assert store.resume(spark, root) == ["delete-1"] and store.resume(spark, root) == []
    assert state(spark, root) == {t: folders(2) if step != 16 else [] for t in TABLES}


def test_clearing_for_a_new_census(spark, tmp_path):
    root = str(tmp_path)
    fill(spark, root, (1, 2))
    with pytest.MonkeyPatch.context() as m:
        broken_after(m, 2)
        with pytest.raises(OSError):
            store.clear_census(spark, root, 1)
    assert store.resume(spark, root) == ["clear-1"]
    assert state(spark, root) == {t: folders(2) if t in store.CENSUS else folders(1, 2) for t in TABLES}
    again = spark.createDataFrame([(1, 9)], "connection_id int, k int")
    store.write(again, root, "census")
    assert {(r.connection_id, r.k) for r in spark.read.parquet(f"{root}/census").collect()} == {(1, 9), *((2, k) for k in range(4))}


@pytest.mark.parametrize("step", [None, 0, 1, 2])
def test_compaction(spark, tmp_path, step):
    root = str(tmp_path)
    rows = spark.range(100).selectExpr("cast(id % 2 as int) AS connection_id", "id AS k").repartition(8)
    store.write(rows, root, "census")
    folder = f"{root}/census/connection_id=1"
    many = [f for f in store.children(spark, folder) if f.endswith(".parquet")]
    assert len(many) > 1
    if step is None:
        assert store.compact(spark, root, "census", 1)
    else:
        with pytest.MonkeyPatch.context() as m:
            broken_after(m, step)
            with pytest.raises(OSError):
                store.compact(spark, root, "census", 1)
        assert store.resume(spark, root) == ["compact-census-1"]
    assert len([f for f in store.children(spark, folder) if f.endswith(".parquet")]) == 1
    assert sorted(r.k for r in spark.read.parquet(f"{root}/census").where("connection_id = 1").collect()) == list(range(1, 100, 2))
    assert not store.compact(spark, root, "census", 1) and not store.compact(spark, root, "none", 1)
    assert store.children(spark, f"{root}/_pending") == []
