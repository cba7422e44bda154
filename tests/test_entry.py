import os

import pytest

import __spark_entry__ as entry


def test_every_twin_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 180


@pytest.mark.skipif(not os.path.isdir(entry.SMOKE), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["anio", "n"]
