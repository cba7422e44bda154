"""The chain of a micro-batch, broken off after each of its tables in turn."""

import json
import os
import sys

import pytest
from pyspark.sql import functions as F

from tessera.sources.child import Model, extract
from tessera.streaming.extraction import TABLES, extraction_stream, stored

STUB = os.path.join(os.path.dirname(__file__), "stub_child.py")


def fetch(ids):
    assert len(ids) <= 40
    texts = {3: "", 4: "<p>REFUSE</p>"}
    return [{"wp_id": i, "html": texts.get(i, f"<p>Ana{i} ve a Bea{i}</p><p>Nada</p>")} for i in ids if i != 5]


def annotator(folder):
    model = Model((sys.executable, "-u", STUB, str(folder), "0", "0", "0"), (("gliner", "stub"),), json.dumps({"predicado": "dirige"}))
    return lambda p: extract(p, model)


def queue(spark, at, batches):
    for i, ids in enumerate(batches):
        spark.createDataFrame([(x,) for x in ids], "wp_id long").coalesce(1).write.mode("append").parquet(f"{at}/in")
        # File streams take files in order of time.
        for f in os.listdir(f"{at}/in"):
            if f.endswith(".parquet") and os.stat(f"{at}/in/{f}").st_mtime > 1e9:
                os.utime(f"{at}/in/{f}", (i + 1, i + 1))
    return spark.readStream.schema("wp_id long").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")


def run(spark, at, stream, after=lambda table, batch: None):
    q = extraction_stream(stream, f"{at}/out", f"{at}/cp", fetch, annotator(at), after)
    try:
        q.awaitTermination(300)
    except Exception as e:
        return str(e)
    return None


def tables(spark, at):
    return {t: sorted(tuple(r) for r in stored(spark, f"{at}/out", t).collect()) for t in TABLES}


BATCHES = [[1, 2, 3, 4, 5, None, 2], [2, 6, 4, 7]]


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("whole")
    assert run(spark, at, queue(spark, at, BATCHES)) is None
    return tables(spark, at)


def test_the_chain(whole):
    assert [(w, r) for w, r in whole["hechos"]] == [(1, "extraido"), (2, "extraido"), (3, "sin cuerpo"), (5, "sin cuerpo"), (6, "extraido"), (7, "extraido")]
    assert {r[0] for r in whole["fallos"]} == {4} and len(whole["fallos"]) == 2
    assert [r[0] for r in whole["bodies"]] == [1, 2, 3, 4, 6, 7]
    assert [r[:5] for r in whole["entidades"] if r[0] == 6] == [(6, 0, 0, 4, "Ana6"), (6, 0, 10, 14, "Bea6"), (6, 1, 0, 4, "Nada")]
    assert [r[:4] for r in whole["relaciones"]] == [(k, 0, f"Ana{k}", f"Bea{k}") for k in (1, 2, 6, 7)]


@pytest.mark.parametrize("table", ["bodies", "relaciones", "hechos"])
def test_broken_off_after_a_table(spark, tmp_path, whole, table):
    broken = []

    def after(t, batch):
        if (t, batch) not in broken and t == table:
            broken.append((t, batch))
            raise RuntimeError(f"broken off after {t}")

    stream = queue(spark, tmp_path, BATCHES)
    for k in range(2):
        assert f"broken off after {table}" in run(spark, tmp_path, stream, after)
    assert run(spark, tmp_path, stream, after) is None
    assert broken == [(table, 0), (table, 1)]
    assert tables(spark, tmp_path) == whole
    # Nothing new: nothing happens.
    assert run(spark, tmp_path, stream) is None and tables(spark, tmp_path) == whole


def test_articles_that_failed_come_again_in_another_run(spark, tmp_path, whole):
    assert run(spark, tmp_path, queue(spark, tmp_path, BATCHES)) is None
    spark.createDataFrame([(4,), (1,)], "wp_id long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert run(spark, tmp_path, spark.readStream.schema("wp_id long").parquet(f"{tmp_path}/in")) is None
    assert stored(spark, f"{tmp_path}/out", "fallos").agg(F.count("*").alias("n")).first().n == 3
    assert tables(spark, tmp_path)["hechos"] == whole["hechos"]
