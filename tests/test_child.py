"""A child process that crashes, hangs and babbles loses and doubles no document."""

import json
import os
import re
import sys

import pytest

from tessera.sources.child import Child, Model, Refused, answers, available, extract

STUB = os.path.join(os.path.dirname(__file__), "stub_child.py")


def model(folder, crash=0, hang=0, junk=0, gliner="stub", **limits):
    return Model((sys.executable, "-u", STUB, str(folder), str(crash), str(hang), str(junk)), (("gliner", gliner),), json.dumps({"predicado": "dirige"}), **limits)


def docs(spark, n=40):
    rows = [(k, p, f"Ana{k} y Bea{p} hablan" if k % 3 else "nada aquí") for k in range(n) for p in (1, 0)]
    return spark.createDataFrame([*rows, (100, 0, None), (None, 0, "Eva")], "wp_id long, pi int, parrafo string")


def check(found, n=40):
    rows = found.collect()
    assert sorted(r.wp_id for r in rows) == [*range(n), 100]
    for r in rows:
        assert r.error is None
        want = [(p, m.start(), m.end(), m[0]) for p in (0, 1) for m in re.finditer(r"[A-Z]\w+", f"Ana{r.wp_id} y Bea{p} hablan")] if r.wp_id % 3 and r.wp_id < n else []
        assert [(e.pi, e.ini, e.fin, e.texto) for e in r.entidades] == want
        assert [(x.pi, x.a, x.b) for x in r.relaciones] == [(p, f"Ana{r.wp_id}", f"Bea{p}") for p in (0, 1)] * bool(want)
    return rows


# The failures are counted over all children together, so one document may meet several in a row: tries are plenty.
@pytest.mark.parametrize("crash, hang, junk", [(0, 0, 0), (7, 0, 0), (0, 13, 0), (5, 0, 4)])
def test_no_document_is_lost_or_doubled(spark, tmp_path, crash, hang, junk):
    found = extract(docs(spark).repartition(3, "wp_id"), model(tmp_path, crash, hang, junk, answer_seconds=3.0, tries=40)).cache()
    rows = check(found)
    starts = len([f for f in os.listdir(tmp_path) if f.startswith("start")])
    again = sum(r.intentos - 1 for r in rows)
    # One child for each task that has documents, and one more for each failure.
    assert again <= starts <= again + 5 and (again > 0) == bool(crash or hang or junk)
    found.unpersist()


def test_a_document_that_kills_every_child_fails_alone(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "Ana"), (2, 0, "POISON"), (3, 0, "Bea y Luz"), (4, 0, "REFUSE")], "wp_id long, pi int, parrafo string").coalesce(1)
    found = extract(df, model(tmp_path, tries=2)).cache()
    ents, rels, failed = answers(found)
    assert {(r.wp_id, r.texto) for r in ents.collect()} == {(1, "Ana"), (3, "Bea"), (3, "Luz")}
    assert [(r.wp_id, r.a, r.b, r.predicado) for r in rels.collect()] == [(3, "Bea", "Luz", "dirige")]
    assert {r.wp_id: (r.intentos, r.error) for r in failed.collect()} == {2: (2, "the child ended with 4"), 4: (1, "refused text")}
    found.unpersist()


def test_loading_and_listing(tmp_path):
    assert available(model(tmp_path))["spacy"] == ["es"]
    with pytest.raises(Refused, match="no such model"):
        Child(model(tmp_path, gliner="other"))


def test_no_rows_start_no_child(spark, tmp_path):
    assert extract(docs(spark).limit(0), model(tmp_path)).count() == 0
    assert os.listdir(tmp_path) == []
