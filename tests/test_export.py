"""The training set, what is left out of it, and the writer that writes all or nothing."""

import hashlib
import json
import os
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions.vocabulary import TYPES, predicates
from tessera.operators import training
from tessera.sources.export import REPORT, TrainingExport, write_export

ENT, REL = "array<struct<i:int,ini:int,fin:int,tipo:string,texto:string>>", "array<struct<a:int,b:int,predicado:string,cuando:string>>"
ROWS = f"wp_id long, pi int, parrafo string, entidades {ENT}, relaciones {REL}, fuente string, conjunto string, estrato string"
TEXT = "Ana Rúa dirige Ecopetrol. Usted no."
ENTS = [(0, 0, 7, "persona", "Ana Rúa"), (1, 15, 24, "organizacion", "Ecopetrol"), (2, 0, 3, "persona", "Ana")]
TIES = [(0, 1, "dirige", "vigente"), (2, 1, "parte de", "pasada")]


@pytest.fixture(scope="module")
def rows(spark):
    bad = [*ENTS, (3, 26, 31, "persona", "Usted"), (4, 90, 95, "persona", "Fuera"), (5, 15, 24, None, "Ecopetrol"), (6, 32, 34, "monto", "no")]
    ties = [*TIES, (0, 3, "familiar de", "vigente"), (0, 2, "familiar de", "vigente"), (0, 1, "no hay", "vigente"), (1, 0, "dirige", "vigente")]
    data = [(1, 0, TEXT, ENTS, TIES, "plata", "train", "F"), (1, 1, TEXT, bad, ties, "plata", "val", "R"), (2, 0, TEXT, ENTS, TIES, "plata", "train", "F"), (2, 0, TEXT, ENTS, TIES[:1], "oro", None, None)]
    data += [(3, 0, TEXT, ENTS, TIES, "oro", "train", None), (4, 0, TEXT, ENTS, TIES, "plata", "train", None), (4, 1, TEXT, ENTS, TIES, "oro", "train", None), (5, 0, TEXT, ENTS, TIES, "sintetico", None, None)]
    data += [(6, k, "Nada aquí.", [], [], "plata", "train", "R") for k in range(40)]
    return spark.createDataFrame(data, ROWS)


@pytest.fixture(scope="module")
def ids(spark):
    return lambda *k: spark.createDataFrame([(x,) for x in k], "wp_id long")


def test_what_is_left_out(spark, rows):
    got = {(r.wp_id, r.motivo): r.n for r in training.discards(rows.where("fuente = 'plata' and pi = 1 or wp_id = 6"), predicates(spark)).groupBy("wp_id", "motivo").agg(F.sum("n").alias("n")).collect()}
    want = {"pronombre": 1, "fuera_de_rango": 1, "tipo_fuera": 1, "monto_sin_cifra": 1, "solape_mismo_tipo": 1, "rel_sin_extremo": 2, "rel_predicado_fuera": 1, "rel_tipos_no_admitidos": 2}
    assert got == {(1, k): v for k, v in want.items()} | {(6, "sin_entidades"): 40}


def test_sets(spark, rows, ids):
    made = training.training_set(rows, predicates(spark), ids(3), ids(4))
    got = {(r.wp_id, r.pi, r.fuente): r for r in made.where("wp_id < 6").collect()}
    assert {k: r.conjunto for k, r in got.items()} == {
        (1, 0, "plata"): "train",
        (1, 1, "plata"): "val",
        (2, 0, "plata"): None,
        (2, 0, "oro"): "train",
        (3, 0, "oro"): "apartado",
        (4, 0, "plata"): None,
        (4, 1, "oro"): "prueba",
        (5, 0, "sintetico"): "train",
    }
    first = got[1, 0, "plata"]
    assert first.fichas[:3] == ["Ana", "Rúa", "dirige"] and [tuple(n) for n in first.ner] == [(3, 3, "organizacion"), (0, 1, "persona")]
    assert [tuple(p) for p in first.pares] == [(1, 0, "dirige"), (1, 0, "miembro de")] and first.cuando == ["vigente", "pasada"]
    assert first.descartes == {"solape_mismo_tipo": 1, "parte_de_a_miembro_de": 1}
    # Only what a model said is put right: synthetic rows keep their predicate, which persons do not admit.
    assert [tuple(p) for p in got[5, 0, "sintetico"].pares] == [(1, 0, "dirige")]
    assert got[2, 0, "plata"].descartes == {"plata_pisada_por_oro": 1} and got[4, 0, "plata"].descartes == {"plata_en_prueba_fuera": 1}
    empty = made.where("wp_id = 6").collect()
    assert len(empty) == 40 and 1 <= sum(r.conjunto is not None for r in empty) <= 20
    with pytest.raises(Exception, match="held-out paragraph 1/0 in plata"):
        training.training_set(rows, predicates(spark), ids(1), ids()).collect()
    assert training.training_set(rows.limit(0), predicates(spark), ids(), ids()).count() == 0


def files_of(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def test_export_and_its_report(spark, rows, ids, tmp_path):
    made = training.training_set(rows, predicates(spark), ids(3), ids(4))
    reports = []
    for k, parts in enumerate((1, 5)):
        path = str(tmp_path / f"out{k}")
        write_export(made.repartition(parts), path, TYPES)
        with open(f"{path}/{REPORT}", encoding="utf-8") as f:
            reports.append(json.load(f))
        assert not [f for f in files_of(path) if "_tmp" in f]
    assert reports[0] == reports[1]
    lines, metas = {}, {}
    for f in files_of(path):
        if f.endswith(".jsonl"):
            side, name = (metas if f.endswith(".meta.jsonl") else lines), f.split("/")[0]
            with open(f"{path}/{f}", encoding="utf-8") as h:
                side.setdefault(name, []).extend(h.read().splitlines())
    r = reports[0]
    assert r["ejemplos"] == {k: len(v) for k, v in sorted(lines.items())} == {k: len(v) for k, v in sorted(metas.items())}
    assert r["ejemplos"]["apartado"] == r["ejemplos"]["prueba"] == r["ejemplos"]["val"] == 1
    for name, each in lines.items():
        assert r["huellas"][name] == f"{sum(int(hashlib.sha256(x.encode()).hexdigest(), 16) for x in each) % 2**256:064x}"
    examples = [json.loads(x) for each in lines.values() for x in each]
    sizes = sorted(len(x["tokenized_text"]) for x in examples)
    assert r["fichas_por_ejemplo"] == {"mediana": statistics.median(sizes), "p95": sizes[int(len(sizes) * 0.95)]}
    assert r["positivos_por_predicado"] == dict(Counter(p[2] for x in examples for p in x["relations"]).most_common())
    assert r["entidades_por_etiqueta"] == dict(Counter(n[2] for x in examples for n in x["ner"]).most_common()) and TYPES["persona"] in r["entidades_por_etiqueta"]
    assert r["descartes"]["plata_pisada_por_oro"] == r["descartes"]["plata_en_prueba_fuera"] == 1 and r["descartes"]["sin_entidades"] == 40
    # Lines of both files are about the same paragraph.
    for e, m in zip(lines["val"], metas["val"]):
        assert json.loads(m)["wp_id"] == 1 and json.loads(e)["tokenized_text"][0] == "Ana"
    with pytest.raises(Exception, match="has an export already"):
        write_export(made, path)


def test_a_failed_job_leaves_nothing(spark, rows, ids, tmp_path):
    made = training.training_set(rows, predicates(spark), ids(3), ids(4))
    path = str(tmp_path / "broken")
    bad = F.when(F.col("wp_id") == 5, F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.col("parrafo"))
    with pytest.raises(Exception, match="broken row"):
        write_export(made.repartition(4).withColumn("parrafo", bad), path)
    assert files_of(path) == []
    write_export(made, path)
    assert REPORT in files_of(path)


def test_an_empty_export(spark, rows, ids, tmp_path):
    path = str(tmp_path / "none")
    write_export(training.training_set(rows.limit(0), predicates(spark), ids(), ids()), path)
    with open(f"{path}/{REPORT}", encoding="utf-8") as f:
        assert json.load(f)["fichas_por_ejemplo"] == {"mediana": 0, "p95": 0}
    assert TrainingExport.name() == "training_export"
