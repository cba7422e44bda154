"""Checks, strata and training rows, by hand."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.functions import checks
from tessera.functions.vocabulary import predicates
from tessera.operators import resolve, review, training
from tessera.sources import rest
from tessera.streaming import sessions


def of(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*(F.col(f"c{i}") for i in range(len(values)))).alias("y")).first().y


@pytest.mark.parametrize(
    "text, tipo, want",
    [
        ("el Congreso", "organizacion", ["articulo"]),
        ("El Tiempo", "organizacion", []),
        ("bandas criminales", "organizacion", ["generica", "plural"]),
        ("senador", "cargo", []),
        ("Banda", "organizacion", []),
        ("a b c d e f g h i", "lugar", ["larga"]),
        (" ", "persona", []),
        (None, "persona", []),
    ],
)
def test_warnings(spark, text, tipo, want):
    assert of(spark, checks.warnings, text, tipo) == want


def test_names(spark):
    ok = [("Usted", "persona", False), ("papá", "persona", False), ("@papa", "persona", True), ("Ana", "persona", True), ("mil pesos", "monto", True), ("milagro", "monto", False), ("5%", "monto", True), ("x", "ley", True)]
    for text, tipo, want in ok:
        assert of(spark, checks.nameable, text, tipo) is want, text
    assert of(spark, checks.without_article, "el  gran Congreso") == "gran Congreso"
    assert of(spark, checks.kinship_words, "Su Hermana y su ex esposo, y la ahijada; hermana") == ["ex esposo", "hermana"]
    assert of(spark, lambda c: checks.gate(c, "J"), "interpuso TUTELA") is True and of(spark, lambda c: checks.gate(c, "J"), "tutelar, desacusar") is False
    assert of(spark, lambda c: checks.gate(c, "E"), "300 millones que donó") is True and of(spark, lambda c: checks.gate(c, "N"), None) is False
    assert tuple(of(spark, checks.outside_kin, " hermana")) == ("hermano de", True) and of(spark, checks.outside_kin, "PRIMO") is None
    assert of(spark, checks.outside_type, "vereda") == "lugar" and of(spark, checks.error_class, None) == "err-red"


def test_glued_titles(spark):
    marks = spark.createDataFrame(
        [(1, 0, 0, 17, "persona", "el senador Duque "), (1, 0, 20, 40, "persona", "exministra Ana Rúa X"), (1, 0, 18, 31, "cargo", "la exministra"), (1, 1, 0, 3, "persona", "Ana"), (1, 2, 0, 3, "persona", None)],
        "wp_id long, pi int, ini int, fin int, tipo string, texto string",
    )
    rows, ties = training.split_titles(marks)
    got = {tuple(r)[2:] for r in rows.where("pi = 0").collect()}
    assert got == {(11, 17, "persona", "Duque "), (3, 10, "cargo", "senador"), (31, 40, "persona", "Ana Rúa X"), (18, 31, "cargo", "la exministra")}
    assert {tuple(r)[2:] for r in ties.collect()} == {(11, 3, "ocupa el cargo", "vigente"), (31, 18, "ocupa el cargo", "pasada")}
    assert rows.where("pi > 0").count() == 2


def test_gold_rows_and_ends(spark):
    marks = spark.createDataFrame([(1, 0, "a", 5, 8, "persona", "Ana"), (1, 0, "b", 0, 3, "lugar", "Mar"), (1, 0, "e", 9, 12, "evento", "Fin"), (1, 1, "c", 0, 3, "ley", "Ley"), (1, -1, "t", 0, 3, "ley", "Ley")], "wp_id long, pi int, mid string, ini int, fin int, tipo string, texto string")
    ties = spark.createDataFrame([(1, "a", "b", "x", "vigente"), (1, "a", "c", "x", "vigente"), (1, "a", "e", "x", "vigente"), (1, "a", "t", "x", "vigente")], "wp_id long, a_mid string, b_mid string, predicado string, cuando string")
    rows = {r.pi: r for r in training.gold_rows(marks, ties).collect()}
    assert [e.texto for e in rows[0].entidades] == ["Mar", "Ana"] and [(x.a, x.b) for x in rows[0].relaciones] == [(1, 0)]
    assert set(rows) == {0, 1} and rows[1].relaciones is None
    ents = spark.createDataFrame([(1, 0, 0, "Ana"), (1, 0, 1, "Luz"), (1, 0, 2, "Ana")], "wp_id long, pi int, i int, texto string")
    said = spark.createDataFrame([(1, 0, "Luz", "Ana", "x", 0.5), (1, 0, "Ana", "Ana", "x", 0.5), (1, 0, "Ana", "Eva", "x", 0.5)], "wp_id long, pi int, cabeza string, cola string, predicado string, score double")
    assert [(r.a, r.b) for r in training.resolved_ends(ents, said).collect()] == [(1, 0)]


def test_imported_aliases(spark):
    case = lambda i, a, b: (f"k{i}", "persona", a, b)
    found = spark.createDataFrame([case(1, "Ana Luz", "A. Luz"), case(2, "Eva Mora", "Eva M."), case(3, "Juan Paz", "Iván Paz"), case(4, "Paz", "Juan Paz"), case(5, "Uno Dos", "Tres")], "clave string, tipo string, a string, b string")
    two = lambda rows, n: spark.createDataFrame(rows, f"{n[0]} string, {n[1]} string")
    mentions = two([("EVA MORA", "p1"), ("eva mora", "p1"), ("Eva M", "p1"), ("Eva M", "p1")], ("nombre", "perfil"))
    profiles = two([("Juan Paz", "p2"), ("Ivan Paz", "p3"), ("Paz", "p4")], ("nombre", "perfil"))
    got = {r.clave: (r.decision, r.confianza) for r in resolve.imported_aliases(found, two([("g", "Ana Luz"), ("g", "A Luz")], ("grupo", "nombre")), profiles, mentions).collect()}
    assert got == {"k1": ("misma", 0.95), "k2": ("misma", 0.9), "k3": ("distinta", 0.9)}


def test_bodies_are_fetched_in_requests_of_a_size(spark):
    def fetch(ids):
        assert 0 < len(ids) <= 40
        return [{"wp_id": i, "n": len(ids)} for i in ids if i % 7]

    wanted = spark.range(1, 201).selectExpr("id AS wp_id").union(spark.sql("SELECT CAST(NULL AS BIGINT)")).union(spark.sql("SELECT 1L"))
    got = sorted(r.wp_id for r in rest.bodies(wanted, spark.range(1, 11).selectExpr("id AS wp_id"), fetch, "wp_id long, n long").collect())
    assert got == [i for i in range(11, 201) if i % 7]


def test_leases_equal_a_plain_state_machine(spark):
    dice = random.Random(3)
    start = datetime(2020, 1, 1)
    rows = [(dice.randrange(3), dice.randrange(3), e, start + timedelta(seconds=dice.randrange(4000))) for e in range(400)]
    want, state = {}, {}
    for item, who, e, t in sorted(rows, key=lambda r: (r[0], r[3], r[1], r[2])):
        holder, seen = state.get(item, (None, None))
        want[e] = holder is None or holder == who or (t - seen).total_seconds() > 30
        if want[e]:
            state[item] = (who, t)
    df = spark.createDataFrame(rows, "item long, user_id long, event_id long, ts timestamp")
    assert {r.event_id: r.concedido for r in sessions.leases(df, 30).collect()} == want
    assert sessions.leases(df.where("item < 0"), 30).count() == 0


def test_menu_and_examples_of_nothing(spark):
    assert review.predicate_menu(spark.createDataFrame([], "tipo_a string, tipo_b string, familia string, orden int")).count() == 0
    c = spark.createDataFrame([(1, None)], "wp_id long, title string")
    f = spark.createDataFrame([("h", i, None) for i in range(5)], "hallazgo string, wp_id long, nota string")
    assert [tuple(r)[1:4] for r in review.examples(f, c, 2).orderBy("wp_id").collect()] == [(0, "(sin título)", ""), (1, "(sin título)", "")]


def test_training_examples(spark):
    text = "Alejandro Lyons Muskus, gobernador, y Ana. Usted"
    ents = [(0, 0, 22, "persona", "Alejandro Lyons Muskus"), (1, 0, 15, "persona", "Alejandro Lyons"), (2, 25, 31, "cargo", "gobern"), (3, 38, 41, "persona", "Ana"), (4, 43, 48, "persona", "Usted"), (5, 24, 34, "raro", "gobernador")]
    ties = [(1, 3, "familiar de"), (0, 3, "familiar de"), (1, 2, "ocupa el cargo"), (3, 2, "dirige"), (3, 4, "familiar de"), (0, 1, "familiar de")]
    e, r = "array<struct<i:int,ini:int,fin:int,tipo:string,texto:string>>", "array<struct<a:int,b:int,predicado:string>>"
    rows = spark.createDataFrame([(1, 0, text, ents, ties), (1, 1, None, ents, ties), (1, 2, "", [], None)], f"wp_id long, pi int, parrafo string, entidades {e}, relaciones {r}")
    got = {x.pi: x for x in training.examples(rows, predicates(spark)).collect()}
    assert got[0].fichas == ["Alejandro", "Lyons", "Muskus", ",", "gobernador", ",", "y", "Ana", ".", "Usted"]
    assert [tuple(n) for n in got[0].ner] == [(0, 2, "persona"), (4, 4, "cargo"), (7, 7, "persona")]
    assert [tuple(x) for x in got[0].relaciones] == [(0, 2, "familiar de"), (2, 0, "familiar de"), (0, 1, "ocupa el cargo")]
    assert got[1].ner == [] and got[1].relaciones is None and got[2].fichas == []


def test_gold_sheet_is_applied_wholly_or_not(spark):
    p = spark.createDataFrame([(1, 0, "Marta Ramírez y Ramírez: 5 y 5, dirige Ecopetrol"), (2, 0, "Ana")], "wp_id long, pi int, parrafo string")
    sheet = [(1, 0, "Ramírez", "persona"), (1, 0, "Marta Ramírez", "persona"), (1, 0, "5", "monto"), (1, 0, "Ecopetrol", "organizacion*"), (2, 0, "Ana", "persona"), (2, 0, "Luz", "persona"), (2, 0, "Ana", "cosa")]
    said = [(1, 0, "Marta Ramírez", "dirige", "Ecopetrol", None), (1, 0, "Ramírez", "hermano de", "Marta Ramírez", "pasada"), (2, 0, "Ana", "dirige", "Ana", ""), (2, 0, "Ana", "no hay", "Ana", ""), (2, 0, "Ana", "dirige", "Eva", "")]
    marks, ties, problems = training.gold_sheet(
        p,
        spark.createDataFrame(sheet, "wp_id long, pi int, texto string, tipo string"),
        spark.createDataFrame(said, "wp_id long, pi int, a string, predicado string, b string, cuando string"),
        predicates(spark),
    )
    assert {(m.ini, m.fin, m.tipo, m.designa) for m in marks.collect()} == {(0, 13, "persona", False), (16, 23, "persona", False), (25, 26, "monto", False), (39, 48, "organizacion", True)}
    assert {(r.a, r.b, r.predicado, r.cuando) for r in ties.collect()} == {(0, 39, "dirige", "vigente"), (0, 16, "hermano de", "pasada")}
    assert {(x.wp_id, x.problema) for x in problems.collect()} == {(2, k) for k in ("texto", "tipo", "admite", "predicado", "extremo")}


def test_paragraphs_that_a_sheet_leaves_out_take_the_proposals(spark):
    ps = [(1, 0, "Ana dirige Acme"), (1, 1, "Luz y Luz Mar en Acme; Luz, 5 y 5, y Mar"), (1, 2, "Luz"), (2, 0, "Luz y Luz")]
    p = spark.createDataFrame(ps, "wp_id long, pi int, parrafo string")
    sheet = spark.createDataFrame([(1, 0, "Ana", "persona")], "wp_id long, pi int, texto string, tipo string")
    said = "wp_id long, pi int, a string, predicado string, b string, cuando string"
    props = [(1, 0, 11, 15, "Acme", "organizacion"), (1, 1, 0, 3, "Luz", "persona"), (1, 1, 6, 13, "Luz Mar", "persona"), (1, 1, 17, 21, "Acme", "organizacion"), (1, 1, 28, 29, "5", "monto"), (2, 0, 0, 3, "Luz", "persona")]
    marked = spark.createDataFrame(props, "wp_id long, pi int, ini int, fin int, texto string, tipo string")
    ties = [(1, 0, "Ana", "dirige", "Acme", ""), (1, 1, "Luz", "dirige", "Acme", "pasada"), (2, 0, "Luz", "dirige", "Luz", "")]
    marks, rels, problems = training.gold_sheet(p, sheet, spark.createDataFrame([(1, 2, "Luz", "no hay", "Luz", "")], said).limit(0), predicates(spark), (marked, spark.createDataFrame(ties, said)))
    # The third Luz is a further place of the first, the second stands in Luz Mar; amounts are not repeated.
    assert {(m.pi, m.ini, m.fin, m.tipo) for m in marks.collect()} == {(0, 0, 3, "persona"), (1, 0, 3, "persona"), (1, 6, 13, "persona"), (1, 17, 21, "organizacion"), (1, 23, 26, "persona"), (1, 28, 29, "monto")}
    assert [(r.wp_id, r.pi, r.a, r.b, r.cuando) for r in rels.collect()] == [(1, 1, 0, 17, "pasada")] and problems.count() == 0
    # A proposed relation that fails stops its article too.
    bad = spark.createDataFrame([(1, 1, "Luz", "dirige", "Luz Mar", "")], said)
    marks, rels, problems = training.gold_sheet(p, sheet, bad.limit(0), predicates(spark), (marked, bad))
    assert marks.count() == rels.count() == 0 and [(x.pi, x.problema) for x in problems.collect()] == [(1, "admite")]


def test_held_out(spark):
    rows = [(i, ("a", "b", "r1", "z")[i % 4], ("t1", "t2", "t3")[i % 3]) for i in range(300)]
    c = spark.createDataFrame(rows, "wp_id long, seccion string, tramo string")
    got = training.held_out(c, {"a": 6, "b": 3}, ("r1",), ("t1", "t2", "t3")).collect()
    assert len(got) == len({r.wp_id for r in got}) == 30 and {e: sum(r.tramo == e for r in got) for e in ("t1", "t2", "t3")} == {"t1": 10, "t2": 10, "t3": 10}
    assert sum(r.seccion == "a" for r in got) >= 6 and sum(r.seccion == "r1" for r in got) >= 3
    assert [r.wp_id for r in training.held_out(c, {"a": 6, "b": 3}, ("r1",), ("t1", "t2", "t3")).collect()] == [r.wp_id for r in got]
    assert training.held_out(c.where("wp_id < 4"), {"a": 6}, ("r1",), ("t1",)).count() == 4
