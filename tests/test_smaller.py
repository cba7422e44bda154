"""The smaller operators, by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.vocabulary import TYPES
from tessera.operators import evaluate, review, scope


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_shortcodes_and_cleaning(spark):
    html = '<p>[su_quote author="a"]dijo que sí[/su_quote] y [risas] [Gallery] [sic]</p><script>[x y=1]</script>'
    assert one(spark, html, T.shortcodes) == ["Gallery", "su_quote", "x"]
    assert one(spark, html, T.clean_html) == "dijo que sí y [risas] [sic]"
    assert one(spark, html, T.broken) is True and one(spark, "<p>[risas] [ed]</p>", T.broken) is False
    assert one(spark, "[b] texto [/b] [bc]", T.clean_html) == "texto [bc]"
    assert one(spark, None, T.clean_html) is None and one(spark, "", T.shortcodes) == []


def test_names_and_addresses(spark):
    assert one(spark, " HTTPS://me@WWW.Example.org:8080/a/b?c ", T.host) == "example.org"
    assert one(spark, "a b_c-d/é", T.identifier) == "ab_c-d"
    assert one(spark, "PERSONA CON NOMBRE PROPIO", lambda c: T.label_key(c, TYPES)) == "persona"
    assert one(spark, "Otra", lambda c: T.label_key(c, TYPES)) == "otra"
    assert one(spark, "Ana y Ana Luz, A.", lambda c: T.highlighted(c, ["Ana", "Ana Luz", "A", "a.b"])) == "**Ana** y **Ana Luz**, A."
    assert one(spark, "x", lambda c: T.highlighted(c, [])) == "x"
    for text, tipo, want in (("ministro de la presidencia", "cargo", True), ("Ministerio de Hacienda", "organizacion", False), ("el sindicato", "organizacion", True), ("Ana", "persona", False), ("los", "cargo", False)):
        assert one(spark, text, lambda c, tipo=tipo: T.description(c, F.lit(tipo))) is want


def test_closure_says_when_it_is_too_deep(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 13)], "term_id long, parent long")
    assert scope.closure(chain).count() == 78
    with pytest.raises(ValueError):
        scope.closure(chain, most_depth=5)
    assert {(r.term_id, r.nivel, r.hijos) for r in scope.levels(chain).collect()} == {(i, i - 1, int(i < 12)) for i in range(1, 13)}


def test_orphans_and_cycles_are_not_in_the_tree(spark):
    terms = spark.createDataFrame([(1, 0), (2, 1), (3, 99), (4, 5), (5, 4)], "term_id long, parent long")
    assert sorted((r.term_id, r.nivel) for r in scope.levels(terms).collect()) == [(1, 0), (2, 1)]


def test_undo_keeps_what_was_said(spark):
    old = spark.createDataFrame([("a", "misma", 0.9, "x"), ("b", "distinta", 0.8, "y")], "clave string, decision string, confianza double, texto string")
    new = spark.createDataFrame([("b", "misma", 1.0, "z"), ("c", "misma", 0.7, "")], old.schema)
    rows = {r.clave: tuple(r)[1:] for r in review.undo(review.decide(old, new), old.where("clave = 'a'")).collect()}
    assert rows == {"a": ("posponer", 0.0, "deshecha: misma"), "b": ("misma", 1.0, "z"), "c": ("misma", 0.7, "")}


def test_empty_paragraphs_with_names_are_tried_again(spark):
    p = spark.createDataFrame([(1, 0, "Ayer vino Ana con Luis."), (1, 1, "Ayer vino Ana con Luis."), (1, 2, "nadie vino")], "wp_id long, pi int, parrafo string")
    marks = spark.createDataFrame([(1, 1)], "wp_id long, pi int")
    assert [tuple(r) for r in evaluate.suspicious_empty(p, marks).collect()] == [(1, 0, 2)]
