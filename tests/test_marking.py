import json

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.vocabulary import TYPES, predicates
from tessera.operators import marking, relations, resolve
from tessera.sources.rest import PAGE, ArchiveSource, Busy, Window, fetch_all

P = "wp_id long, pi int, parrafo string"


def test_occurrences_are_whole_words_without_accents(spark):
    p = spark.createDataFrame([(1, 0, "Érase Érase. erase-una eraser ÉRASE"), (2, 0, "nada")], P)
    w = spark.createDataFrame([("érase", "obra")], "texto string, tipo string")
    assert sorted((r.wp_id, r.ini, r.texto) for r in marking.occurrences(p, w).collect()) == [(1, 0, "Érase"), (1, 6, "Érase"), (1, 13, "erase"), (1, 30, "ÉRASE")]


def test_propagation_skips_marks_and_other_articles(spark):
    p = spark.createDataFrame([(1, 0, "Ana y Ana y Ana"), (2, 0, "Ana")], P)
    m = spark.createDataFrame([(1, 0, 6, 9, "Ana", "persona")], "wp_id long, pi int, ini int, fin int, texto string, tipo string")
    assert sorted((r.wp_id, r.ini) for r in marking.propagate(p, m).collect()) == [(1, 0), (1, 12)]


def test_speakers_need_two_lines(spark):
    p = spark.createDataFrame([(1, 0, "Ana: hola"), (1, 1, "Ana: dos"), (1, 2, "Luis: una")], P)
    assert sorted((r.pi, r.voz, r.parrafo) for r in marking.speakers(p).collect()) == [(0, "Ana", "hola"), (1, "Ana", "dos"), (2, None, "Luis: una")]


def test_chunks_keep_all_sentences(spark):
    text = " ".join(f"Frase número {i}." for i in range(100))
    got = spark.createDataFrame([(text,)], "x string").select(marking.chunks(F.col("x"), 90)).first()[0]
    assert " ".join(got) == text and max(map(len, got)) <= 90


def test_tokens_and_shortcodes(spark):
    row = spark.createDataFrame([("El ex-ministro, 3.",)], "x string").select(marking.tokens(F.col("x"))).first()[0]
    assert [(t.tok, t.ini, t.fin) for t in row] == [("El", 0, 2), ("ex-ministro", 3, 14), (",", 14, 15), ("3", 16, 17), (".", 17, 18)]
    html = "[su_quote]texto[/su_quote] [gallery ids=\"1\"] [sic] [nota]"
    assert spark.createDataFrame([(html,)], "x string").select(T.shortcodes(F.col("x"))).first()[0] == ["gallery", "su_quote"]


def test_pages_are_read_until_one_is_short():
    calls, waits = [], []

    def fetch(since, until, page, n):
        calls.append(page)
        if len(calls) == 2:
            raise Busy(3)
        return [{"id": i} for i in range(n if page == 1 else 7)]

    assert len(list(fetch_all(fetch, Window("2020-01", None, None), waits.append))) == PAGE + 7
    assert calls == [1, 2, 2] and waits == [3]


def fake(since, until, page, n):
    return [{"id": int(since[-2:]) * 10 + i, "title": "t"} for i in range(3)] if page == 1 else []


def test_archive_source(spark):
    spark.dataSource.register(ArchiveSource)
    windows = [["2020-01", "2020-01", "2020-02"], ["2020-02", "2020-02", "2020-03"]]
    df = spark.read.format("archive").option("fetch", "tests.test_marking:fake").option("windows", json.dumps(windows)).load()
    assert sorted((r.label, json.loads(r.value)["id"]) for r in df.collect()) == [("2020-01", 10), ("2020-01", 11), ("2020-01", 12), ("2020-02", 20), ("2020-02", 21), ("2020-02", 22)]


def test_translation_and_reasons(spark):
    s = "a string, b string, predicado string, tipo_a string, tipo_b string"
    df = spark.createDataFrame([("x", "y", "padre de", "persona", "persona"), ("x", "y", "raro", "persona", "lugar")], s)
    table = spark.createDataFrame([("padre de", None, None, "hijo de", True)], "predicado string, tipo_a string, tipo_b string, destino string, invertir boolean")
    assert sorted((r.a, r.b, r.predicado) for r in relations.translate(df, table).collect()) == [("x", "y", "vínculo sin tipo"), ("y", "x", "hijo de")]
    bad = spark.createDataFrame([("x", "x", "dirige", "persona", "organizacion"), ("x", "y", "raro", "persona", "lugar"), ("x", "y", "dirige", "persona", "lugar"), ("x", "y", "dirige", "persona", "organizacion")], s)
    assert sorted(str(r.motivo) for r in relations.checked(bad, predicates(spark), tuple(TYPES)).collect()) == ["None", "consigo mismo", "predicado desconocido", "tipos no admitidos"]


def test_identities_report_conflicts(spark):
    d = spark.createDataFrame(
        [("p", "A", "AB", "misma", "juez"), ("p", "AB", "ABC", "misma", "regla"), ("p", "A", "ABC", "distinta", "persona"), ("q", "A", "AB", "misma", "regla"), ("q", "A", "AB", "distinta", "persona")],
        "tipo string, a string, b string, decision string, fuente string",
    )
    assert [(r.tipo, r.canonico, r.formas, r.conflicto) for r in resolve.identities(d).collect()] == [("p", "ABC", "A|AB|ABC", True)]
    found = spark.createDataFrame([("p", "Ana", "ANA R"), ("p", "Ana", "Luz")], "tipo string, a string, b string")
    base = spark.createDataFrame([("p", ["ana", "Ana R."])], "tipo string, formas array<string>")
    assert [(r.a, r.b, r.fuente) for r in resolve.apply_identities(found, base).collect()] == [("Ana", "ANA R", "identidades")]


def test_alignment_outcomes(spark):
    from tessera.operators import alignment

    census = spark.createDataFrame([(1, "https://www.x.org/a")], "wp_id long, link string")
    p = spark.createDataFrame([(1, 0, "otro"), (1, 1, "Ana Ruiz dirige la casa de la moneda desde enero")], P)
    q = "dirige la casa de la moneda"
    rows = [(1, "http://x.org/a/", q, "Ana Ruiz", "casa"), (2, "http://x.org/a", None, "a", "b"), (3, "http://y.org", q, "a", "b"), (4, "x", "nada de esto está en el texto", "a", "b"), (5, "http://x.org/a", q, "Luz", "casa"), (6, "http://x.org/a", q, "casa", "Casa")]
    df = spark.createDataFrame(rows, "id long, url string, cita string, a string, b string")
    got = {r.id: r.motivo for r in alignment.outcomes(df, census, p).collect()}
    assert got == {1: "alineada", 2: "sin cita", 3: "sin artículo", 4: "sin artículo", 5: "extremo no hallado", 6: "mismo tramo"}
    assert {r.motivo: r.n for r in alignment.tally(alignment.outcomes(df, census, p)).collect()}["sin artículo"] == 2


def test_unicode_folds(spark):
    from tessera.functions import unicode_folds as U

    df = spark.createDataFrame([("  “Ñandú”  ﬁn, Çà ",), (None,)], "x string")
    rows = df.select(U.alignment_fold(F.col("x")), U.accents_off(F.col("x")), U.alias_fold(F.col("x"))).collect()
    assert tuple(rows[0]) == ('"nandu" fin, ca', "  “nandu”  ﬁn, ca ", "nandu ﬁn ca") and tuple(rows[1]) == (None, None, None)


def test_segments_rebuild_the_paragraph(spark):
    from tessera.operators import spans

    p = spark.createDataFrame([(1, 0, "el ministro de Paz habló"), (1, 1, "nada")], P)
    m = spark.createDataFrame([(1, 0, 3, 18, 7), (1, 0, 15, 18, 8)], "wp_id long, pi int, ini int, fin int, mid long")
    rows = sorted((r.pi, r.n, r.texto, r.marcas) for r in spans.segments(p, m).collect())
    assert rows == [(0, 0, "el ", ""), (0, 1, "ministro de ", "7"), (0, 2, "Paz", "7,8"), (0, 3, " habló", ""), (1, 0, "nada", "")]


def test_declared_aliases_drag_forms_and_groups(spark):
    from tessera.operators import spans

    s = "wp_id long, mid long, tipo string, texto string, grupo string"
    m = spark.createDataFrame([(1, 1, "p", "Ana", None), (1, 2, "p", "ANA", None), (1, 3, "p", "Luz", "g"), (1, 4, "p", "Sol", "g"), (1, 5, "p", "Mar", "h"), (2, 1, "p", "Ana", None)], s)
    got = {(r.wp_id, r.mid): r.grupo for r in spans.join_aliases(m, spark.createDataFrame([(1, 1, 3)], "wp_id long, a long, b long")).collect()}
    assert len({got[(1, i)] for i in (1, 2, 3, 4)}) == 1 and got[(1, 1)] and got[(1, 5)] == "h" and got[(2, 1)] is None
