"""Quotes in paragraphs against looking everywhere, with few-word fragments and matches inside words."""

import random
import re
import unicodedata

from tessera.operators.alignment import EDGE_WORDS, LEAST_CHARS, locate_quotes


def folded(s):
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c) != "Mn")
    return re.sub(r"\s+", " ", s.translate(str.maketrans("“”«»‘’", "\"\"\"\"''"))).strip().lower()


def brute(quote, paragraphs):
    c = folded(quote or "")
    if len(c) < LEAST_CHARS:
        return None
    w = c.split(" ")
    for k, t in enumerate([c, *([" ".join(w[:EDGE_WORDS]), " ".join(w[-EDGE_WORDS:])] if len(w) > EDGE_WORDS else [])]):
        for pi, p in enumerate(paragraphs):
            if (at := folded(p).find(t)) >= 0:
                return pi, k, at
    return None


def test_quotes_everywhere(spark):
    r = random.Random(2)
    words = ["alcaldía", "Él", "río", "“ley”", "de", "contratación", "a", "extraordinariamente", "ﬁn", "año", "no"]
    texts = {w: [" ".join(r.choices(words, k=r.randint(0, 40))).replace(" a ", "  a\t") for _ in range(4)] for w in range(40)}
    quotes = []
    for w, ps in texts.items():
        for _ in range(6):
            p = r.choice(ps)
            a = r.randint(0, max(len(p) - 1, 0))
            q = p[a : a + r.choice((15, 25, 40, 90, 200))]
            q = r.choice((q, q.upper(), q + " otra cosa distinta", "otra cosa distinta " + q, "extraordinariamente contratación", None))
            quotes.append((len(quotes), w, q))
    df = spark.createDataFrame(quotes, "id int, wp_id int, cita string")
    ps = spark.createDataFrame([(w, i, p) for w, x in texts.items() for i, p in enumerate(x)], "wp_id int, pi int, parrafo string")
    got = {x.id: (x.pi, x.intento, x.en) for x in locate_quotes(df, ps).collect()}
    want = {i: m for i, w, q in quotes if (m := brute(q, texts[w]))}
    assert got == want and len({k for _, k, _ in want.values()}) == 3
    assert locate_quotes(df.limit(0), ps).count() == locate_quotes(df, ps.limit(0)).count() == 0


def test_nearest_place_of_the_first_wording(spark):
    from pyspark.sql import functions as F

    from tessera.operators.alignment import nearest

    r = random.Random(5)
    words = ["ana", "Ána", "ANA_LUZ", "luz", "Luz", "analuz", "luz-mar", "de", ","]
    rows = [(k, " ".join(r.choices(words, k=r.randint(0, 12))), r.sample(["ana luz", "luz mar", "ana", "luz", "eva", ""], 3), r.randint(0, 40)) for k in range(300)] + [(300, None, ["ana"], 3), (301, "ana", None, 3), (302, "x ana y ana", ["ana"], None)]

    def brute(t, ws, n):
        flat = folded(t or "") if t else ""
        tokens = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", flat)]
        for w in ws or ():
            parts, spots = w.split(), []
            for i in range(len(tokens) - len(parts) + 1):
                got = tokens[i : i + len(parts)]
                inner = all(not re.search(r"[^\W_]", flat[got[k][1] : got[k + 1][0]]) for k in range(len(got) - 1))
                edges = parts and not re.match(r"\w", flat[got[-1][1] : got[-1][1] + 1]) and not re.match(r"\w", flat[max(got[0][0] - 1, 0) : got[0][0]])
                if parts and edges and inner and [flat[a:z] for a, z in got] == parts:
                    spots.append((got[0][0], got[-1][1]))
            if spots:
                return min(spots, key=lambda s: abs(s[0] - (n or 0)))
        return None, None

    df = spark.createDataFrame(rows, "k int, t string, w array<string>, n int").select("k", nearest(F.col("t"), F.col("w"), F.col("n")).alias("x"))
    got = {x.k: (x.x.ini, x.x.fin) for x in df.collect()}
    assert got == {k: brute(t, w, n) for k, t, w, n in rows} and len({v for v in got.values()}) > 20


def test_runs_end_with_one_outcome_a_row(spark):
    from tessera.operators.alignment import posts_of_runs, relations_of_runs, report_of_runs

    census = spark.createDataFrame([(1, "https://www.x.org/a")], "wp_id long, link string")
    ps = spark.createDataFrame([(1, 0, "Nada."), (1, 1, "Ana Ruiz vio ayer a Luz Mar, prima suya; Ana Ruiz es alcaldesa de Neiva desde enero"), (1, 2, None)], "wp_id long, pi int, parrafo string")
    q, url = "prima suya; Ana Ruiz es alcaldesa", "http://x.org/a/"
    rows = [
        (1, "x", url, [None, " "], "Ana Ruiz", "Luz Mar", "PRIMA"), (2, "x", "http://no.org", [q], "Ana Ruiz", "Luz Mar", "PRIMA"), (3, "x", url, [q], None, "Luz Mar", "PRIMA"), (4, "x", url, ["nada de esto está en el artículo"], "Ana Ruiz", "Luz Mar", "PRIMA"),
        (5, "x", url, [q], "Eva Sol", "Luz Mar", "PRIMA"), (6, "x", url, [q], "Ana Ruiz", "ANA RUIZ", "PRIMA"), (7, "x", url, [q], "Ana Ruiz", "Luz Mar", "vecina"), (8, "x", url, ["otra cosa que no se dijo nunca", q], "Ana Ruiz", "Luz Mar", " prima"), (9, "a", url, [q], "ana ruiz", "luz mar", "Tía"),
        (10, "x", url, None, "Ana Ruiz", "Luz Mar", "PRIMA"), (11, "x", url, [q], "Ana Ruiz", "Luz Mar", "AMIGO"),
    ]
    df = spark.createDataFrame([(*r[:6], "PERSONA", "raro", r[6]) for r in rows], "id long, corrida string, url string, citas array<string>, a string, b string, clase_a string, clase_b string, relacion string")
    aligned, outcomes = relations_of_runs(df, census, ps)
    assert {x.id: x.motivo for x in outcomes.collect()} == {1: "sin_cita", 2: "sin_noticia", 3: "sin_entidad", 4: "cita_no_hallada", 5: "extremo_no_hallado", 6: "mismo_tramo", 7: "tipo_desconocido", 8: "duplicada", 9: "alineada", 10: "sin_cita", 11: "alineada"}
    got = {x.id: x for x in aligned.collect()}
    # The second Ana Ruiz is nearer to the quote.
    assert got[9].a.ini == 41 and got[9].a.texto == "Ana Ruiz" and got[9].b.texto == "Luz Mar" and got[9].corridas == ["a", "x"] and got[9].simetrico and got[9].predicado == "familiar de" and got[9].b.tipo is None
    assert got[11].predicado is None and got[11].relacion == "AMIGO" and got[11].corridas == ["x"]
    assert {(x.corrida, x.motivo): x.n for x in report_of_runs(outcomes).collect()}["x", "total"] == 10
    posts = [(1, "Ana Ruiz", "PERSONA", "alcaldesa de Neiva"), (2, "Ana Ruiz", "PERSONA", " Alcaldesa de Neiva "), (3, "Luz Mar", "PERSONA", "abogado"), (4, "Luz Mar", "RARO", "alcaldesa de Neiva"), (5, "Luz Mar", "PERSONA", "reina de Cali"), (6, "Luz Mar", "PERSONA", "rey"), (7, None, "PERSONA", "alcaldesa de Neiva"), (8, "Luz Mar", "PERSONA", None)]
    df = spark.createDataFrame([(k, "x", url, p, c, g) for k, p, c, g in posts], "id long, corrida string, url string, persona string, clase string, cargo string")
    aligned, outcomes = posts_of_runs(df, census, ps)
    assert {x.id: x.motivo for x in outcomes.collect()} == {1: "alineado", 2: "duplicado", 3: "oficio_suelto", 4: "sin_persona_o_noticia", 5: "no_hallado", 7: "sin_persona_o_noticia"}
    assert [(x.id, x.pi, x.persona.ini, x.cargo.texto) for x in aligned.collect()] == [(1, 1, 41, "alcaldesa de Neiva")]
    none = spark.createDataFrame([], "id long, corrida string, url string, citas array<string>, a string, b string, clase_a string, clase_b string, relacion string")
    assert [x.count() for x in relations_of_runs(none, census, ps)] == [0, 0]
