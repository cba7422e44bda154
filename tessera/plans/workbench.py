"""Registered queries of two-level matching, cut-off curves and the review view; they join those of `archive`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.vocabulary import predicates
from tessera.operators import calibrate, evaluate, matching, offsets, relations, resolve, review, scope, sinks, spans, training, view
from tessera.plans.archive import _FORMS, _cuts, _fold_sql, query
from tessera.plans.training import ORACLE_SQL, QUERIES
from tessera.plans.stand_ins import with_views
from tessera.streaming import registry

__all__ = ["ORACLE_SQL", "QUERIES"]

_SYM = "('socio de')"


def _match(mine: str, gold: str, out: str, order: str = "i") -> str:
    """CTEs up to `out` (wp_id, pi, i, g): each entity in turn takes the first free gold one, by reduction over a paragraph's lists."""
    return (
        f"{out}_p AS (SELECT wp_id, pi, list({{'i': i, 'ini': ini, 'fin': fin, 'tipo': tipo}} ORDER BY {order}) AS p FROM {mine} GROUP BY wp_id, pi), "
        f"{out}_y AS (SELECT wp_id, pi, list({{'g': i, 'ini': ini, 'fin': fin, 'tipo': tipo}} ORDER BY i) AS y FROM {gold} GROUP BY wp_id, pi), "
        f"{out}_s AS (SELECT p.wp_id, p.pi, list_reduce(p, lambda s, e: CASE WHEN len(list_filter(s.free, lambda z: z.tipo = e.tipo AND z.ini <= e.fin AND e.ini <= z.fin)) = 0 THEN s ELSE "
        "{'free': list_filter(s.free, lambda z: z.g <> list_filter(s.free, lambda q: q.tipo = e.tipo AND q.ini <= e.fin AND e.ini <= q.fin)[1].g), "
        "'hits': list_append(s.hits, {'i': e.i, 'g': list_filter(s.free, lambda q: q.tipo = e.tipo AND q.ini <= e.fin AND e.ini <= q.fin)[1].g})} END, "
        f"{{'free': y, 'hits': []::STRUCT(i INTEGER, g INTEGER)[]}}) AS s FROM {out}_p AS p JOIN {out}_y AS y ON p.wp_id = y.wp_id AND p.pi = y.pi), "
        f"{out} AS MATERIALIZED (SELECT wp_id, pi, h.i AS i, h.g AS g FROM (SELECT wp_id, pi, unnest(s.hits) AS h FROM {out}_s) AS u)"
    )


def _prf(vp: str = "vp", fp: str = "fp", fn: str = "fn") -> str:
    over = lambda a, b: f"round(coalesce({a} / nullif({b}, 0), 0), 6)"
    return f"{over(vp, f'({vp} + {fp})')} AS p, {over(vp, f'({vp} + {fn})')} AS r, {over(f'(2 * {vp})', f'(2 * {vp} + {fp} + {fn})')} AS f1"


_KEYED = "CASE WHEN predicado IN {sym} THEN least({a}, {b}) ELSE {a} END AS x, CASE WHEN predicado IN {sym} THEN greatest({a}, {b}) ELSE {b} END AS y"


def _key(a: str, b: str) -> str:
    return _KEYED.format(sym=_SYM, a=a, b=b)


_GOLD = f"gk AS MATERIALIZED (SELECT DISTINCT wp_id, pi, predicado, {_key('a', 'b')} FROM gold_ties)"


def _judged(ents_hits: str, ties: str) -> str:
    """CTE `j`: relations with the gold ends of theirs, whether gold has them, and whether it has them the other way round."""
    return (
        f"e AS (SELECT t.*, {_key('ha.g', 'hb.g')} FROM {ties} AS t LEFT JOIN {ents_hits} AS ha ON ha.wp_id = t.wp_id AND ha.pi = t.pi AND ha.i = t.a LEFT JOIN {ents_hits} AS hb ON hb.wp_id = t.wp_id AND hb.pi = t.pi AND hb.i = t.b), "
        "n AS (SELECT * REPLACE (CASE WHEN x IS NULL OR y IS NULL THEN NULL ELSE x END AS x) FROM e), "
        "j AS MATERIALIZED (SELECT n.*, k.x IS NOT NULL AS hit, k.x IS NULL AND q.x IS NOT NULL AS back FROM n LEFT JOIN gk AS k ON k.wp_id = n.wp_id AND k.pi = n.pi AND k.predicado = n.predicado AND k.x = n.x AND k.y = n.y "
        f"LEFT JOIN gk AS q ON q.wp_id = n.wp_id AND q.pi = n.pi AND q.predicado = n.predicado AND q.x = n.y AND q.y = n.x AND n.predicado NOT IN {_SYM})"
    )


_ENTITY_COUNTS = (
    "c AS (SELECT m.tipo, h.g IS NOT NULL AS v, h.g IS NULL AS f, false AS m FROM {mine} AS m LEFT JOIN hits AS h ON h.wp_id = m.wp_id AND h.pi = m.pi AND h.i = m.i "
    "UNION ALL SELECT o.tipo, false, false, true FROM {gold} AS o WHERE NOT EXISTS (SELECT 1 FROM hits AS h WHERE h.wp_id = o.wp_id AND h.pi = o.pi AND h.g = o.i)), "
    "t AS (SELECT tipo, count(*) FILTER (v) AS vp, count(*) FILTER (f) AS fp, count(*) FILTER (m) AS fn FROM (SELECT * FROM c UNION ALL SELECT '*', v, f, m FROM c) AS u GROUP BY tipo)"
)


@query("entity_report", f"WITH {_match('model_ents', 'gold_ents', 'hits')}, {_ENTITY_COUNTS.format(mine='model_ents', gold='gold_ents')} SELECT tipo, vp, fp, fn, {_prf()}, vp + fn AS oro FROM t")
def _(s, t):
    return matching.entity_report(t("model_ents"), t("gold_ents"))


# The older report of the same matching, without the total.
ORACLE_SQL["evaluate_one_to_one"] = with_views(
    f"WITH {_match('model_ents', 'gold_ents', 'hits')}, {_ENTITY_COUNTS.format(mine='model_ents', gold='gold_ents')} SELECT tipo, vp, fp, fn, round(2 * vp / (2 * vp + fp + fn), 6) AS f1 FROM t WHERE tipo <> '*'"
)
# Minimums of two sections and of one region, eras filled up to ten and cut to it, any others up to thirty; all in the order of a hash.
ORACLE_SQL["held_out_choice"] = with_views(
    "WITH c AS (SELECT wp_id, section AS seccion, CASE WHEN date < '1994' THEN 'a' WHEN date < '1996' THEN 'b' ELSE 'c' END AS tramo, md5(concat('2026|', wp_id)) AS d FROM census), "
    "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seccion ORDER BY d, wp_id) AS k FROM c) AS x WHERE k <= CASE seccion WHEN '1-URGENT' THEN 6 WHEN '2-HIGH' THEN 3 WHEN '5-LOW' THEN 3 ELSE 0 END), "
    "n AS (SELECT tramo, count(*) AS n FROM s GROUP BY 1), "
    "f AS (SELECT x.* FROM (SELECT *, row_number() OVER (PARTITION BY tramo ORDER BY d, wp_id) AS k FROM c WHERE wp_id NOT IN (SELECT wp_id FROM s)) AS x LEFT JOIN n ON n.tramo = x.tramo WHERE k <= 10 - coalesce(n, 0)), "
    "chosen AS (SELECT wp_id, seccion, tramo, d FROM s UNION ALL SELECT wp_id, seccion, tramo, d FROM f), "
    "kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tramo ORDER BY d, wp_id) AS k FROM chosen) AS x WHERE k <= 10), "
    "spare AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY d, wp_id) AS k FROM c WHERE wp_id NOT IN (SELECT wp_id FROM chosen)) AS x WHERE k <= 30 - (SELECT count(*) FROM kept)) "
    "SELECT wp_id, seccion, tramo FROM kept UNION ALL SELECT wp_id, seccion, tramo FROM spare"
)


def _relation_counts(once: bool) -> str:
    good = "CASE WHEN row_number() OVER (PARTITION BY wp_id, pi, predicado, x, y ORDER BY orden) = 1 THEN hit ELSE false END" if once else "hit"
    return (
        f"w AS (SELECT predicado, {good} AS v, hit AND predicado NOT IN {_SYM} AS d, back AS i, false AS m FROM j), "
        "c2 AS (SELECT * FROM w UNION ALL SELECT predicado, false, false, false, true FROM gk WHERE NOT EXISTS (SELECT 1 FROM j WHERE hit AND j.wp_id = gk.wp_id AND j.pi = gk.pi AND j.predicado = gk.predicado AND j.x = gk.x AND j.y = gk.y)), "
        "t2 AS (SELECT predicado, count(*) FILTER (v) AS vp, count(*) FILTER (NOT v AND NOT m) AS fp, count(*) FILTER (m) AS fn, count(*) FILTER (d) AS directas, count(*) FILTER (i) AS invertidas FROM (SELECT * FROM c2 UNION ALL SELECT '*', v, d, i, m FROM c2) AS u GROUP BY predicado)"
    )


@query(
    "relation_report",
    f"WITH {_match('model_ents', 'gold_ents', 'hits')}, {_GOLD}, {_judged('hits', 'model_ties')}, {_relation_counts(False)} "
    f"SELECT predicado, vp, fp, fn, directas, invertidas, {_prf()}, vp + fn AS oro, round(directas / nullif(directas + invertidas, 0), 6) AS direccion FROM t2",
)
def _(s, t):
    return matching.relation_report(t("model_ents"), t("model_ties"), t("gold_ents"), t("gold_ties"), ("socio de",))


_COMMON = "co AS (SELECT DISTINCT wp_id, pi FROM gold_ents INTERSECT SELECT DISTINCT wp_id, pi FROM model_ents), se AS MATERIALIZED (SELECT m.* FROM model_ents AS m SEMI JOIN co ON co.wp_id = m.wp_id AND co.pi = m.pi), ge AS MATERIALIZED (SELECT m.* FROM gold_ents AS m SEMI JOIN co ON co.wp_id = m.wp_id AND co.pi = m.pi)"


@query(
    "annotator_ceiling",
    f"WITH {_COMMON}, {_match('se', 'ge', 'hits')}, {_ENTITY_COUNTS.format(mine='se', gold='ge')}, "
    f"gk AS MATERIALIZED (SELECT DISTINCT g.wp_id, g.pi, predicado, {_key('a', 'b')} FROM gold_ties AS g SEMI JOIN co ON co.wp_id = g.wp_id AND co.pi = g.pi), "
    f"st AS (SELECT wp_id, pi, predicado, x AS a, y AS b, 0 AS orden FROM (SELECT DISTINCT m.wp_id, m.pi, predicado, {_key('a', 'b')} FROM model_ties AS m SEMI JOIN co ON co.wp_id = m.wp_id AND co.pi = m.pi) AS u), "
    f"{_judged('hits', 'st')}, {_relation_counts(True)} "
    f"SELECT 'tipo' AS nivel, tipo AS clase, vp, fp, fn, {_prf()}, vp + fn AS oro FROM t UNION ALL SELECT 'predicado', predicado, vp, fp, fn, {_prf()}, vp + fn FROM t2 WHERE predicado = '*' OR vp + fp + fn >= 5",
)
def _(s, t):
    return matching.ceiling(t("model_ents"), t("model_ties"), t("gold_ents"), t("gold_ties"), ("socio de",))


# Every cut-off is matched anew in SQL; the operator gets them all from one matching by falling score.
_CUT_POINTS = "[0.3, 0.5, 0.7, 0.9]"
_PASSES = ", ".join(f"over{k} AS (SELECT * FROM model_ents WHERE score >= {c}), {_match(f'over{k}', 'gold_ents', f'm{k}', 'score DESC, i')}" for k, c in enumerate((0.3, 0.5, 0.7, 0.9)))
_CURVE = " UNION ALL ".join(
    f"SELECT o.tipo AS clase, CAST({c} AS DOUBLE) AS corte, count(h.g) AS vp, count(*) - count(h.g) AS fp FROM over{k} AS o LEFT JOIN m{k} AS h ON h.wp_id = o.wp_id AND h.pi = o.pi AND h.i = o.i GROUP BY o.tipo" for k, c in enumerate((0.3, 0.5, 0.7, 0.9))
)


@query(
    "entity_curve",
    f"WITH {_PASSES}, v AS ({_CURVE}), o AS (SELECT tipo AS clase, count(*) AS oro FROM gold_ents GROUP BY 1) SELECT clase, corte, vp, fp, fn, {_prf()} FROM (SELECT v.*, coalesce(oro, 0) - vp AS fn FROM v LEFT JOIN o USING (clase)) AS x",
)
def _(s, t):
    whole = matching.curve(matching.scored_entities(t("model_ents"), t("gold_ents")), matching.gold_counts(t("gold_ents")))
    grid = s.createDataFrame([(c,) for c in (0.3, 0.5, 0.7, 0.9)], "c double")
    at = whole.join(F.broadcast(grid), F.col("corte") >= F.col("c")).groupBy("clase", "c").agg(F.min_by(F.struct(*(x for x in whole.columns if x not in ("clase", "corte"))), "corte").alias("m"))
    return at.select("clase", F.col("c").alias("corte"), "m.*")


_SCORED = (
    f"WITH sure AS (SELECT * FROM model_ents WHERE score >= 0.5), {_match('sure', 'gold_ents', 'hits')}, {_GOLD}, "
    "fit AS (SELECT r.* FROM model_ties AS r SEMI JOIN sure AS a ON a.wp_id = r.wp_id AND a.pi = r.pi AND a.i = r.a SEMI JOIN sure AS b ON b.wp_id = r.wp_id AND b.pi = r.pi AND b.i = r.b WHERE r.score >= 0.2), "
    f"{_judged('hits', 'fit')}, k AS (SELECT predicado AS clase, score, hit AND row_number() OVER (PARTITION BY wp_id, pi, predicado, x, y, hit ORDER BY score DESC, orden) = 1 AS acierto FROM j), "
    "o AS (SELECT predicado AS clase, count(*) AS oro FROM gk GROUP BY 1)"
)


def _scored(t):
    ties = ("socio de",)
    return (
        matching.scored_relations(t("model_ents"), t("model_ties"), t("gold_ents"), t("gold_ties"), symmetric=ties),
        matching.gold_relation_counts(t("gold_ents"), t("gold_ties"), ties),
    )


@query(
    "relation_curve",
    f"{_SCORED}, c AS (SELECT DISTINCT clase, score AS corte FROM k), v AS (SELECT c.clase, corte, count(*) FILTER (acierto) AS vp, count(*) FILTER (NOT acierto) AS fp FROM c JOIN k ON k.clase = c.clase AND k.score >= c.corte GROUP BY 1, 2) "
    f"SELECT clase, corte, vp, fp, fn, {_prf()} FROM (SELECT v.*, oro - vp AS fn FROM v JOIN o USING (clase)) AS x",
)
def _(s, t):
    return matching.curve(*_scored(t))


_CUTS = (
    f"{_SCORED}, grid AS (SELECT 0.5 AS corte, 0 AS turno UNION ALL SELECT round(0.3 + 0.05 * n, 2), 1 FROM range(13) AS r(n)), "
    "f AS (SELECT o.clase, corte, turno, coalesce(2 * count(*) FILTER (acierto AND score >= corte) / nullif(count(*) FILTER (score >= corte) + any_value(oro), 0), 0) AS f FROM o CROSS JOIN grid LEFT JOIN k ON k.clase = o.clase WHERE oro >= 3 GROUP BY 1, 2, 3), "
    "b AS (SELECT clase, max(f) FILTER (turno = 0) AS base, max(f) FILTER (turno = 1) AS top FROM f GROUP BY 1), "
    "w AS (SELECT b.clase, CASE WHEN top > base + 1e-9 THEN (SELECT min(corte) FROM f WHERE f.clase = b.clase AND turno = 1 AND round(f.f, 9) = round(b.top, 9)) ELSE 0.5 END AS corte, greatest(top, base) AS f1 FROM b), "
    "cuts AS (SELECT clase, CAST(corte AS DOUBLE) AS corte, f1, CASE WHEN f1 < 0.2 THEN 1.01 ELSE CAST(corte AS DOUBLE) END AS podado FROM w) "
)


@query("chosen_cuts", f"{_CUTS} SELECT clase, corte, round(f1, 6) AS f1, CAST(podado AS DOUBLE) AS podado FROM cuts")
def _(s, t):
    return matching.chosen_cuts(*_scored(t))


_POLICIES = {"global 0.5": (None, 0.5), "global 0.7": (None, 0.7), "por predicado": ("corte", 0.5), "podados, resto 0.7": ("podado", 0.7)}


@query(
    "measured_policies",
    f"{_CUTS}, pol AS (SELECT * FROM (VALUES ('global 0.5', '', 0.5), ('global 0.7', '', 0.7), ('por predicado', 'corte', 0.5), ('podados, resto 0.7', 'podado', 0.7)) AS v(politica, de, d)), "
    "m AS (SELECT politica, count(*) FILTER (acierto AND score >= u) AS vp, count(*) FILTER (NOT acierto AND score >= u) AS fp FROM (SELECT politica, acierto, score, coalesce(CASE de WHEN 'corte' THEN corte WHEN 'podado' THEN podado END, d) AS u FROM k CROSS JOIN pol LEFT JOIN cuts ON cuts.clase = k.clase) AS z GROUP BY 1) "
    f"SELECT politica, vp, fp, fn, {_prf()} FROM (SELECT m.*, (SELECT sum(oro) FROM o)::BIGINT - vp AS fn FROM m) AS y",
)
def _(s, t):
    scored, gold = _scored(t)
    return matching.measured(scored, gold, matching.chosen_cuts(scored, gold), _POLICIES)


# Review view --------------------------------------------------------------------------------------------------------------

_SEEN = (
    "g AS (SELECT *, coalesce(canon, texto) AS forma, count(*) OVER (PARTITION BY wp_id, tipo, coalesce(canon, texto)) AS k FROM canon_proposals), "
    f"seen AS MATERIALIZED (SELECT wp_id, concat('m', pi, '-', ini, '-', fin) AS mid, pi, ini, fin, texto, tipo, CASE WHEN k >= 2 THEN concat('c:', tipo, ':', {_fold_sql('forma', T.FOLD_FROM, T.FOLD_TO)}) END AS grupo "
    "FROM g WHERE score >= CASE tipo WHEN 'persona' THEN 0.7 WHEN 'lugar' THEN 0.3 ELSE 0.5 END AND NOT (tipo = 'cargo' AND lower(texto) IN ('nombre 3', 'nombre 7')))"
)


def _seen(s, t):
    return view.proposed_mentions(t("canon_proposals"), *_cuts(s))


@query("review_mentions", f"WITH {_SEEN} SELECT wp_id, mid, pi, ini, fin, texto, tipo, true AS auto, grupo, false AS designa FROM seen")
def _(s, t):
    return _seen(s, t)


@query(
    "review_relations",
    f"WITH {_SEEN}, f AS (SELECT wp_id, pi, texto, arg_min(mid, {{'i': ini, 'f': fin}}) AS mid FROM seen GROUP BY 1, 2, 3), "
    "e AS (SELECT s.wp_id, s.pi, orden, predicado, x.mid AS a_mid, y.mid AS b_mid FROM said_ties AS s JOIN f AS x ON x.wp_id = s.wp_id AND x.pi = s.pi AND x.texto = s.a JOIN f AS y ON y.wp_id = s.wp_id AND y.pi = s.pi AND y.texto = s.b) "
    "SELECT wp_id, concat('r', pi, '-', a_mid, '-', b_mid) AS rid, a_mid, b_mid, arg_min(predicado, orden) AS predicado, 'vigente' AS cuando FROM e WHERE a_mid <> b_mid GROUP BY wp_id, pi, a_mid, b_mid",
)
def _(s, t):
    return view.proposed_relations(_seen(s, t), t("said_ties"))


# No twin: a state machine; tests hold it against the plain rules.


@query("presence_register")
def _(s, t):
    e = F.col("event_id")
    action = F.element_at(F.array(*map(F.lit, ("conectar", "latido", "tomar", "soltar", "forzar", "tomar", "latido", "desconectar"))), (e % 8 + 1).cast("int"))
    who = F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string"))
    rooms = t("events").select(F.floor(F.col("user_id") / 10).cast("string").alias("sala"), F.col("ts").cast("timestamp").alias("ts"), e.cast("long").alias("orden"), who.alias("sesion"), F.col("event_type").alias("cliente"), action.alias("accion"), (e % 4).cast("long").alias("articulo"))
    return registry.replayed(rooms, 86_400.0)


# No twins: tokens by regular expression; tests hold both against plain versions.


def _paragraph_rows(s, t):
    w = t("written").withColumns({"mid": F.concat_ws("-", "ini", "tipo", "texto"), "ini": F.col("ini") % 30}).withColumn("fin", F.col("ini") + 9)
    ends = w.groupBy("wp_id", "pi").agg(F.min("mid").alias("a_mid"), F.max("mid").alias("b_mid")).select("wp_id", "a_mid", "b_mid", F.lit("parte de").alias("predicado"), F.lit("vigente").alias("cuando"))
    rows = training.gold_rows(w, ends).join(t("phrases"), ["wp_id", "pi"])
    source = F.when(F.col("wp_id") % 7 == 0, "oro").otherwise("plata")
    return rows.select("wp_id", "pi", "parrafo", "entidades", "relaciones", source.alias("fuente"), F.when(F.col("wp_id") % 10 == 3, "val").otherwise("train").alias("conjunto"), F.lit("R").alias("estrato"))


@query("training_discards")
def _(s, t):
    return training.discards(_paragraph_rows(s, t), predicates(s)).groupBy("motivo").agg(F.sum("n").alias("n"), F.count("*").alias("parrafos"))


@query("training_set")
def _(s, t):
    gold = t("phrases").where("wp_id % 7 = 0").select("wp_id")
    x = training.training_set(_paragraph_rows(s, t), predicates(s), gold.where("wp_id % 2 = 0"), gold.where("wp_id % 2 = 1"))
    return x.select("wp_id", "pi", "conjunto", "fuente", F.size("fichas").alias("fichas"), F.to_json("ner").alias("ner"), F.to_json("pares").alias("pares"), F.to_json(F.array_sort(F.map_entries("descartes"))).alias("descartes"))


# Places after cuts: proposals in texts whose marked places are taken out.

_CUTS_OF = "SELECT wp_id, pi, ini, fin FROM marks WHERE tipo = 'lugar'"
_GONE = f"c AS (SELECT DISTINCT wp_id, pi, unnest(range(ini, fin)) AS k FROM ({_CUTS_OF}) AS m), p AS (SELECT wp_id, pi, ini, fin, texto, tipo, score FROM proposals)"


@query(
    "spans_after_cuts",
    f"WITH {_GONE}, n AS (SELECT p.*, count(c.k) FILTER (c.k < p.ini) AS a, count(c.k) FILTER (c.k < p.fin) AS b FROM p LEFT JOIN c ON c.wp_id = p.wp_id AND c.pi = p.pi GROUP BY ALL) "
    "SELECT wp_id, pi, CAST(ini - a AS INTEGER) AS ini, CAST(fin - b AS INTEGER) AS fin, texto, tipo, score FROM n WHERE fin - b > ini - a",
)
def _(s, t):
    cuts = t("marks").where("tipo = 'lugar'").select("wp_id", "pi", "ini", "fin")
    return offsets.after_cuts(t("proposals").select("wp_id", "pi", "ini", "fin", "texto", "tipo", "score"), cuts, ["wp_id", "pi"])


@query("left_group", "SELECT wp_id, mid, texto, CASE WHEN mid % 6 <> 0 THEN grupo END AS grupo FROM marks")
def _(s, t):
    return spans.leave_group(t("marks"), t("marks").where("mid % 6 = 0")).select("wp_id", "mid", "texto", "grupo")


# Agreement of annotators and models ------------------------------------------------------------------------------------

_AB = (
    "a AS (SELECT * FROM gold_ents WHERE mid % 5 <> 0), b AS (SELECT * FROM gold_ents WHERE mid % 3 <> 0 OR mid % 5 = 0), "
    "ra AS (SELECT t.* FROM gold_ties AS t SEMI JOIN a ON a.wp_id = t.wp_id AND a.pi = t.pi AND a.i = t.a SEMI JOIN a AS a2 ON a2.wp_id = t.wp_id AND a2.pi = t.pi AND a2.i = t.b), "
    "rb AS (SELECT t.wp_id, t.pi, t.b AS a, t.a AS b, t.predicado FROM gold_ties AS t SEMI JOIN b ON b.wp_id = t.wp_id AND b.pi = t.pi AND b.i = t.a SEMI JOIN b AS b2 ON b2.wp_id = t.wp_id AND b2.pi = t.pi AND b2.i = t.b)"
)


def _annotators(t):
    g, r = t("gold_ents"), t("gold_ties").withColumn("cuando", F.lit("vigente"))
    a, b = g.where("mid % 5 <> 0"), g.where("mid % 3 <> 0 OR mid % 5 = 0")

    def inside(e):
        end = lambda c: e.select("wp_id", "pi", F.col("i").alias(c))
        return r.join(end("a"), ["wp_id", "pi", "a"], "left_semi").join(end("b"), ["wp_id", "pi", "b"], "left_semi")

    # The second annotator says every relation the other way round, so only those that hold both ways can agree.
    return a, inside(a), b, inside(b).select("wp_id", "pi", F.col("b").alias("a"), F.col("a").alias("b"), "predicado", "cuando")


@query(
    "consensus_relations",
    f"WITH {_AB}, e AS (SELECT wp_id, pi, ini, fin, row_number() OVER (PARTITION BY wp_id, pi ORDER BY i) - 1 AS n FROM b WHERE EXISTS (SELECT 1 FROM a WHERE a.wp_id = b.wp_id AND a.pi = b.pi AND a.ini = b.ini AND a.fin = b.fin AND a.tipo = b.tipo)), "
    "m AS (SELECT wp_id, pi, ini, fin, max(n) AS n FROM e GROUP BY ALL), "
    "ka AS (SELECT DISTINCT r.wp_id, r.pi, predicado, {'i': x.ini, 'f': x.fin} AS p, {'i': y.ini, 'f': y.fin} AS q FROM ra AS r JOIN a AS x ON x.wp_id = r.wp_id AND x.pi = r.pi AND x.i = r.a JOIN a AS y ON y.wp_id = r.wp_id AND y.pi = r.pi AND y.i = r.b), "
    "kb AS (SELECT r.wp_id, r.pi, predicado, {'i': x.ini, 'f': x.fin} AS p, {'i': y.ini, 'f': y.fin} AS q FROM rb AS r JOIN b AS x ON x.wp_id = r.wp_id AND x.pi = r.pi AND x.i = r.a JOIN b AS y ON y.wp_id = r.wp_id AND y.pi = r.pi AND y.i = r.b) "
    "SELECT kb.wp_id, kb.pi, CAST(x.n AS INTEGER) AS a, CAST(y.n AS INTEGER) AS b, kb.predicado, 'vigente' AS cuando FROM kb JOIN m AS x ON x.wp_id = kb.wp_id AND x.pi = kb.pi AND x.ini = kb.p.i AND x.fin = kb.p.f JOIN m AS y ON y.wp_id = kb.wp_id AND y.pi = kb.pi AND y.ini = kb.q.i AND y.fin = kb.q.f "
    "WHERE EXISTS (SELECT 1 FROM ka WHERE ka.wp_id = kb.wp_id AND ka.pi = kb.pi AND ka.predicado = kb.predicado AND (ka.p = kb.p AND ka.q = kb.q OR ka.predicado = 'socio de' AND ka.p = kb.q AND ka.q = kb.p))",
)
def _(s, t):
    return evaluate.consensus_relations(*_annotators(t), ("socio de",))[1]


_RUNS = "SELECT CASE CAST(wp_id % 3 AS INT) WHEN 0 THEN 'm1' WHEN 1 THEN 'm2' ELSE 'm3' END AS modelo, wp_id, pi, ini, fin, tipo, score FROM proposals"


@query(
    "model_agreement",
    f"WITH c AS (SELECT DISTINCT * FROM ({_RUNS}) AS r), co AS (SELECT DISTINCT modelo, wp_id FROM c WHERE wp_id IN (SELECT wp_id FROM marks)), "
    "b AS (SELECT DISTINCT modelo, wp_id, pi, ini, fin, tipo FROM c WHERE score >= 0.5 AND wp_id IN (SELECT wp_id FROM marks)), a AS (SELECT DISTINCT wp_id, pi, ini, fin, tipo FROM marks), "
    "v AS (SELECT modelo, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM a WHERE a.wp_id = b.wp_id AND a.pi = b.pi AND a.tipo = b.tipo AND a.ini < b.fin AND b.ini < a.fin)) AS h FROM b GROUP BY 1), "
    "o AS (SELECT modelo, count(*) AS n FROM co JOIN a ON a.wp_id = co.wp_id GROUP BY 1) "
    "SELECT k.modelo, k.comunes, round(2 * v.h / greatest(v.n + o.n, 1), 6) AS acuerdo FROM (SELECT modelo, count(*) AS comunes FROM co GROUP BY 1) AS k JOIN v ON v.modelo = k.modelo JOIN o ON o.modelo = k.modelo",
)
def _(s, t):
    model = F.element_at(F.array(F.lit("m1"), F.lit("m2"), F.lit("m3")), (F.col("wp_id") % 3 + 1).cast("int"))
    return evaluate.model_agreement(t("marks").withColumn("score", F.lit(1.0)), t("proposals").withColumn("modelo", model))


_SAID = "SELECT wp_id, CAST(orden % 3 AS INTEGER) AS pi, a AS cabeza, b AS cola, predicado, predicado <> 'apoya a' AS simetrico FROM relations"
_MODELS = "SELECT CASE WHEN wp_id % 2 = 0 THEN 'm1' ELSE 'm2' END AS modelo, wp_id, CAST(orden % 3 AS INTEGER) AS pi, orden, CASE WHEN orden % 2 = 0 THEN b ELSE a END AS ea, CASE WHEN orden % 2 = 0 THEN a ELSE b END AS eb, predicado FROM relations WHERE score >= 0.3"


@query(
    "family_report",
    f"WITH f AS (SELECT row_number() OVER () AS q, * FROM ({_SAID}) AS s), r AS ({_MODELS}), p AS (SELECT CASE WHEN wp_id % 2 = 0 THEN 'm1' ELSE 'm2' END AS modelo, wp_id, pi, wp_id % 11 = 0 AS invalido, CAST(length(parrafo) AS BIGINT) AS pistas, CAST(length(parrafo) // 2 AS BIGINT) AS recuperadas FROM phrases), "
    "k AS (SELECT p.modelo, f.*, lower(cabeza) AS h, lower(cola) AS t FROM p JOIN f ON f.wp_id = p.wp_id AND f.pi = p.pi WHERE NOT invalido), "
    "j AS (SELECT k.modelo, k.q, min({'o': r.orden, 'd': k.simetrico OR contains(lower(r.ea), k.h) OR contains(k.h, lower(r.ea))}) AS m FROM k JOIN r ON r.modelo = k.modelo AND r.wp_id = k.wp_id AND r.pi = k.pi AND r.predicado = k.predicado WHERE "
    "(contains(lower(r.ea), k.h) OR contains(k.h, lower(r.ea))) AND (contains(lower(r.eb), k.t) OR contains(k.t, lower(r.eb))) OR (contains(lower(r.ea), k.t) OR contains(k.t, lower(r.ea))) AND (contains(lower(r.eb), k.h) OR contains(k.h, lower(r.eb))) GROUP BY 1, 2), "
    "n AS (SELECT k.modelo, count(*) AS familia, count(m) AS predicado, count(*) FILTER (m.d) AS direccion FROM k LEFT JOIN j ON j.modelo = k.modelo AND j.q = k.q GROUP BY 1) "
    "SELECT x.modelo, x.pistas, x.recuperadas, coalesce(familia, 0) AS familia, coalesce(predicado, 0) AS predicado, coalesce(direccion, 0) AS direccion FROM (SELECT modelo, CAST(sum(pistas) AS BIGINT) AS pistas, CAST(sum(recuperadas) AS BIGINT) AS recuperadas FROM p WHERE NOT invalido GROUP BY 1) AS x LEFT JOIN n ON n.modelo = x.modelo",
)
def _(s, t):
    r = t("relations").withColumn("pi", (F.col("orden") % 3).cast("int"))
    model = F.when(F.col("wp_id") % 2 == 0, "m1").otherwise("m2").alias("modelo")
    even = F.col("orden") % 2 == 0
    said = r.where("score >= 0.3").select(model, "wp_id", "pi", "orden", F.when(even, F.col("b")).otherwise(F.col("a")).alias("ea"), F.when(even, F.col("a")).otherwise(F.col("b")).alias("eb"), "predicado")
    n = F.length("parrafo").cast("long")
    p = t("phrases").select(model, "wp_id", "pi", (F.col("wp_id") % 11 == 0).alias("invalido"), n.alias("pistas"), F.floor(n / 2).alias("recuperadas"))
    return training.family_report(p, said, r.select("wp_id", "pi", F.col("a").alias("cabeza"), F.col("b").alias("cola"), "predicado", (F.col("predicado") != "apoya a").alias("simetrico")))


# Listings, labels, what is kept of a batch -------------------------------------------------------------------------------


@query(
    "article_annotation",
    "SELECT coalesce(m.wp_id, r.wp_id) AS wp_id, m.menciones, r.relaciones FROM (SELECT wp_id, string_agg(concat_ws('-', pi, ini, fin, mid, texto), ';' ORDER BY pi, ini, fin, mid, texto, tipo, grupo) AS menciones FROM marks GROUP BY 1) AS m "
    "FULL JOIN (SELECT wp_id, string_agg(concat_ws('-', a, b, predicado), ';' ORDER BY a, b, predicado, cuando) AS relaciones FROM relations GROUP BY 1) AS r ON r.wp_id = m.wp_id",
)
def _(s, t):
    x = review.annotation(t("marks"), t("relations"))
    line = lambda c, *k: F.array_join(F.transform(c, lambda m: F.concat_ws("-", *(m[i] for i in k))), ";").alias(c)
    return x.select("wp_id", line("menciones", "pi", "ini", "fin", "mid", "texto"), line("relaciones", "a", "b", "predicado"))


@query("paragraph_counts", "SELECT coalesce(m.wp_id, p.wp_id) AS wp_id, coalesce(m.pi, p.pi) AS pi, coalesce(oro, 0) AS oro, coalesce(propuestas, 0) AS propuestas FROM (SELECT wp_id, pi, count(*) AS oro FROM marks GROUP BY 1, 2) AS m FULL JOIN (SELECT wp_id, pi, count(*) AS propuestas FROM proposals GROUP BY 1, 2) AS p ON p.wp_id = m.wp_id AND p.pi = m.pi")
def _(s, t):
    return review.paragraph_counts(t("marks"), t("proposals"))


@query(
    "annotable_articles",
    "SELECT b.wp_id, section AS seccion, title, date, parrafo AS texto, CAST(len(regexp_extract_all(parrafo, '\\S+')) AS BIGINT) AS palabras FROM batch AS b JOIN census AS c ON c.wp_id = b.wp_id LEFT JOIN (SELECT wp_id, parrafo FROM phrases WHERE wp_id % 5 <> 0) AS a ON a.wp_id = b.wp_id WHERE calibra",
)
def _(s, t):
    bodies = t("phrases").where("wp_id % 5 <> 0").select("wp_id", F.col("parrafo").alias("texto"), T.word_count(F.col("parrafo")).cast("long").alias("palabras"))
    return scope.annotable(t("batch"), t("census"), bodies)


_PICKED = "SELECT term_id FROM bridge GROUP BY 1 HAVING count(*) > (SELECT 1.1 * avg(n) FROM (SELECT count(*) AS n FROM bridge GROUP BY term_id) AS x)"


@query(
    "selection_label",
    f"WITH p AS ({_PICKED}), t AS (SELECT term_id, name FROM terms WHERE term_id IN (SELECT term_id FROM p) AND parent NOT IN (SELECT term_id FROM p)), l AS (SELECT list(name ORDER BY term_id) AS n FROM t) "
    "SELECT CASE len(n) WHEN 0 THEN 'Selección' WHEN 1 THEN n[1] WHEN 2 THEN concat(n[1], ' y ', n[2]) ELSE concat(n[1], ' y ', len(n) - 1, ' más') END AS etiqueta FROM l",
)
def _(s, t):
    n = t("bridge").groupBy("term_id").agg(F.count("*").alias("n"))
    picked = n.crossJoin(F.broadcast(n.agg((F.avg("n") * 1.1).alias("m")))).where("n > m").select("term_id")
    return scope.selection_label(picked, t("terms"))


_CAL = "SELECT section AS lote_id, tipo, round(avg(score), 3) AS corte FROM proposals AS p JOIN census AS c ON c.wp_id = p.wp_id GROUP BY 1, 2"


def _calibration(t):
    rows = t("proposals").join(t("census").select("wp_id", F.col("section").alias("lote_id")), "wp_id")
    return rows.groupBy("lote_id", "tipo").agg(F.round(F.avg("score"), 3).alias("corte")), rows.where("score < 0.1").select("lote_id", "tipo", F.lower("texto").alias("texto"))


def _restored(t):
    lots = t("census").select(F.col("section").alias("lote_id")).distinct()
    return calibrate.restored(calibrate.saved(lots, *_calibration(t)))


@query("restored_cuts", _CAL)
def _(s, t):
    return _restored(t)[0]


@query("restored_blocklist", "SELECT DISTINCT section AS lote_id, tipo, lower(texto) AS texto FROM proposals AS p JOIN census AS c ON c.wp_id = p.wp_id WHERE score < 0.1")
def _(s, t):
    return _restored(t)[1]


@query("asking_floor", f"SELECT least(0.3, min(corte)) AS piso FROM (SELECT tipo, round(min(score), 3) + 0.05 AS corte FROM proposals WHERE tipo <> 'lugar' GROUP BY 1) AS x")
def _(s, t):
    return calibrate.asking_floor(t("proposals").where("tipo <> 'lugar'").groupBy("tipo").agg((F.round(F.min("score"), 3) + 0.05).alias("corte")))


@query(
    "relation_mentions",
    "WITH e AS (SELECT wp_id, min(mid) AS a_mid, max(mid) AS b_mid FROM marks GROUP BY 1), m AS (SELECT DISTINCT wp_id, mid, pi, texto, tipo FROM marks) "
    "SELECT e.wp_id, a_mid, b_mid, x.pi AS pi_a, x.texto AS texto_a, x.tipo AS tipo_a, y.pi AS pi_b, y.texto AS texto_b, y.tipo AS tipo_b FROM e JOIN m AS x ON x.wp_id = e.wp_id AND x.mid = a_mid JOIN m AS y ON y.wp_id = e.wp_id AND y.mid = b_mid",
)
def _(s, t):
    ends = t("marks").groupBy("wp_id").agg(F.min("mid").alias("a_mid"), F.max("mid").alias("b_mid"))
    return relations.with_mentions(ends, t("marks").select("wp_id", "mid", "pi", "texto", "tipo").distinct())


# A batch's proposals are resolved anew, and those of a third of the articles take the place of the old ones.
_SHORT = f"SELECT DISTINCT wp_id, pi, ini, fin, tipo, {_FORMS} AS texto, score FROM proposals"
_CANON = (
    f"n AS ({_SHORT}), m AS (SELECT DISTINCT wp_id, tipo, texto FROM n WHERE tipo IN ('persona', 'organizacion')), "
    "f AS (SELECT s.wp_id, s.tipo, s.texto, min(f.texto) AS canon FROM m AS s JOIN m AS f ON s.wp_id = f.wp_id AND s.tipo = f.tipo AND contains(f.texto, ' ') WHERE s.texto = 'Ana' OR s.texto = 'ALB' AND f.texto = 'Ana Luz Bo' GROUP BY 1, 2, 3 HAVING count(*) = 1)"
)


@query("recanonised", f"WITH {_CANON} SELECT n.*, canon FROM n LEFT JOIN f ON f.wp_id = n.wp_id AND f.tipo = n.tipo AND f.texto = n.texto")
def _(s, t):
    return resolve.recanonised(t("proposals").select("wp_id", "pi", "ini", "fin", "tipo", F.expr(_FORMS).alias("texto"), "score").distinct())


@query(
    "replaced_after_canon",
    f"WITH {_CANON} SELECT n.*, CASE WHEN n.wp_id % 3 = 0 THEN f.canon END AS canon FROM n LEFT JOIN f ON f.wp_id = n.wp_id AND f.tipo = n.tipo AND f.texto = n.texto",
)
def _(s, t):
    p = t("proposals").select("wp_id", "pi", "ini", "fin", "tipo", F.expr(_FORMS).alias("texto"), "score").distinct()
    return sinks.replace_partition(p.withColumn("canon", F.lit(None).cast("string")), resolve.recanonised(p.where("wp_id % 3 = 0")), ["wp_id"])
