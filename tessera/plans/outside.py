"""Registered queries of model answers, identities and alignment; they join those of `archive`, whose registry holds them all."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import checks
from tessera.functions import text as T
from tessera.functions.vocabulary import PREDICATES, SYMMETRIC, TYPES, predicates
from tessera.operators import alignment, answers, evaluate, identities, resolve, review, training
from tessera.plans.archive import _fold_sql, query
from tessera.plans.training import ORACLE_SQL, QUERIES, _LIST, _re

__all__ = ["ORACLE_SQL", "QUERIES"]

_PLAIN = lambda c: f"translate(lower({c}), '{T.FOLD_FROM}', '{T.FOLD_TO}')"
_UI = lambda c: f"translate(lower({c}), '{T.UI_FROM}', '{T.UI_TO}')"
_FIELD = lambda *names: "coalesce(" + ", ".join(f"json_extract_string(x, '$.{n}')" for n in names) + ")"


def _listed(*names: str) -> str:
    """Rows (wp_id, pi, orden, x) of the objects of a list in the answers."""
    of = "coalesce(" + ", ".join(f"json_extract(j, '$.{n}')" for n in names) + ")"
    return f"(SELECT * FROM (SELECT wp_id, pi, parrafo, unnest(CAST({of} AS JSON[])) AS x, unnest(range(CAST(json_array_length({of}) AS BIGINT))) AS orden FROM good) AS u WHERE json_type(x) = 'OBJECT')"


def _spot(cur: str) -> str:
    """Where a wording stands behind a place, counted from 1; null if nowhere."""
    rest = f"substr(parrafo, {cur} + 1)"
    at = [f"strpos({f(rest)}, {f('dicho')})" for f in (str, lambda c: f"lower({c})", _UI)]
    return f"CASE WHEN {at[0]} > 0 THEN {cur} + {at[0]} WHEN {at[1]} > 0 THEN {cur} + {at[1]} WHEN {at[2]} > 0 THEN {cur} + {at[2]} END"


_TYPE = "CASE {0} " + " ".join(f"WHEN '{t}' THEN '{t}'" for t in (*TYPES, "grupo generico")) + " END"
_FITS = "(VALUES " + ", ".join(f"('{p}', {_PLAIN(repr(p))}, '{a}', '{b}')" for p, _, a, b, _ in PREDICATES) + ") AS p(predicado, plano, de, a_tipo)"
_LETTER = "CASE {0} WHEN 'persona' THEN 'p' WHEN 'organizacion' THEN 'o' WHEN 'cargo' THEN 'c' WHEN 'lugar' THEN 'l' WHEN 'ley' THEN 'n' ELSE '?' END"
# No wording of the answers has more than two places, so two steps find them all.
_READ = (
    "raw AS (SELECT wp_id, pi, parrafo, CASE WHEN json_valid(salida) THEN salida ELSE regexp_extract(salida, '\\{.*\\}', 0, 's') END AS j FROM answers), "
    "sorted AS (SELECT *, coalesce(CASE WHEN json_valid(j) THEN json_type(j) = 'OBJECT' END, false) AS ok FROM raw), good AS MATERIALIZED (SELECT * FROM sorted WHERE ok), "
    f"said AS MATERIALIZED (SELECT wp_id, pi, parrafo, orden, coalesce(trim({_FIELD('texto', 'text')}), '') AS dicho, {_TYPE.format(_PLAIN(_FIELD('tipo', 'type')))} AS tipo FROM {_listed('entidades', 'entities')} AS l), "
    "ranked AS (SELECT *, CASE WHEN dicho <> '' AND tipo IS NOT NULL THEN row_number() OVER (PARTITION BY wp_id, pi, lower(dicho), dicho <> '' AND tipo IS NOT NULL ORDER BY orden) END AS k FROM said), "
    f"one AS (SELECT *, CASE WHEN k = 1 THEN {_spot('0')} END AS at1 FROM ranked), two AS (SELECT *, coalesce(max(at1 - 1 + length(dicho)) OVER (PARTITION BY wp_id, pi, lower(dicho)), 0) AS cur FROM one), "
    f"placed AS (SELECT *, CAST(CASE WHEN k = 1 THEN at1 WHEN k = 2 THEN {_spot('cur')} END - 1 AS INTEGER) AS ini FROM two), "
    f"ents AS MATERIALIZED (SELECT *, CASE WHEN k IS NULL THEN 'tipo_desconocido' WHEN ini IS NULL THEN 'no_localizada' WHEN tipo = 'monto' AND NOT regexp_matches(texto, {_re(checks.AMOUNT)}) THEN 'monto_sin_cifra' WHEN tipo = 'persona' AND lower(trim(texto)) IN {_LIST(checks.PRONOUNS)} THEN 'pronombre' END AS motivo "
    "FROM (SELECT *, substr(parrafo, ini + 1, length(dicho)) AS texto FROM placed) AS q), "
    "taken AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY wp_id, pi ORDER BY orden) - 1 AS INTEGER) AS i FROM ents WHERE motivo IS NULL), "
    "named AS (SELECT wp_id, pi, n, min(i) AS i, arg_min(tipo, i) AS tipo FROM (SELECT wp_id, pi, i, tipo, texto AS n FROM taken UNION SELECT wp_id, pi, i, tipo, dicho FROM taken) AS w GROUP BY ALL), "
    f"rel AS (SELECT wp_id, pi, orden, coalesce(trim({_FIELD('a')}), '') AS na, coalesce(trim({_FIELD('b')}), '') AS nb, {_PLAIN(_FIELD('predicado', 'pred', 'predicate', 'relation'))} AS plano, lower({_FIELD('cuando', 'when')}) AS cuando FROM {_listed('relaciones', 'relations')} AS l), "
    f"ends AS (SELECT r.*, p.predicado, p.de, p.a_tipo, a.i AS a, b.i AS b, a.tipo AS ta, b.tipo AS tb FROM rel AS r LEFT JOIN {_FITS} ON p.plano = r.plano LEFT JOIN named AS a ON a.wp_id = r.wp_id AND a.pi = r.pi AND a.n = r.na LEFT JOIN named AS b ON b.wp_id = r.wp_id AND b.pi = r.pi AND b.n = r.nb), "
    "judged AS MATERIALIZED (SELECT *, CASE WHEN predicado IS NULL THEN 'rel_predicado_desconocido' WHEN na = '' OR nb = '' OR na = nb THEN 'rel_mal_formada' WHEN a IS NULL OR b IS NULL THEN 'rel_extremo_no_marcado' WHEN 'grupo generico' IN (ta, tb) THEN 'rel_con_senuelo' "
    f"WHEN NOT ((de = '' OR contains(de, {_LETTER.format('ta')})) AND (a_tipo = '' OR contains(a_tipo, {_LETTER.format('tb')}))) THEN 'rel_tipos_no_admitidos' END AS motivo FROM ends)"
)


def _read(s, t):
    return answers.read(t("answers"), predicates(s))


@query("answered_entities", f"WITH {_READ} SELECT wp_id, pi, i, ini, CAST(ini + length(dicho) AS INTEGER) AS fin, tipo, texto FROM taken")
def _(s, t):
    return _read(s, t).entities


@query(
    "answered_relations",
    f"WITH {_READ} SELECT wp_id, pi, CAST(orden AS INTEGER) AS orden, a, b, predicado, CASE WHEN cuando IN ('vigente', 'pasada', 'futura') THEN cuando ELSE 'vigente' END AS cuando FROM judged AS x WHERE motivo IS NULL "
    "AND NOT EXISTS (SELECT 1 FROM judged AS y WHERE y.motivo IS NULL AND y.wp_id = x.wp_id AND y.pi = x.pi AND y.predicado = x.predicado AND least(y.a, y.b) = least(x.a, x.b) AND greatest(y.a, y.b) = greatest(x.a, x.b) AND y.orden < x.orden)",
)
def _(s, t):
    return _read(s, t).relations


@query(
    "answers_refused",
    f"WITH {_READ}, m AS (SELECT 'json_invalido' AS motivo FROM sorted WHERE NOT ok UNION ALL SELECT motivo FROM ents UNION ALL SELECT motivo FROM judged) SELECT motivo, count(*) AS n FROM m WHERE motivo IS NOT NULL GROUP BY 1",
)
def _(s, t):
    return _read(s, t).refused.groupBy("motivo").agg(F.sum("n").alias("n"))


# Identities ---------------------------------------------------------------------------------------------------------------

_FOLDED = lambda c: _fold_sql(c, T.FOLD_FROM, T.FOLD_TO)
_BASE = (
    f"dec AS (SELECT tipo, decision, fuente, a, b, {_FOLDED('a')} AS na, {_FOLDED('b')} AS nb FROM decided WHERE decision <> 'posponer' AND fuente <> 'identidades' AND tipo IN {_LIST(identities.ACTORS)}), "
    "best AS MATERIALIZED (SELECT *, least(na, nb) AS u, greatest(na, nb) AS v FROM dec WHERE contains(na, ' ') AND contains(nb, ' ') QUALIFY row_number() OVER (PARTITION BY tipo, least(na, nb), greatest(na, nb) "
    "ORDER BY CASE fuente WHEN 'persona' THEN 3 WHEN 'quien-ai' THEN 2 WHEN 'regla' THEN 2 ELSE 1 END DESC, decision, a, b, fuente) = 1), "
    f"cur AS MATERIALIZED (SELECT grupo, nombre, {_FOLDED('nombre')} AS n FROM curated), "
    "links AS MATERIALIZED (SELECT tipo, u, v, fuente FROM best WHERE decision = 'misma' AND u <> v UNION SELECT 'persona', x.n, y.n, 'quien-ai' FROM cur AS x JOIN cur AS y ON x.grupo = y.grupo AND x.n < y.n), "
    "both_ways AS MATERIALIZED (SELECT tipo, u, v FROM links UNION SELECT tipo, v, u FROM links), "
    "reach AS (SELECT DISTINCT tipo, u AS n, u AS m FROM both_ways UNION SELECT r.tipo, r.n, e.v FROM reach AS r JOIN both_ways AS e ON e.tipo = r.tipo AND e.u = r.m), "
    "roots AS MATERIALIZED (SELECT tipo, n, min(m) AS root FROM reach GROUP BY 1, 2), "
    "forms AS MATERIALIZED (SELECT f.tipo, f.n, f.forma, coalesce(r.root, f.n) AS root FROM (SELECT tipo, n, arg_min(nombre, {'l': -length(nombre), 'n': nombre}) AS forma FROM (SELECT tipo, a AS nombre, na AS n FROM best UNION SELECT tipo, b, nb FROM best UNION SELECT 'persona', nombre, n FROM cur) AS w GROUP BY 1, 2) AS f LEFT JOIN roots AS r ON r.tipo = f.tipo AND r.n = f.n), "
    "grp AS (SELECT tipo, root, list(forma ORDER BY length(forma) DESC, forma) AS fs FROM forms GROUP BY 1, 2 HAVING count(*) > 1), "
    "src AS (SELECT l.tipo, r.root, list_sort(list_distinct(list(fuente))) AS fuentes FROM links AS l JOIN roots AS r ON r.tipo = l.tipo AND r.n = l.u GROUP BY 1, 2), "
    "entries AS MATERIALIZED (SELECT g.tipo, 'misma' AS clase, fs[1] AS canonico, fs[2:] AS formas, fuentes FROM grp AS g JOIN src AS s ON s.tipo = g.tipo AND s.root = g.root "
    "UNION ALL SELECT b.tipo, CASE WHEN x.root = y.root THEN 'conflicto' ELSE 'distinta' END, NULL, [x.forma, y.forma], [b.fuente] FROM best AS b JOIN forms AS x ON x.tipo = b.tipo AND x.n = b.u JOIN forms AS y ON y.tipo = b.tipo AND y.n = b.v WHERE b.decision = 'distinta')"
)


@query("identity_base", f"WITH RECURSIVE {_BASE} SELECT tipo, clase, canonico, array_to_string(formas, '|') AS formas, array_to_string(fuentes, ',') AS fuentes FROM entries")
def _(s, t):
    found = identities.base(t("decided"), t("curated"))
    return found.withColumns({"formas": F.array_join("formas", "|"), "fuentes": F.array_join("fuentes", ",")})


_OPEN = "SELECT concat('q', CAST(k AS STRING), '-', CAST(z AS STRING)) AS clave, tipo, a, b FROM (SELECT k, 3 AS z, tipo, lower(a) AS a, concat('Casa norte ', CAST(k + 3 AS STRING)) AS b FROM {decided} UNION SELECT k, 2, tipo, a, concat('Casa norte ', CAST(k + 2 AS STRING)) FROM {decided}) AS x"


@query(
    "applied_identities",
    f"WITH RECURSIVE {_BASE}, q AS (SELECT clave, tipo, {_FOLDED('a')} AS fa, {_FOLDED('b')} AS fb FROM ({_OPEN.format(decided='decided')}) AS o WHERE clave NOT IN (SELECT replace(clave, 'c', 'q') FROM decided)), "
    "e AS MATERIALIZED (SELECT DISTINCT tipo, clase, id, " + _FOLDED("f") + " AS f FROM (SELECT tipo, clase, row_number() OVER () AS id, unnest(list_filter(list_prepend(canonico, formas), lambda z: z IS NOT NULL)) AS f FROM entries WHERE clase <> 'conflicto') AS u) "
    "SELECT q.clave, min(x.clase) AS decision, 0.9::DOUBLE AS confianza, 'identidades' AS fuente FROM q JOIN e AS x ON x.tipo = q.tipo AND x.f = q.fa JOIN e AS y ON y.id = x.id AND y.f = q.fb WHERE q.fa <> q.fb GROUP BY 1 HAVING count(DISTINCT x.clase) = 1",
)
def _(s, t):
    cases = s.sql(_OPEN, decided=t("decided"))
    done = t("decided").select(F.translate("clave", "c", "q").alias("clave"))
    return identities.applied(cases, identities.base(t("decided"), t("curated")), done)


_CASES = "SELECT clave, tipo, CASE WHEN k % 10 = 0 THEN 1.0 ELSE 0.5 END AS confianza, CASE WHEN k % 4 = 0 THEN 'el mismo cargo' ELSE 'otro' END AS motivo FROM {decided}"
_VERDICTS = "SELECT clave, CASE CAST(k % 6 AS INT) WHEN 0 THEN 'Misma' WHEN 1 THEN 'distinta' WHEN 2 THEN 'ambiguo' ELSE decision END AS veredicto, (k % 20) / 20.0 AS confianza, concat('por ', b) AS razon FROM {decided} WHERE k % 12 <> 5"


@query(
    "settled_cases",
    f"WITH c AS ({_CASES.format(decided='decided')}), w AS ({_VERDICTS.format(decided='decided')}), x AS (SELECT c.clave, c.confianza >= 0.99 AS sure, tipo = 'cargo' AND starts_with(motivo, 'el mismo cargo') AS post, lower(veredicto) AS v, CAST(w.confianza AS DOUBLE) AS k, razon FROM c LEFT JOIN w ON w.clave = c.clave) "
    "SELECT clave, CASE WHEN sure OR post THEN 'misma' WHEN v IN ('misma', 'distinta') AND k >= 0.75 THEN v ELSE 'posponer' END AS decision, CASE WHEN sure THEN 1.0 WHEN post THEN 0.85 ELSE k END AS confianza, CASE WHEN sure OR post THEN 'regla' ELSE 'juez' END AS fuente, "
    "CASE WHEN sure THEN 'el mismo nombre con otra grafía' WHEN post THEN 'el mismo cargo con o sin «ex»' WHEN v IN ('misma', 'distinta') AND k >= 0.75 THEN razon WHEN v = 'ambiguo' THEN concat('ambiguo: ', razon) ELSE concat('duda: ', razon) END AS razon FROM x WHERE sure OR post OR v IS NOT NULL",
)
def _(s, t):
    return identities.settled(s.sql(_CASES, decided=t("decided")), s.sql(_VERDICTS, decided=t("decided")))


@query("resolution_progress", "SELECT count(*) FILTER (decision <> 'posponer') AS decididas, count(*) FILTER (decision = 'posponer') AS pospuestas FROM decided")
def _(s, t):
    return resolve.progress(t("decided"))


@query("decided_keys", "SELECT DISTINCT clave FROM decided WHERE decision <> 'posponer'")
def _(s, t):
    return review.decided_keys(t("decided"))


@query("newest_decisions", "SELECT clave, decision, k AS decidido_at FROM decided ORDER BY k DESC, clave LIMIT 200")
def _(s, t):
    return review.decisions_newest_first(t("decided").select("clave", "decision", F.col("k").alias("decidido_at")), 200)


@query("decisions_agree", f"WITH w AS ({_VERDICTS.format(decided='decided')}) SELECT count(*) FILTER (decision = lower(veredicto)) AS coinciden, count(*) FILTER (decision <> lower(veredicto)) AS difieren FROM decided AS d JOIN w ON w.clave = d.clave")
def _(s, t):
    return evaluate.decisions_agree(t("decided"), s.sql(_VERDICTS, decided=t("decided")).select("clave", F.lower("veredicto").alias("decision")))


# What outside runs found --------------------------------------------------------------------------------------------------

_FLAT = f"translate({_UI('parrafo')}, '#', ' ')"


def _near(name: str, near: str) -> str:
    """The place nearest to another of a name or, where it is nowhere, of its last word."""
    at = lambda n: f"(list_sort(list_transform(list_filter(range(CAST(length(parrafo) AS BIGINT)), lambda i: substr(flat, i + 1, length({n})) = {n} AND NOT regexp_matches(substr(flat, i, 1), '\\w') AND NOT regexp_matches(substr(flat, i + length({n}) + 1, 1), '\\w')), lambda i: {{'d': abs(i - {near}), 'i': i, 'n': length({n})}})))[1]"
    return f"coalesce({at(name)}, CASE WHEN length(string_split({name}, ' ')[-1]) >= 4 THEN {at(f'string_split({name}, chr(32))[-1]')} END)"


_QUOTE = "lower(strip_accents(trim(regexp_replace({0}, '\\s+', ' ', 'g'))))"
_HELD = "CASE WHEN length({q}) >= 20 AND strpos({p}, {q}) > 0 THEN strpos({p}, {q}) - 1 END"
_RUNS = (
    f"r AS (SELECT s.*, CASE WHEN NOT contains(url, 'y.org') THEN CAST(regexp_extract(url, '[0-9]+$') AS BIGINT) END AS wp_id, {_FOLDED('a')} AS fa, {_FOLDED('b')} AS fb, upper(trim(relacion)) AS x FROM said_in_runs AS s), "
    f"m AS (SELECT r.*, p.pi, parrafo, {_FLAT} AS flat, {_HELD.format(q=_QUOTE.format('cita1'), p=_QUOTE.format('parrafo'))} AS e1, {_HELD.format(q=_QUOTE.format('cita2'), p=_QUOTE.format('parrafo'))} AS e2 FROM r LEFT JOIN spoken AS p ON p.wp_id = r.wp_id AND p.pi = 1), "
    f"n AS MATERIALIZED (SELECT *, coalesce(e1, e2) AS en FROM m), h AS MATERIALIZED (SELECT *, {_near('fa', 'en')} AS ha, {_near('fb', 'en')} AS hb FROM n), "
    f"k AS (SELECT *, CASE x {' '.join(f"WHEN '{w}' THEN '{p}'" for w, (p, _) in checks.OUTSIDE_KIN.items())} ELSE CASE WHEN x IN {_LIST(checks.GENERIC_KIN)} THEN 'familiar de' END END AS pred FROM h), "
    "w AS MATERIALIZED (SELECT *, CASE WHEN coalesce(trim(cita1), '') = '' AND coalesce(trim(cita2), '') = '' THEN 'sin_cita' WHEN wp_id IS NULL THEN 'sin_noticia' WHEN a IS NULL OR b IS NULL THEN 'sin_entidad' WHEN en IS NULL THEN 'cita_no_hallada' WHEN ha IS NULL OR hb IS NULL THEN 'extremo_no_hallado' "
    f"WHEN ha.i = hb.i AND ha.n = hb.n THEN 'mismo_tramo' WHEN pred IS NULL AND NOT x IN {_LIST(checks.TO_TELL_APART)} THEN 'tipo_desconocido' END AS motivo FROM k), "
    "g AS (SELECT *, row_number() OVER (PARTITION BY wp_id, ha.i, ha.n, hb.i, hb.n, coalesce(pred, x) ORDER BY corrida, id) AS turno, list(corrida) OVER (PARTITION BY wp_id, ha.i, ha.n, hb.i, hb.n, coalesce(pred, x)) AS cs FROM w WHERE motivo IS NULL)"
)


def _of_runs(t):
    rows = t("said_in_runs").withColumn("citas", F.array("cita1", "cita2"))
    census = t("customer").select(F.col("c_custkey").alias("wp_id"), F.concat(F.lit("https://www.x.org/n/"), F.col("c_custkey").cast("string"), F.lit("/")).alias("link"))
    return alignment.relations_of_runs(rows, census, t("spoken"))


@query(
    "relations_of_runs",
    f"WITH {_RUNS} SELECT id, wp_id, pi, CAST(ha.i AS INTEGER) AS a_ini, CAST(ha.i + ha.n AS INTEGER) AS a_fin, CAST(hb.i AS INTEGER) AS b_ini, CAST(hb.i + hb.n AS INTEGER) AS b_fin, substr(parrafo, hb.i + 1, hb.n) AS b_texto, CASE WHEN clase_b = 'raro' THEN NULL ELSE 'organizacion' END AS b_tipo, "
    "pred AS predicado, x AS relacion, array_to_string(list_sort(list_distinct(cs)), ',') AS corridas FROM g WHERE turno = 1",
)
def _(s, t):
    found = _of_runs(t)[0]
    return found.select("id", "wp_id", "pi", *(F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in "ab" for c in ("ini", "fin")), F.col("b.texto").alias("b_texto"), F.col("b.tipo").alias("b_tipo"), "predicado", "relacion", F.array_join("corridas", ",").alias("corridas"))


@query(
    "outcomes_of_runs",
    f"WITH {_RUNS}, o AS (SELECT corrida, motivo FROM w WHERE motivo IS NOT NULL UNION ALL SELECT corrida, CASE WHEN turno = 1 THEN 'alineada' ELSE 'duplicada' END FROM g) SELECT corrida, motivo, count(*) AS n FROM (SELECT * FROM o UNION ALL SELECT corrida, 'total' FROM o) AS u GROUP BY 1, 2",
)
def _(s, t):
    return alignment.report_of_runs(_of_runs(t)[1])


@query(
    "posts_of_runs",
    f"WITH c AS (SELECT *, CASE WHEN contains(url, 'y.org') THEN 'sin_persona_o_noticia' WHEN lower(cargo) IN {_LIST(alignment.LOOSE_TRADES)} OR cargo = lower(cargo) AND NOT contains(cargo, ' ') THEN 'oficio_suelto' WHEN cargo <> 'del norte' THEN 'no_hallado' END AS m FROM said_in_runs WHERE length(cargo) >= 4), "
    "d AS (SELECT corrida, coalesce(m, CASE WHEN row_number() OVER (PARTITION BY a, m ORDER BY corrida, id) = 1 THEN 'alineado' ELSE 'duplicado' END) AS motivo FROM c) SELECT corrida, motivo, count(*) AS n FROM (SELECT * FROM d UNION ALL SELECT corrida, 'total' FROM d) AS u GROUP BY 1, 2",
)
def _(s, t):
    rows = t("said_in_runs").select("id", "corrida", "url", F.col("a").alias("persona"), F.col("clase_a").alias("clase"), "cargo")
    census = t("customer").select(F.col("c_custkey").alias("wp_id"), F.concat(F.lit("https://www.x.org/n/"), F.col("c_custkey").cast("string")).alias("link"))
    return alignment.report_of_runs(alignment.posts_of_runs(rows, census, t("spoken"))[1])


# A person and a country marked once, each said twice.
_ONCE = (
    "SELECT c_custkey AS wp_id, 1 AS pi, 0 AS ini, CAST(length(c_name) AS INT) AS fin, c_name AS texto, 'persona' AS tipo FROM {customer} UNION ALL "
    "SELECT c_custkey, 1, CAST(length(c_name) + 9 AS INT), CAST(length(c_name) + 9 + length(n_name) AS INT), replace(n_name, '_', ' '), 'lugar' FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 0"
)


@query(
    "repeated_mentions",
    f"WITH m AS ({_ONCE.format(customer='customer', nation='nation')}) SELECT m.wp_id, m.pi, CAST(fin + strpos(substr(parrafo, fin + 1), texto) - 1 AS INTEGER) AS ini, CAST(fin + strpos(substr(parrafo, fin + 1), texto) - 1 + length(texto) AS INTEGER) AS fin, tipo, texto FROM m JOIN spoken AS s ON s.wp_id = m.wp_id AND s.pi = m.pi",
)
def _(s, t):
    return training.repeated(t("spoken"), s.sql(_ONCE, customer=t("customer"), nation=t("nation")))
