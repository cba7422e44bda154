"""Registered queries of checks, strata and training rows; they join those of `archive`, whose registry holds them all."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import checks
from tessera.functions.vocabulary import predicates
from tessera.operators import relations, resolve, review, training
from tessera.plans.archive import _PAIRS, ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES"]


def _re(pattern: str) -> str:
    """A pattern as a SQL string for an engine whose i flag knows accented letters by itself."""
    return "'" + pattern.replace("(?iu", "(?i").replace("'", "''") + "'"


def _gate(stratum: str) -> str:
    return " AND ".join(f"regexp_matches(parrafo, {_re(p)})" for p in checks.GATES[stratum])


_LIST = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_SMALL = "substr(p[1], 1, 1) = lower(substr(p[1], 1, 1))"
_WORDS = "SELECT *, string_split(trim(regexp_replace(texto, '\\s+', ' ', 'g')), ' ') AS p FROM written"


@query(
    "mark_warnings",
    "SELECT wp_id, pi, ini, tipo, texto, array_to_string(list_filter(["
    f"CASE WHEN len(p) > 1 AND lower(p[1]) IN {_LIST(checks.ARTICLES)} AND {_SMALL} THEN 'articulo' END, "
    f"CASE WHEN tipo NOT IN ('cargo', 'monto') AND regexp_replace(lower(p[1]), '[.,;:«»()]', '', 'g') IN {_LIST(checks.COMMON_NOUNS)} AND {_SMALL} THEN 'generica' END, "
    f"CASE WHEN tipo <> 'cargo' AND len(p) <= 3 AND ends_with(p[1], 's') AND lower(p[1]) IN {_LIST(checks.COMMON_NOUNS)} AND {_SMALL} THEN 'plural' END, "
    "CASE WHEN len(p) > 8 THEN 'larga' END], lambda x: x IS NOT NULL), ',') AS avisos, "
    f"CASE WHEN len(p) > 1 AND lower(p[1]) IN {_LIST(checks.ARTICLES)} AND {_SMALL} THEN array_to_string(p[2:], ' ') ELSE trim(texto) END AS arreglo FROM ({_WORDS}) AS w",
)
def _(s, t):
    x = F.col("texto")
    return t("written").select("wp_id", "pi", "ini", "tipo", "texto", F.array_join(checks.warnings(x, F.col("tipo")), ",").alias("avisos"), checks.without_article(x).alias("arreglo"))


@query(
    "nameable_entities",
    f"SELECT wp_id, pi, ini, tipo, texto, CASE tipo WHEN 'monto' THEN regexp_matches(texto, {_re(checks.AMOUNT)}) WHEN 'persona' THEN lower(trim(texto)) NOT IN {_LIST(checks.PRONOUNS)} AND (starts_with(ltrim(texto), '@') OR texto <> lower(texto)) ELSE true END AS vale FROM written",
)
def _(s, t):
    return t("written").select("wp_id", "pi", "ini", "tipo", "texto", checks.nameable(F.col("texto"), F.col("tipo")).alias("vale"))


@query("kinship_words", f"SELECT wp_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(parrafo), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, {_re(checks.KINSHIP)})))), ',') AS palabras FROM phrases")
def _(s, t):
    return t("phrases").select("wp_id", F.array_join(checks.kinship_words(F.col("parrafo")), ",").alias("palabras"))


_GLUED = (
    f"WITH m AS (SELECT *, regexp_extract(texto, {_re(checks.GLUED_TITLE)}, 1) AS t, regexp_extract(texto, {_re(checks.GLUED_TITLE)}, 2) AS n FROM written), "
    "c AS (SELECT *, tipo = 'persona' AND t <> '' AND trim(n) <> '' AND len(string_split_regex(t, '\\s+')) <= 3 AS cut FROM m), "
    "g AS (SELECT DISTINCT wp_id, pi, fin - CAST(length(n) AS INTEGER) AS ini, fin, ini + CAST(strpos(texto, t) AS INTEGER) - 1 AS ini_t, ini + CAST(strpos(texto, t) + length(t) AS INTEGER) - 1 AS fin_t, t, n FROM c WHERE cut), "
    "f AS (SELECT g.*, (SELECT min(o.ini) FROM c AS o WHERE o.tipo = 'cargo' AND o.wp_id = g.wp_id AND o.pi = g.pi AND o.ini <= g.ini_t AND o.fin >= g.fin_t) AS cargo FROM g) "
)


@query(
    "split_titles",
    _GLUED + "SELECT wp_id, pi, ini, fin, tipo, texto FROM c WHERE NOT cut UNION ALL SELECT wp_id, pi, ini, fin, 'persona', n FROM f UNION ALL SELECT DISTINCT wp_id, pi, ini_t, fin_t, 'cargo', t FROM f WHERE cargo IS NULL",
)
def _(s, t):
    return training.split_titles(t("written"))[0]


@query("title_relations", _GLUED + "SELECT DISTINCT wp_id, pi, ini AS a, coalesce(cargo, ini_t) AS b, 'ocupa el cargo' AS predicado, CASE WHEN starts_with(lower(t), 'ex') THEN 'pasada' ELSE 'vigente' END AS cuando FROM f")
def _(s, t):
    return training.split_titles(t("written"))[1]


_STRATA = (
    "WITH r AS (SELECT wp_id, CAST(orden % 3 AS INTEGER) AS pi, bool_or(predicado <> 'socio de') AS f FROM relations GROUP BY 1, 2), "
    "x AS (SELECT p.wp_id, p.pi, p.parrafo, r.f, coalesce(r.f, false) AS fam, p.wp_id % 4 = 0 AS c FROM phrases AS p LEFT JOIN r ON r.wp_id = p.wp_id AND r.pi = p.pi) "
    "SELECT wp_id, pi, 'F' AS estrato FROM x WHERE fam UNION ALL SELECT wp_id, pi, 'PL' FROM x WHERE NOT f "
    f"UNION ALL SELECT wp_id, pi, 'J' FROM x WHERE c AND NOT fam AND {_gate('J')} UNION ALL SELECT wp_id, pi, 'E' FROM x WHERE {_gate('E')} "
    f"UNION ALL SELECT wp_id, pi, 'N' FROM x WHERE {_gate('N')} UNION ALL SELECT wp_id, pi, 'A' FROM x WHERE {_gate('A')} UNION ALL SELECT wp_id, pi, 'R' FROM x"
)


@query("stratum_members", _STRATA)
def _(s, t):
    r = t("relations").select("wp_id", (F.col("orden") % 3).cast("int").alias("pi"), F.when(F.col("predicado") != "socio de", F.col("predicado")).alias("predicado"))
    return training.strata(t("phrases"), r, t("census").where("wp_id % 4 = 0"))


@query(
    "pilot_sample",
    "SELECT wp_id, pi, estrato FROM (SELECT *, row_number() OVER (PARTITION BY estrato ORDER BY md5(concat('7|', wp_id, '|', pi)), wp_id, pi) AS o FROM (SELECT wp_id, pi, CASE WHEN f THEN 'F' WHEN NOT f THEN 'PL' ELSE 'EN' END AS estrato "
    "FROM (SELECT p.wp_id, p.pi, r.f FROM phrases AS p LEFT JOIN (SELECT wp_id, CAST(orden % 3 AS INTEGER) AS pi, bool_or(predicado <> 'socio de') AS f FROM relations GROUP BY 1, 2) AS r ON r.wp_id = p.wp_id AND r.pi = p.pi) AS x) AS y) AS z "
    "WHERE o <= CASE estrato WHEN 'F' THEN 30 WHEN 'PL' THEN 20 ELSE 10 END",
)
def _(s, t):
    r = t("relations").groupBy("wp_id", (F.col("orden") % 3).cast("int").alias("pi")).agg(F.bool_or(F.col("predicado") != "socio de").alias("f"))
    kind = F.when(F.col("f"), "F").when(~F.col("f"), "PL").otherwise("EN")
    return training.pilot_sample(t("phrases").join(r, ["wp_id", "pi"], "left").select("wp_id", "pi", kind.alias("estrato")), {"F": 30, "PL": 20, "EN": 10})


@query(
    "alias_import",
    "WITH n AS (SELECT a AS nombre, concat('p', CAST(clave % 40 % 7 AS STRING)) AS perfil FROM alias_cases UNION ALL SELECT b, concat('p', CAST(clave % 7 AS STRING)) FROM alias_cases), "
    "o AS (SELECT nombre, min(perfil) AS ficha FROM n WHERE length(nombre) % 2 = 0 GROUP BY 1), u AS (SELECT nombre, min(perfil) AS u FROM n GROUP BY 1 HAVING count(DISTINCT perfil) = 1 AND count(*) >= 2), "
    "g AS (SELECT DISTINCT nombre, length(nombre) AS grupo FROM n WHERE contains(nombre, 'luz') OR contains(nombre, '1')), "
    "x AS (SELECT c.*, o1.ficha AS fa, u1.u AS ua, o2.ficha AS fb, u2.u AS ub, EXISTS (SELECT 1 FROM g AS g1 JOIN g AS g2 ON g1.grupo = g2.grupo WHERE g1.nombre = a AND g2.nombre = b) AS g FROM alias_cases AS c "
    "LEFT JOIN o AS o1 ON o1.nombre = a LEFT JOIN o AS o2 ON o2.nombre = b LEFT JOIN u AS u1 ON u1.nombre = a LEFT JOIN u AS u2 ON u2.nombre = b) "
    "SELECT clave, a, b, CASE WHEN g OR coalesce(ua = ub, false) THEN 'misma' ELSE 'distinta' END AS decision, CASE WHEN g THEN 0.95 ELSE 0.9 END AS confianza FROM x WHERE g OR ua = ub OR (clave % 4 <> 0 AND coalesce(fa, ua) <> coalesce(fb, ub))",
)
def _(s, t):
    c = t("alias_cases")
    p = lambda k: F.concat(F.lit("p"), (k % 7).cast("string")).alias("perfil")
    n = c.select(F.col("a").alias("nombre"), p(F.col("clave") % 40)).union(c.select("b", p(F.col("clave"))))
    curated = n.where(F.col("nombre").contains("luz") | F.col("nombre").contains("1")).select(F.length("nombre").alias("grupo"), "nombre").distinct()
    return resolve.imported_aliases(c, curated, n.where(F.length("nombre") % 2 == 0), n)


@query(
    "pilot_report",
    "WITH r AS (SELECT event_type AS modelo, event_id % 11 = 0 AS invalido, CAST(event_id % 97 AS DOUBLE) AS segundos, event_id % 301 AS tokens FROM events), "
    "o AS (SELECT modelo, segundos, row_number() OVER (PARTITION BY modelo ORDER BY segundos) - 1 AS i, count(*) OVER (PARTITION BY modelo) AS n FROM r) "
    "SELECT r.modelo, count(*) AS parrafos, count(*) FILTER (invalido) AS invalidos, round(median(segundos), 6) AS mediana, round(median(CASE WHEN NOT invalido AND tokens > 0 AND segundos > 0 THEN tokens / segundos END), 6) AS fichas_s, (SELECT min(segundos) FROM o WHERE o.modelo = r.modelo AND i = floor(n * 0.9)) AS p90 FROM r GROUP BY 1",
)
def _(s, t):
    e = F.col("event_id")
    return training.pilot_report(t("events").select(F.col("event_type").alias("modelo"), (e % 11 == 0).alias("invalido"), (e % 97).cast("double").alias("segundos"), (e % 301).alias("tokens")))


@query(
    "model_table",
    "WITH a AS (SELECT section AS modelo, wp_id, wp_id % 700 + 1 AS palabras, wp_id % 90 AS segundos FROM census) SELECT modelo, articulos, seg_mil, coalesce(entidades, 0) AS entidades, coalesce(genericas, 0) AS genericas, coalesce(relaciones, 0) AS relaciones FROM "
    "(SELECT modelo, count(*) AS articulos, round(sum(segundos) * 1000 / sum(palabras), 6) AS seg_mil FROM a GROUP BY 1) AS x LEFT JOIN "
    "(SELECT modelo, count(*) AS entidades, round(count(*) FILTER (tipo NOT IN ('cargo', 'monto') AND NOT regexp_matches(texto, '[\\p{Lu}\\p{Nd}]')) / greatest(count(*) FILTER (tipo NOT IN ('cargo', 'monto')), 1), 6) AS genericas FROM written JOIN a USING (wp_id) GROUP BY 1) AS y USING (modelo) LEFT JOIN "
    "(SELECT modelo, count(*) AS relaciones FROM relations JOIN a USING (wp_id) GROUP BY 1) AS z USING (modelo)",
)
def _(s, t):
    a = t("census").select(F.col("section").alias("modelo"), "wp_id", (F.col("wp_id") % 700 + 1).alias("palabras"), (F.col("wp_id") % 90).alias("segundos"))
    who = a.select("wp_id", "modelo")
    return training.model_table(a, t("written").join(who, "wp_id").withColumn("score", F.lit(0.5)), t("relations").join(who, "wp_id"))


@query("batch_taxonomy", "SELECT wp_id, CASE CAST(wp_id % 3 AS INTEGER) WHEN 2 THEN 'place' ELSE 'categories' END AS taxonomia FROM batch")
def _(s, t):
    said = F.when(F.col("wp_id") % 3 == 1, "").when(F.col("wp_id") % 3 == 2, "place")
    return review.batch_taxonomy(t("batch").select("wp_id", said.alias("taxonomia")))


@query(
    "finding_examples",
    "SELECT hallazgo, wp_id, titulo, nota, CAST(orden AS INTEGER) AS orden FROM (SELECT section AS hallazgo, f.wp_id, CASE WHEN f.wp_id % 5 = 0 THEN '(sin título)' ELSE title END AS titulo, CASE WHEN date_valid THEN date ELSE '' END AS nota, row_number() OVER (PARTITION BY section ORDER BY f.wp_id) AS orden FROM census AS f) AS x WHERE orden <= 3",
)
def _(s, t):
    c = t("census")
    found = c.select(F.col("section").alias("hallazgo"), "wp_id", F.when(F.col("date_valid"), F.col("date")).alias("nota"))
    return review.examples(found, c.withColumn("title", F.when(F.col("wp_id") % 5 != 0, F.col("title"))), 3)


@query(
    "predicate_menu",
    f"SELECT tipo_a, tipo_b, CAST(sum(n) AS BIGINT) AS opciones, sum(n) <= 9 AS directo, string_agg(familia, ',' ORDER BY o) AS familias FROM (SELECT tipo_a, tipo_b, p.familia, count(*) AS n, min(orden) AS o FROM {_PAIRS} WHERE (desde = '' OR contains(desde, a.sigla)) AND (hasta = '' OR contains(hasta, b.sigla)) GROUP BY 1, 2, 3) AS x GROUP BY 1, 2",
)
def _(s, t):
    return review.predicate_menu(relations.applicable(t("type_pairs"), predicates(s)))


@query("kin_by_paragraph", "SELECT wp_id, CAST(orden % 3 AS INTEGER) AS pi, string_agg(concat(a, '|', predicado, '|', b), ';' ORDER BY concat(a, '|', predicado, '|', b)) AS relaciones FROM relations WHERE predicado <> 'apoya a' GROUP BY 1, 2")
def _(s, t):
    r = t("relations").withColumns({"pi": (F.col("orden") % 3).cast("int"), "predicado": F.when(F.col("predicado") != "apoya a", F.col("predicado"))})
    return review.kin_by_paragraph(r).withColumn("relaciones", F.array_join("relaciones", ";"))


_ENDS = "SELECT wp_id, pi, texto, min(ini) AS i FROM written GROUP BY 1, 2, 3"


@query(
    "resolved_ends",
    f"WITH e AS ({_ENDS}) SELECT h.wp_id, h.pi, x.i AS a, y.i AS b, h.cuenta AS predicado, h.score FROM (SELECT wp_id, pi, min(texto) AS cabeza, max(texto) AS cola, CAST(count(*) AS STRING) AS cuenta, 0.5 AS score FROM written GROUP BY 1, 2) AS h JOIN e AS x ON x.wp_id = h.wp_id AND x.pi = h.pi AND x.texto = h.cabeza JOIN e AS y ON y.wp_id = h.wp_id AND y.pi = h.pi AND y.texto = h.cola WHERE x.i <> y.i",
)
def _(s, t):
    w = t("written")
    said = w.groupBy("wp_id", "pi").agg(F.min("texto").alias("cabeza"), F.max("texto").alias("cola"), F.count("*").cast("string").alias("predicado"), F.lit(0.5).alias("score"))
    return training.resolved_ends(w.select("wp_id", "pi", F.col("ini").alias("i"), "texto"), said)


@query(
    "paragraph_hints",
    "SELECT wp_id, pi, texto, arg_min(tipo, x) AS tipo FROM (SELECT wp_id, CAST(orden % 3 AS INTEGER) AS pi, a AS texto, 'persona' AS tipo, orden * 2 AS x FROM relations UNION ALL SELECT wp_id, CAST(orden % 3 AS INTEGER), b, 'lugar', orden * 2 + 1 FROM relations "
    "UNION ALL SELECT wp_id, CAST(orden % 3 AS INTEGER), a, 'persona', 1000 + orden * 2 FROM relations UNION ALL SELECT wp_id, CAST(orden % 3 AS INTEGER), concat('C', b), 'cargo', 1001 + orden * 2 FROM relations) AS u GROUP BY 1, 2, 3",
)
def _(s, t):
    r = t("relations").withColumn("pi", (F.col("orden") % 3).cast("int"))
    aligned = r.select("wp_id", "pi", "orden", "a", F.lit("persona").alias("tipo_a"), "b", F.lit("lugar").alias("tipo_b"))
    return training.hints(aligned, r.select("wp_id", "pi", "orden", F.col("a").alias("persona"), F.concat(F.lit("C"), "b").alias("cargo")))


@query(
    "gold_rows",
    "WITH m AS (SELECT *, row_number() OVER (PARTITION BY wp_id, pi ORDER BY ini, fin, mid) - 1 AS i FROM (SELECT wp_id, pi - 1 AS pi, mid, ini, fin FROM marks WHERE pi >= 1 AND tipo <> 'lugar') AS x), "
    "r AS (SELECT a.wp_id, a.pi, count(*) AS n, sum(a.i * 100 + b.i) AS suma FROM (SELECT wp_id, min(mid) AS x, max(mid) AS y FROM marks GROUP BY 1) AS q JOIN m AS a ON a.wp_id = q.wp_id AND a.mid = q.x JOIN m AS b ON b.wp_id = q.wp_id AND b.mid = q.y WHERE a.pi = b.pi GROUP BY 1, 2) "
    "SELECT m.wp_id, CAST(m.pi AS INTEGER) AS pi, count(*) AS entidades, coalesce(max(r.n), 0) AS relaciones, CAST(coalesce(max(r.suma), 0) AS BIGINT) AS suma FROM m LEFT JOIN r ON r.wp_id = m.wp_id AND r.pi = m.pi GROUP BY 1, 2",
)
def _(s, t):
    marks = t("marks").select("wp_id", (F.col("pi") - 1).alias("pi"), "mid", "ini", "fin", F.when(F.col("tipo") == "lugar", "evento").otherwise(F.col("tipo")).alias("tipo"), "texto")
    ties = t("marks").groupBy("wp_id").agg(F.min("mid").alias("a_mid"), F.max("mid").alias("b_mid")).withColumns({"predicado": F.lit("socio de"), "cuando": F.lit("vigente")})
    rows = training.gold_rows(marks, ties)
    n = F.coalesce(F.size("relaciones"), F.lit(0))
    total = F.coalesce(F.aggregate("relaciones", F.lit(0).cast("long"), lambda k, x: k + x["a"] * 100 + x["b"]), F.lit(0))
    return rows.select("wp_id", "pi", F.size("entidades").cast("long").alias("entidades"), F.greatest(n, F.lit(0)).cast("long").alias("relaciones"), total.alias("suma"))


def _case(pairs) -> str:
    return "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs) + " END"


_OURS = _case(checks.OUTSIDE_TYPES.items())
_KIN = _case((k, p) for k, (p, _) in checks.OUTSIDE_KIN.items())
_MUTUAL = _case((k, both) for k, (_, both) in checks.OUTSIDE_KIN.items())
_FATE = f"CASE WHEN {_KIN} IS NOT NULL THEN 'parentesco' WHEN x IN {_LIST(checks.GENERIC_KIN)} THEN 'familiar' WHEN x IN {_LIST(checks.TO_TELL_APART)} THEN 'reclasificar' END"
# Every kind of the outside list comes up, in small letters for odd events.
_ALL_SAID = [*checks.OUTSIDE_TYPES, *checks.OUTSIDE_KIN, *checks.GENERIC_KIN, *checks.TO_TELL_APART, "X"]
_SAID_AT = "CASE CAST(event_id % {n} AS INT) {cases} END".format(n=len(_ALL_SAID), cases=" ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_ALL_SAID)))
_SAID = f"CASE WHEN event_id % 2 = 0 THEN {_SAID_AT} ELSE concat(' ', lower({_SAID_AT})) END"


@query("outside_vocabulary", f"SELECT event_id, {_OURS} AS tipo, {_KIN} AS predicado, CAST({_MUTUAL} AS BOOLEAN) AS simetrico, {_FATE} AS destino FROM (SELECT event_id, upper(trim({_SAID})) AS x FROM events) AS e")
def _(s, t):
    e = t("events").select("event_id", F.expr(_SAID).alias("x"))
    kin = checks.outside_kin(F.col("x"))
    return e.select("event_id", checks.outside_type(F.col("x")).alias("tipo"), kin["predicado"].alias("predicado"), kin["simetrico"].alias("simetrico"), checks.outside_relation(F.col("x")).alias("destino"))


_MESSAGE = "concat(event_type, CASE CAST(event_id % 5 AS INTEGER) WHEN 0 THEN ': No encontre una REST API' WHEN 1 THEN ' TLS roto' WHEN 2 THEN '; escribe la direccion' ELSE '' END)"


@query(
    "site_messages",
    "SELECT event_id, CASE CAST(event_id % 5 AS INTEGER) WHEN 0 THEN 'err-sitio' WHEN 1 THEN 'err-https' WHEN 2 THEN 'err-url' ELSE 'err-red' END AS clase, "
    "CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'Newspack · WooCommerce · Alojado en WordPress.com' WHEN event_id % 2 = 0 THEN 'Newspack · WooCommerce' WHEN event_id % 3 = 0 THEN 'Alojado en WordPress.com' ELSE 'WordPress' END AS plataforma FROM events",
)
def _(s, t):
    e = F.col("event_id")
    spaces = F.when(e % 2 == 0, F.array(F.lit("wc/v3"), F.lit("newspack-ads/v1"))).otherwise(F.array(F.lit("wp/v2"), F.lit("a-jetpack")))
    return t("events").select("event_id", checks.error_class(F.expr(_MESSAGE)).alias("clase"), checks.platform(spaces, F.when(e % 3 == 0, "wpcom").otherwise("rest")).alias("plataforma"))


# No twins: tokens, places by regular expression and choices in turn; tests hold them against plain versions.


@query("training_examples")
def _(s, t):
    w = t("written").withColumns({"mid": F.concat_ws("-", "ini", "tipo", "texto"), "ini": F.col("ini") % 30}).withColumn("fin", F.col("ini") + 9)
    ends = w.groupBy("wp_id", "pi").agg(F.min("mid").alias("a_mid"), F.max("mid").alias("b_mid")).select("wp_id", "a_mid", "b_mid", F.lit("vínculo sin tipo").alias("predicado"), F.lit("vigente").alias("cuando"))
    rows = training.gold_rows(w, ends).join(t("phrases"), ["wp_id", "pi"])
    x = training.examples(rows, predicates(s))
    return x.select("wp_id", "pi", F.size("fichas").alias("fichas"), F.array_join(F.transform("ner", lambda n: F.concat_ws(":", n["p"], n["u"], n["tipo"])), ",").alias("ner"), F.array_join(F.transform("relaciones", lambda r: F.concat_ws(":", r["a"], r["b"])), ",").alias("relaciones"))


def _sheet(s, t):
    p = t("phrases")
    sheet = p.select("wp_id", "pi", F.explode(F.array(*(F.struct(F.lit(a).alias("texto"), F.lit(b).alias("tipo")) for a, b in (("Senado", "organizacion"), ("5", "monto"), ("senador", "cargo*"))))).alias("x")).select("wp_id", "pi", "x.*")
    said = p.select("wp_id", "pi", F.lit("senador").alias("a"), F.lit("vínculo sin tipo").alias("predicado"), F.lit("Senado").alias("b"), F.lit("vigente").alias("cuando"))
    there = lambda df, c: df.join(p, ["wp_id", "pi"]).where(F.contains("parrafo", c))
    return training.gold_sheet(p, there(sheet, F.col("texto")).drop("parrafo"), there(there(said, F.col("a")).drop("parrafo"), F.col("b")).drop("parrafo"), predicates(s))


@query("gold_sheet_marks")
def _(s, t):
    return _sheet(s, t)[0]


@query("held_out_choice")
def _(s, t):
    c = t("census").select("wp_id", F.col("section").alias("seccion"), F.expr("CASE WHEN date < '1994' THEN 'a' WHEN date < '1996' THEN 'b' ELSE 'c' END").alias("tramo"))
    return training.held_out(c, {"1-URGENT": 6, "2-HIGH": 3}, ("5-LOW",), ("a", "b", "c"))
