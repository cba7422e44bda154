"""The archive's tables projected onto the driver's tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations benchmark labels".split()
_KIND = "CASE CAST(l_suppkey % 4 AS INT) WHEN 0 THEN 'persona' WHEN 1 THEN 'organizacion' WHEN 2 THEN 'lugar' ELSE 'cargo' END"
VIEWS = {
    "census": "SELECT o_orderkey AS wp_id, substr(CAST(o_orderdate AS STRING), 1, 10) AS date, o_orderkey % 17 <> 0 AS date_valid, o_orderpriority AS section, "
    "concat('Título ', CAST(o_custkey % 500 AS STRING)) AS title, concat('titulo ', CAST(o_custkey % 500 AS STRING)) AS title_key FROM orders",
    "terms": "SELECT 'place' AS taxonomy, CAST(r_regionkey + 1 AS BIGINT) AS term_id, r_name AS name, CAST(0 AS BIGINT) AS parent FROM region "
    "UNION ALL SELECT 'place' AS taxonomy, CAST(n_nationkey + 101 AS BIGINT) AS term_id, n_name AS name, CAST(n_regionkey + 1 AS BIGINT) AS parent FROM nation",
    "bridge": "SELECT o_orderkey AS wp_id, 'place' AS taxonomy, CAST(c_nationkey + 101 AS BIGINT) AS term_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 23 <> 0 "
    "UNION ALL SELECT o_orderkey AS wp_id, 'place' AS taxonomy, CAST(n_regionkey + 1 AS BIGINT) AS term_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey % 2 = 0 AND o_orderkey % 23 <> 0",
    "batch": "SELECT o_orderkey AS wp_id, o_orderkey % 3 = 0 AS extraido, o_orderkey % 7 = 0 AS calibra FROM orders",
    # Every line is a mark, and most are proposals too.
    "marks": f"SELECT DISTINCT l_orderkey AS wp_id, CAST(l_linenumber * 100000 + l_suppkey AS BIGINT) AS mid, CAST(l_partkey % 3 AS INT) AS pi, CAST(l_suppkey % 40 AS INT) AS ini, "
    f"CAST(l_suppkey % 40 + 4 + l_partkey % 8 AS INT) AS fin, concat('Nombre ', CAST(l_partkey % 150 AS STRING)) AS texto, {_KIND} AS tipo, "
    "CASE WHEN l_partkey % 4 = 0 THEN concat('g', CAST(l_partkey % 5 AS STRING)) END AS grupo FROM lineitem",
    "proposals": f"SELECT DISTINCT l_orderkey AS wp_id, CAST(l_partkey % 3 AS INT) AS pi, CAST(l_suppkey % 40 + l_linenumber % 3 AS INT) AS ini, CAST(l_suppkey % 40 + 5 + l_partkey % 6 AS INT) AS fin, "
    f"concat('Nombre ', CAST(l_partkey % 150 AS STRING)) AS texto, {_KIND} AS tipo, round(l_discount * 10, 2) AS score FROM lineitem WHERE l_linenumber >= 2 OR l_orderkey % 3 <> 0",
    # Every line as a mark of an article in three, so that all lines are read and two articles in three are not reviewed.
    "reviewed": "SELECT wp_id - wp_id % 3 AS wp_id, mid, pi, ini, fin, texto, tipo, grupo FROM marks",
    # Every line as a proposal.
    "suggested": f"SELECT DISTINCT l_orderkey AS wp_id, CAST(l_partkey % 3 AS INT) AS pi, CAST(l_suppkey % 40 + l_linenumber % 3 AS INT) AS ini, CAST(l_suppkey % 40 + 5 + l_partkey % 6 AS INT) AS fin, "
    f"concat('Nombre ', CAST(l_partkey % 150 AS STRING)) AS texto, {_KIND} AS tipo, round(l_discount * 10, 2) AS score FROM lineitem",
    # Marks and proposals by their number in the paragraph, and relations between neighbours.
    "gold_ents": "SELECT wp_id, pi, CAST(row_number() OVER (PARTITION BY wp_id, pi ORDER BY ini, fin, mid) - 1 AS INT) AS i, ini, fin, tipo, mid FROM marks",
    "model_ents": "SELECT wp_id, pi, CAST(row_number() OVER (PARTITION BY wp_id, pi ORDER BY ini, fin, tipo, texto, score) - 1 AS INT) AS i, ini, fin, tipo, score FROM proposals",
    "gold_ties": "SELECT x.wp_id, x.pi, x.i AS a, y.i AS b, CASE CAST(x.mid % 3 AS INT) WHEN 0 THEN 'apoya a' WHEN 1 THEN 'socio de' ELSE 'dirige' END AS predicado "
    "FROM gold_ents AS x JOIN gold_ents AS y ON x.wp_id = y.wp_id AND x.pi = y.pi AND y.i = x.i + 1",
    "model_ties": "SELECT x.wp_id, x.pi, CASE WHEN x.fin % 4 = 0 THEN y.i ELSE x.i END AS a, CASE WHEN x.fin % 4 = 0 THEN x.i ELSE y.i END AS b, "
    "CASE CAST(x.ini % 3 AS INT) WHEN 0 THEN 'apoya a' WHEN 1 THEN 'socio de' ELSE 'dirige' END AS predicado, x.score, x.i AS orden FROM model_ents AS x JOIN model_ents AS y ON x.wp_id = y.wp_id AND x.pi = y.pi AND y.i = x.i + 1",
    "type_pairs": "SELECT DISTINCT x.tipo AS tipo_a, y.tipo AS tipo_b FROM written AS x JOIN written AS y ON x.wp_id = y.wp_id AND x.pi = y.pi",
    "canon_proposals": "SELECT *, CASE WHEN ini % 3 = 0 THEN concat('Nombre ', CAST(fin % 9 AS STRING)) END AS canon FROM proposals",
    "said_ties": "SELECT wp_id, pi, orden, a, b, predicado FROM (SELECT wp_id, pi, CAST(row_number() OVER w AS INT) AS orden, texto AS a, lead(texto) OVER w AS b, CASE CAST(ini % 2 AS INT) WHEN 0 THEN 'apoya a' ELSE 'dirige' END AS predicado "
    "FROM proposals WINDOW w AS (PARTITION BY wp_id, pi ORDER BY fin, ini, tipo, texto, score)) AS x WHERE b IS NOT NULL",
    "relations": "SELECT l_orderkey AS wp_id, concat('N', CAST(s_nationkey AS STRING)) AS a, concat('N', CAST(c_nationkey AS STRING)) AS b, "
    "CASE l_returnflag WHEN 'A' THEN 'apoya a' WHEN 'N' THEN 'socio de' ELSE 'familiar de' END AS predicado, CASE l_linestatus WHEN 'O' THEN 'vigente' ELSE 'pasada' END AS cuando, "
    "round(l_discount * 10, 2) AS score, l_linenumber AS orden FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey",
    "names": "SELECT nombre, tipo, CAST(count(*) AS BIGINT) AS menciones FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, ' ', p_type) ELSE p_name END AS nombre, "
    "CASE CAST(p_partkey % 3 AS INT) WHEN 1 THEN 'persona' ELSE 'organizacion' END AS tipo FROM part) AS x GROUP BY nombre, tipo",
    "phrases": "SELECT o_orderkey AS wp_id, CAST(o_custkey % 3 AS INT) AS pi, concat(CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN 'El fiscal investigó a su hermana y a los primos' WHEN 1 THEN 'Recibió 300 millones que donó el socio' "
    "WHEN 2 THEN 'La Ley 100 y el artículo 5' WHEN 3 THEN 'Renunció la candidata' WHEN 4 THEN 'Hubo TUTELA en la tarde' WHEN 5 THEN 'Nadie vino con su papá' ELSE 'Hijo del senador' END, "
    "CASE CAST(o_custkey % 5 AS INT) WHEN 0 THEN '. Pagó 5 pesos' WHEN 1 THEN '. Aspira al Senado' ELSE '. Fin' END) AS parrafo FROM orders",
    "written": "SELECT DISTINCT wp_id, pi, ini, CAST(ini + length(texto) AS INT) AS fin, tipo, texto FROM (SELECT l_orderkey AS wp_id, CAST(l_partkey % 3 AS INT) AS pi, CAST(l_suppkey % 40 AS INT) AS ini, "
    "CASE CAST(l_suppkey % 5 AS INT) WHEN 0 THEN 'persona' WHEN 1 THEN 'organizacion' WHEN 2 THEN 'lugar' WHEN 3 THEN 'monto' ELSE 'cargo' END AS tipo, "
    "concat(CASE CAST(l_partkey % 12 AS INT) WHEN 0 THEN 'el ' WHEN 1 THEN 'La ' WHEN 2 THEN 'senador ' WHEN 3 THEN 'la exministra ' WHEN 4 THEN 'el ex presidente liberal ' WHEN 5 THEN 'bandas ' WHEN 6 THEN 'empresa: ' "
    "WHEN 7 THEN 'una de las muchas cosas que dijo ayer la señora ' WHEN 8 THEN '@' WHEN 9 THEN 'Senadora verde ' ELSE '' END, CASE CAST(l_orderkey % 9 AS INT) WHEN 0 THEN 'usted' WHEN 1 THEN '300 millones' WHEN 2 THEN 'papá' "
    "WHEN 3 THEN 'mil' WHEN 4 THEN 'Nadie' ELSE concat('Nombre ', CAST(l_partkey % 150 AS STRING)) END) AS texto FROM lineitem) AS x",
    # A model's answers about paragraphs; < and > stand for braces, and some answers have English names, words around, or no JSON.
    "answers": "SELECT wp_id, pi, parrafo, CASE CAST(k % 11 AS INT) WHEN 0 THEN 'no hay nada' WHEN 1 THEN '[1]' WHEN 2 THEN concat('Va: ', x, ' y ya') WHEN 3 THEN replace(replace(replace(replace(x, '\"texto\"', '\"text\"'), '\"tipo\"', '\"type\"'), '\"entidades\"', '\"entities\"'), '\"relaciones\"', '\"relations\"') ELSE x END AS salida "
    "FROM (SELECT wp_id, pi, k, parrafo, translate(concat('<\"entidades\":[<\"texto\":\"', a, '\",\"tipo\":\"persona\">,<\"texto\":\" ', lower(a), '\",\"tipo\":\"Persona\">,7,<\"texto\":\"', b, '\",\"tipo\":\"', CASE CAST(k % 5 AS INT) WHEN 0 THEN 'Organización' WHEN 1 THEN 'lugar' WHEN 2 THEN 'grupo genérico' WHEN 3 THEN 'organizacion' ELSE 'raro' END, "
    "'\">,<\"texto\":\"', CASE CAST(k % 4 AS INT) WHEN 0 THEN '300 pesos' WHEN 1 THEN 'suma' WHEN 2 THEN 'ausente' ELSE '' END, '\",\"tipo\":\"monto\">,<\"texto\":\"ella\",\"tipo\":\"persona\">],\"relaciones\":[<\"a\":\"', a, '\",\"b\":\"', b, '\",\"', CASE WHEN k % 2 = 0 THEN 'pred' ELSE 'predicado' END, '\":\"', CASE CAST(k % 6 AS INT) WHEN 0 THEN 'raro' WHEN 1 THEN 'FUNDO' WHEN 2 THEN 'hijo de' ELSE 'dirige' END, "
    "'\",\"cuando\":\"', CASE CAST(k % 3 AS INT) WHEN 0 THEN 'Pasada' ELSE 'hoy' END, '\">,<\"a\":\"', a, '\",\"b\":\"', lower(a), '\",\"predicado\":\"socio de\">,<\"a\":\"', lower(a), '\",\"b\":\"', a, '\",\"predicado\":\"', CASE WHEN k % 7 < 3 THEN 'socio de' ELSE 'hijo de' END, '\">,<\"a\":\"', a, '\",\"b\":\"', CASE WHEN k % 2 = 0 THEN a ELSE 'Zz' END, '\",\"predicado\":\"dirige\">]>'), '<>', concat(chr(123), chr(125))) AS x "
    "FROM (SELECT o_orderkey AS wp_id, CAST(o_custkey % 3 AS INT) AS pi, o_custkey AS k, c_name AS a, n_name AS b, concat(c_name, ' dirige ', n_name, ' por 300 pesos, una suma. Ella vio a ', CASE WHEN o_custkey % 9 = 0 THEN 'nadie' ELSE c_name END) AS parrafo FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) AS y) AS z",
    # Decisions on pairs of names in chains of seven, some twice with other sources or the other way round, some across a chain; and lists that join chains.
    "decided": "SELECT concat(CASE WHEN k % 3 = 0 THEN 'CASA NORTE ' ELSE 'Casa Norte ' END, CAST(k AS STRING)) AS a, CASE WHEN k % 11 = 0 THEN 'Norte' ELSE concat(CASE WHEN k % 5 = 0 THEN 'Casa  Nórte, ' ELSE 'casa norte ' END, CAST(k + paso AS STRING)) END AS b, concat('c', CAST(k AS STRING), '-', CAST(vez AS STRING)) AS clave, tipo, decision, fuente, k "
    "FROM (SELECT k, 1 AS paso, 0 AS vez, tipo, CASE WHEN k % 17 = 0 THEN 'posponer' WHEN k % 7 = 6 THEN 'distinta' ELSE 'misma' END AS decision, CASE CAST(k % 4 AS INT) WHEN 0 THEN 'persona' WHEN 1 THEN 'regla' WHEN 2 THEN 'juez' ELSE CASE WHEN k % 5 = 0 THEN 'identidades' ELSE 'quien-ai' END END AS fuente FROM chained "
    "UNION ALL SELECT k, 2, 1, tipo, 'distinta', 'persona' FROM chained WHERE k % 9 = 0 UNION ALL SELECT k + 1, -1, 2, tipo, CASE WHEN k % 16 = 0 THEN 'distinta' ELSE 'misma' END, CASE WHEN k % 3 = 0 THEN 'regla' ELSE 'juez' END FROM chained WHERE k % 8 < 2) AS x",
    "chained": "SELECT c_custkey AS k, CASE CAST(floor(c_custkey / 7) % 4 AS INT) WHEN 0 THEN 'persona' WHEN 1 THEN 'organizacion' WHEN 2 THEN 'persona' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'cargo' ELSE 'lugar' END END AS tipo FROM customer",
    "curated": "SELECT CAST(floor(s_suppkey / 3) AS BIGINT) AS grupo, concat('Casa Norte ', CAST(s_suppkey * 7 AS STRING), CASE WHEN s_suppkey % 4 = 0 THEN '.' ELSE '' END) AS nombre FROM supplier",
    # Articles of two paragraphs, and what two outside runs say to have found in them.
    "spoken": "SELECT c_custkey AS wp_id, z AS pi, CASE WHEN z = 0 THEN concat('Nota de ', c_mktsegment, ', sin más.') ELSE concat(c_name, ' vio que ', replace(n_name, '_', ' '), ' y ', c_name, ' son hermanos desde el año ', CAST(c_custkey % 100 AS STRING), ' en ', replace(n_name, '_', ' '), ' del norte') END AS parrafo "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey CROSS JOIN (SELECT 0 AS z UNION ALL SELECT 1) AS zs",
    "said_in_runs": "SELECT c_custkey * 2 + z AS id, CASE WHEN z = 0 THEN 'deep' ELSE 'gemi' END AS corrida, CASE WHEN c_custkey % 13 = 0 THEN 'http://y.org/' ELSE concat('http://x.org/n/', CAST(c_custkey AS STRING)) END AS url, CASE WHEN c_custkey % 5 = 0 THEN 'esto no se dijo en ninguna parte' WHEN c_custkey % 17 <> 0 THEN concat('y ', c_name, ' son hermanos  desde el AÑO ') END AS cita1, "
    "CASE WHEN c_custkey % 10 = 0 THEN concat(replace(n_name, '_', ' '), ' y ', c_name, ' son') ELSE '' END AS cita2, c_name AS a, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 9 = 0 THEN lower(c_name) WHEN c_custkey % 8 = 0 THEN 'Nadie Nunca' WHEN c_custkey % 3 = 0 THEN concat('Juan ', substr(n_name, 1, 6)) ELSE replace(n_name, '_', '-') END AS b, 'Persona' AS clase_a, CASE WHEN c_custkey % 2 = 0 THEN 'ENTIDAD PRIVADA' ELSE 'raro' END AS clase_b, "
    "CASE WHEN z = 0 AND c_custkey % 4 = 0 THEN 'PRIMA' ELSE CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN 'HERMANO' WHEN 1 THEN 'padre ' WHEN 2 THEN 'PRIMO' WHEN 3 THEN 'AMIGO' WHEN 4 THEN 'RARO' ELSE 'hermana' END END AS relacion, CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN 'abogado' WHEN 1 THEN 'Abogado' WHEN 2 THEN 'rey' WHEN 3 THEN 'alcalde' ELSE concat('del ', CASE WHEN c_custkey % 3 = 0 THEN 'sur' ELSE 'norte' END) END AS cargo "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey CROSS JOIN (SELECT 0 AS z UNION ALL SELECT 1) AS zs WHERE z = 1 OR c_custkey % 7 <> 3",
    "alias_cases": "SELECT c_custkey AS clave, 'persona' AS tipo, concat('ana ruiz ', CAST(c_custkey % 40 AS STRING)) AS a, CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN concat('ruiz ', CAST(c_custkey % 40 AS STRING)) "
    "WHEN 1 THEN concat('eva mora ', CAST(c_custkey % 30 AS STRING)) ELSE concat('luz ', CAST(c_custkey % 20 AS STRING)) END AS b FROM customer",
}


def _needs(sql: str) -> list[str]:
    found: list[str] = []
    for name in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql)):
        if name in VIEWS and name not in found:
            found += [x for x in _needs(VIEWS[name]) if x not in found] + [name]
    return found


def with_views(sql: str) -> str:
    """The query with the stand-ins that it reads as common table expressions."""
    used = _needs(sql)
    if not used:
        return sql
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    rest = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql)
    kind = "WITH RECURSIVE " if re.match(r"\s*WITH\s+RECURSIVE", sql) else "WITH "
    return f"{kind}{head}, {rest}" if re.match(r"\s*WITH\b", sql) else f"{kind}{head} {sql}"


#: Stand-ins of numbered marks and proposals: the lines of an article are dealt to one task, so that neither DISTINCT nor windows deal them again.
TOGETHER = ("gold_ents", "model_ents", "written")
#: Relations between neighbours, as SQL for Spark: the next number of a paragraph in place of a join with itself.
_NEXT = "SELECT wp_id, pi, {0} FROM (SELECT *, lead(i) OVER (PARTITION BY wp_id, pi ORDER BY i) AS j FROM {1}) AS x WHERE j = i + 1 AND wp_id IS NOT NULL AND pi IS NOT NULL"
NEIGHBOURS = {
    "gold_ties": _NEXT.format("i AS a, j AS b, CASE CAST(mid % 3 AS INT) WHEN 0 THEN 'apoya a' WHEN 1 THEN 'socio de' ELSE 'dirige' END AS predicado", "gold_ents"),
    "model_ties": _NEXT.format("CASE WHEN fin % 4 = 0 THEN j ELSE i END AS a, CASE WHEN fin % 4 = 0 THEN i ELSE j END AS b, CASE CAST(ini % 3 AS INT) WHEN 0 THEN 'apoya a' WHEN 1 THEN 'socio de' ELSE 'dirige' END AS predicado, score, i AS orden", "model_ents"),
}


def load(spark: SparkSession, sf_dir: str, name: str, together: bool = False) -> DataFrame:
    """A driver table or a stand-in; with `together` the lines of an article are in one partition."""
    if name in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return df.repartition("l_orderkey") if together and name == "lineitem" else df
    sql = NEIGHBOURS.get(name, VIEWS[name])
    used = [t for t in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql)) if t in TABLES or t in VIEWS]
    text = re.sub(r"\b(FROM|JOIN)\s+(\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], sql)
    return spark.sql(text, **{t: load(spark, sf_dir, t, together or name in TOGETHER) for t in used})
