"""Knowledge graph: nodes, edges, evidence and summary over human marks and model proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.spans import visible


def nodes(marks: DataFrame, proposals: DataFrame, cuts: DataFrame, blocked: DataFrame, canonical: DataFrame) -> DataFrame:
    """(tipo, nombre): mentions, distinct articles, whether any is reviewed.

    An article with any human mark shows only those; proposals must be visible (see spans.visible). Names are canonical:
    the alias group's text where a group names one, then the decided canonical name.
    """
    human = marks.select("wp_id", "tipo", "texto", F.lit(True).alias("revisado"))
    model = visible(proposals, cuts, blocked).join(marks.select("wp_id"), "wp_id", "left_anti").select("wp_id", "tipo", "texto", F.lit(False).alias("revisado"))
    n = human.union(model).groupBy("tipo", "texto", "wp_id").agg(F.count("*").alias("m"), F.max("revisado").alias("revisado"))
    named = n.join(canonical.withColumnRenamed("nombre", "texto"), "texto", "left").withColumn("nombre", F.coalesce("canonico", "texto"))
    per = named.groupBy("tipo", "nombre", "wp_id").agg(F.sum("m").alias("m"), F.max("revisado").alias("revisado"))
    return per.groupBy("tipo", "nombre").agg(F.sum("m").alias("menciones"), F.count("*").alias("articulos"), F.max("revisado").alias("revisado"))


def edges(human: DataFrame, model: DataFrame, dates: DataFrame, canonical: DataFrame) -> DataFrame:
    """(a, b, predicado, cuando): distinct articles, whether reviewed, first and last year, and articles by year as text.

    An article with human relations shows only those; model relations hold now; ends are canonical and self-edges go.
    """
    h = human.select("wp_id", "a", "b", "predicado", "cuando", F.lit(True).alias("revisado"))
    m = model.join(human.select("wp_id"), "wp_id", "left_anti").select("wp_id", "a", "b", "predicado", F.lit("vigente").alias("cuando"), F.lit(False).alias("revisado"))
    e = h.union(m)
    for end in ("a", "b"):
        names = canonical.select(F.col("nombre").alias(end), F.col("canonico").alias("_c"))
        e = e.join(names, end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
    key = ["a", "b", "predicado", "cuando"]
    one = e.where("a <> b").groupBy(*key, "wp_id").agg(F.max("revisado").alias("revisado"))
    dated = one.join(dates.where("date_valid").select("wp_id", F.substring("date", 1, 4).try_cast("int").alias("anio")), "wp_id", "left")
    years = dated.groupBy(*key, "anio").agg(F.count("*").alias("n"), F.max("revisado").alias("revisado"))
    hist = F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.when(F.col("anio").isNotNull(), F.struct("anio", "n"))), lambda x: x.isNotNull())), lambda x: F.concat(x["anio"], F.lit(":"), x["n"])), " ")
    return years.groupBy(*key).agg(F.sum("n").alias("articulos"), F.max("revisado").alias("revisado"), F.min("anio").alias("desde"), F.max("anio").alias("hasta"), hist.alias("por_anio"))


def top_nodes(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.desc("articulos"), F.desc("menciones"), "nombre", "tipo").limit(k)


def top_edges(df: DataFrame, k: int) -> DataFrame:
    """Ties are broken by all of the key, so the result is the same every time."""
    return df.orderBy(F.desc("articulos"), "a", "b", "predicado", "cuando").limit(k)


def evidence(relations: DataFrame, census: DataFrame, paragraphs: DataFrame, a: str, b: str, predicate: str, k: int = 20) -> DataFrame:
    """Paragraphs behind an edge, newest first; paragraph -1 is the title."""
    hit = relations.where((F.col("a") == a) & (F.col("b") == b) & (F.col("predicado") == predicate)).select("wp_id", "pi").distinct()
    j = hit.join(census.select("wp_id", "date", "title"), "wp_id").join(paragraphs, ["wp_id", "pi"], "left")
    rows = j.select("wp_id", "pi", "date", F.when(F.col("pi") == -1, F.col("title")).otherwise(F.col("parrafo")).alias("texto"))
    return rows.where(F.col("texto").isNotNull()).orderBy(F.desc("date"), "wp_id", "pi").limit(k)


def occupants(descriptions: DataFrame, holders: DataFrame, k: int | None = None) -> DataFrame:
    """For each unnamed post all holders, or the first k, nearest in time first: known years first, then by distance, then by name.

    One entry per holder and year. Posts are compared in lower case. Holders are ranked once for each post and year asked for;
    descriptions, however many, take that ranking.
    """
    d = descriptions.select("wp_id", F.lower("cargo").alias("post"), "anio")
    h = holders.select(F.lower("cargo").alias("post"), "nombre", F.col("anio").alias("h_anio")).distinct()
    gap = F.abs(F.col("anio") - F.col("h_anio"))
    asked = d.select("post", "anio").distinct()
    w = Window.partitionBy("post", "anio").orderBy(gap.isNull(), gap, "nombre", "h_anio")
    ranked = asked.join(h, "post").withColumn("puesto", F.row_number().over(w))
    ranked = ranked if k is None else ranked.where(F.col("puesto") <= k)
    same = (F.col("d.post") == F.col("r.post")) & F.col("d.anio").eqNullSafe(F.col("r.anio"))
    return d.alias("d").join(ranked.alias("r"), same).select("d.wp_id", "d.post", "r.puesto", "r.nombre", F.col("r.h_anio").alias("anio_titular"))


def summary(marks: DataFrame, proposals: DataFrame, human: DataFrame, model: DataFrame) -> DataFrame:
    """Distinct articles, names and named types over both sources, relations, reviewed articles, and names seen in one article."""
    both = marks.select("wp_id", "tipo", "texto").union(proposals.select("wp_id", "tipo", "texto"))
    once = both.groupBy("texto").agg(F.count_distinct("wp_id").alias("k")).agg(F.count_if(F.col("k") == 1).alias("una_vez"), F.count("*").alias("textos"))
    n = both.select("wp_id").distinct().agg(F.count("*").alias("articulos")).crossJoin(both.select("tipo", "texto").distinct().agg(F.count("*").alias("entidades"))).crossJoin(once)
    rel = human.select("wp_id", "a", "b", "predicado").union(model.select("wp_id", "a", "b", "predicado")).distinct().agg(F.count("*").alias("relaciones"))
    return n.crossJoin(rel).crossJoin(marks.agg(F.count_distinct("wp_id").alias("revisados")))


def type_counts(df: DataFrame) -> DataFrame:
    """Nodes per type and the largest number of articles, which scales the bars."""
    return df.groupBy("tipo").agg(F.count("*").alias("nodos"), F.max("articulos").alias("maximo"))
