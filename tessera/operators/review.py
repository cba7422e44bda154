"""Batches under review: lists, progress, timings, latest reviews, bench and export reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.profile import rank_percentiles


def batch_list(batches: DataFrame, articles: DataFrame, extracted: DataFrame) -> DataFrame:
    """Batches with how many articles they have, how many calibrate, and how many have been extracted."""
    n = articles.groupBy("lote_id").agg(F.count("*").alias("articulos"), F.count_if("calibra").alias("calibracion"))
    e = extracted.groupBy("lote_id").agg(F.count_distinct("wp_id").alias("extraidos"))
    j = batches.join(n, "lote_id", "left").join(e, "lote_id", "left")
    return j.select("lote_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("articulos", "calibracion", "extraidos")))


def progress(articles: DataFrame, done: DataFrame) -> DataFrame:
    """Done and total over a scope of articles."""
    d = done.select("wp_id").distinct().withColumn("_d", F.lit(1))
    return articles.join(d, "wp_id", "left").agg(F.count("_d").alias("hechos"), F.count("*").alias("total"))


def eta(progress_rows: DataFrame, milliseconds: DataFrame) -> DataFrame:
    """Seconds left: what is to do times the mean time."""
    return progress_rows.crossJoin(milliseconds.agg(F.avg("ms").alias("ms"))).select("hechos", "total", F.round((F.col("total") - F.col("hechos")) * F.col("ms") / 1000, 3).alias("segundos"))


def with_body_unextracted(batch: DataFrame, bodies: DataFrame, proposals: DataFrame) -> DataFrame:
    """Articles whose body is there and that have no proposals."""
    body = bodies.where("texto is not null and trim(texto) <> ''").select("wp_id")
    return batch.join(body, "wp_id", "left_semi").join(proposals.select("wp_id"), "wp_id", "left_anti")


def without_body(wanted: DataFrame, bodies: DataFrame, blank: bool = True) -> DataFrame:
    """Requested ids without a body, in the order asked for (ties by id).

    With `blank` a null or blank text is no body; else an article that has a row at all is taken for downloaded.
    """
    there = bodies.where("texto is not null and trim(texto) <> ''") if blank else bodies
    return wanted.join(there.select("wp_id"), "wp_id", "left_anti").orderBy("orden", "wp_id")


def doubtful_times(times: DataFrame, census: DataFrame, least: float = 20, most: float = 1800) -> DataFrame:
    """Closed and valid measurements that are too short or too long to be true."""
    odd = times.where(F.col("cerrado") & F.col("valido") & ((F.col("segundos") < least) | (F.col("segundos") > most)))
    return odd.join(census.select("wp_id", "title"), "wp_id", "left").select("wp_id", "segundos", "title")


def gate_open(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """True if every blocking finding with cases has a decision."""
    j = findings.where("bloquea and n > 0").join(decisions.select("hallazgo").distinct().withColumn("_d", F.lit(True)), "hallazgo", "left")
    return j.agg(F.coalesce(F.every(F.coalesce("_d", F.lit(False))), F.lit(True)).alias("abierta"))


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """Per article the valid review of the newest batch."""
    v = reviews.where("valido")
    newest = v.groupBy("wp_id").agg(F.max("lote_id").alias("lote_id"))
    return v.join(newest, ["wp_id", "lote_id"], "left_semi")


def next_open(batch: DataFrame, census: DataFrame, closed: DataFrame) -> DataFrame:
    """The first article not closed, by date and id."""
    left = batch.join(closed.select("wp_id"), "wp_id", "left_anti")
    return left.join(census.select("wp_id", "date"), "wp_id").orderBy("date", "wp_id").limit(1).select("wp_id", "date")


def decisions_newest_first(decisions: DataFrame, k: int) -> DataFrame:
    return decisions.orderBy(F.desc("decidido_at"), "clave").limit(k)


def decided_keys(decisions: DataFrame) -> DataFrame:
    return decisions.where("decision <> 'posponer'").select("clave").distinct()


def article_status(batch: DataFrame, marks: DataFrame, closed: DataFrame) -> DataFrame:
    """Per article of a batch: marks, paragraphs with marks, open or closed."""
    n = marks.groupBy("wp_id").agg(F.count("*").alias("menciones"), F.count_distinct("pi").alias("parrafos"))
    j = batch.select("wp_id").join(n, "wp_id", "left").join(closed.select("wp_id").distinct().withColumn("_c", F.lit(True)), "wp_id", "left")
    return j.select("wp_id", F.coalesce("menciones", F.lit(0)).alias("menciones"), F.coalesce("parrafos", F.lit(0)).alias("parrafos"), F.coalesce("_c", F.lit(False)).alias("cerrado"))


def annotation(marks: DataFrame, relations: DataFrame) -> DataFrame:
    """Per article its mentions in reading order and its relations by key: wp_id, menciones, relaciones. An article bounds its lists."""
    m = marks.groupBy("wp_id").agg(F.array_sort(F.collect_list(F.struct("pi", "ini", "fin", "mid", "texto", "tipo", "grupo"))).alias("menciones"))
    r = relations.groupBy("wp_id").agg(F.array_sort(F.collect_list(F.struct("a", "b", "predicado", "cuando"))).alias("relaciones"))
    return m.join(r, "wp_id", "full")


def paragraph_counts(marks: DataFrame, proposals: DataFrame) -> DataFrame:
    """Per paragraph its gold marks and its proposals: wp_id, pi, oro, propuestas."""
    n = lambda df, name: df.groupBy("wp_id", "pi").agg(F.count("*").alias(name))
    return n(marks, "oro").join(n(proposals, "propuestas"), ["wp_id", "pi"], "full").fillna(0, ["oro", "propuestas"])


def bench_summary(runs: DataFrame) -> DataFrame:
    """Total seconds, and the middle element (rank round((n - 1) / 2)) of seconds per thousand words, of (segundos, palabras)."""
    r = runs.withColumn("por_mil", F.round(F.col("segundos") * 1000 / F.nullif(F.col("palabras"), F.lit(0)), 4))
    return r.agg(F.round(F.sum("segundos"), 4).alias("total"), F.count("*").alias("articulos")).crossJoin(rank_percentiles(r, "por_mil", {"mediana": 0.5}))


def export_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and an order-free digest of an export: the sum of 60 bits of each row's MD5, so that no sort of all rows is needed."""
    row = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in columns))
    h = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("filas"), F.sum(h).cast("string").alias("huella"))


def most_recent(used: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Most recently used entries, one per key, newest first."""
    return used.groupBy(*keys).agg(F.max("usado").alias("usado")).orderBy(F.desc("usado"), *keys).limit(k)


def names_with_types(marks: DataFrame, proposals: DataFrame) -> DataFrame:
    """Names with the types they appear with."""
    both = marks.select("texto", "tipo").union(proposals.select("texto", "tipo")).distinct()
    return both.groupBy("texto").agg(F.array_join(F.array_sort(F.collect_set("tipo")), ",").alias("tipos"))


def model_catalogue(catalogue: DataFrame, installed: DataFrame) -> DataFrame:
    """All known models and whether they are installed."""
    return catalogue.join(installed.select("modelo").distinct().withColumn("_i", F.lit(True)), "modelo", "left").select("modelo", F.coalesce("_i", F.lit(False)).alias("instalado"))


def relative_age(seconds: Column) -> Column:
    """Age in words by buckets of minutes, hours and days."""
    return (
        F.when(seconds < 60, "ahora")
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" min")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" h")))
        .otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit(" d")))
    )


def reconnect_delay(attempt: Column) -> Column:
    return F.least(F.lit(30.0), F.pow(F.lit(2.0), attempt))


def best_batch(progress_rows: DataFrame) -> DataFrame:
    """The batch that has got furthest; ties go to the session's."""
    return progress_rows.agg(F.max_by(F.struct("lote_id", "avance"), F.struct("avance", F.col("de_sesion").cast("int"), -F.col("lote_id"))).alias("x")).select("x.*")


def rank_within(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    return df.withColumn("puesto", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def decide(decisions: DataFrame, new: DataFrame) -> DataFrame:
    """Decisions (clave, decision, confianza, texto) after new ones of the same columns: the new one of a key stands."""
    return new.unionByName(decisions.join(new.select("clave"), "clave", "left_anti"))


def undo(decisions: DataFrame, keys: DataFrame) -> DataFrame:
    """Decisions with those of the keys put off, at confidence 0; the text says what stood there."""
    hit = F.col("_h").isNotNull()
    j = decisions.join(keys.select("clave").distinct().withColumn("_h", F.lit(1)), "clave", "left")
    said = F.concat(F.lit("deshecha: "), "decision")
    return j.select("clave", F.when(hit, "posponer").otherwise(F.col("decision")).alias("decision"), F.when(hit, 0.0).otherwise(F.col("confianza")).alias("confianza"), F.when(hit, said).otherwise(F.col("texto")).alias("texto"))


def merged_config(defaults: DataFrame, file: DataFrame, pruned: DataFrame, never: float = 1.01) -> DataFrame:
    """Cut-offs (clave, corte): a file's values over the defaults, and a cut that nothing reaches for pruned keys."""
    layers = defaults.select("clave", "corte", F.lit(0).alias("_o")).union(file.select("clave", "corte", F.lit(1))).union(pruned.select("clave", F.lit(never), F.lit(2)))
    return layers.groupBy("clave").agg(F.max_by("corte", "_o").alias("corte"))


def looked_up(keys: DataFrame, values: DataFrame, key: str, value: str, default) -> DataFrame:
    """Each key with its value, or the default where it has none."""
    return keys.select(key).join(values.select(key, value), key, "left").select(key, F.coalesce(value, F.lit(default)).alias(value))



def batch_taxonomy(batches: DataFrame, default: str = "categories") -> DataFrame:
    """Batches with their taxonomy, which older ones do not say."""
    return batches.withColumn("taxonomia", F.coalesce(F.nullif("taxonomia", F.lit("")), F.lit(default)))


def examples(findings: DataFrame, census: DataFrame, n: int) -> DataFrame:
    """Up to n articles for each finding (hallazgo, wp_id, nota), smallest keys first, with a title to show."""
    w = Window.partitionBy("hallazgo").orderBy("wp_id", "nota")
    best = findings.withColumn("orden", F.row_number().over(w)).where(F.col("orden") <= n)
    titled = best.join(census.select("wp_id", "title"), "wp_id", "left")
    return titled.select("hallazgo", "wp_id", F.coalesce("title", F.lit("(sin título)")).alias("titulo"), F.coalesce("nota", F.lit("")).alias("nota"), "orden")


def predicate_menu(options: DataFrame, most: int = 9) -> DataFrame:
    """Per pair of types whether its predicates fit one menu, else the families to choose from, by the order of their first predicate."""
    fam = options.groupBy("tipo_a", "tipo_b", "familia").agg(F.count("*").alias("n"), F.min("orden").alias("o"))
    g = fam.groupBy("tipo_a", "tipo_b").agg(F.sum("n").alias("opciones"), F.array_sort(F.collect_list(F.struct("o", "familia"))).alias("x"))
    return g.select("tipo_a", "tipo_b", "opciones", (F.col("opciones") <= most).alias("directo"), F.array_join("x.familia", ",").alias("familias"))


def kin_by_paragraph(aligned: DataFrame) -> DataFrame:
    """Aligned relations with a predicate, gathered by paragraph: wp_id, pi, relaciones ("a|predicado|b", sorted)."""
    r = aligned.where(F.col("predicado").isNotNull() & F.col("wp_id").isNotNull())
    return r.groupBy("wp_id", "pi").agg(F.array_sort(F.collect_list(F.concat_ws("|", "a", "predicado", "b"))).alias("relaciones"))
