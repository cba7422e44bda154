"""Hierarchical scope: term closure, scope predicate, primary section, tree counts, samples and work queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.profile import year
from tessera.scratch import materialize

NO_SECTION = "sin sección"


def closure(terms: DataFrame, most_depth: int = 64) -> DataFrame:
    """(ancestor, term_id) for every term and each of its ancestors, itself included; cycles end where they close.

    Each round joins one level and is written to a scratch table, until none is new. Deeper taxonomies than `most_depth` are an error.
    """
    edges = materialize(terms.select("term_id", "parent").distinct())
    found = materialize(edges.select(F.col("term_id").alias("ancestor"), "term_id").distinct())
    front = found
    down = edges.select(F.col("parent").alias("term_id"), F.col("term_id").alias("child"))
    for _ in range(most_depth):
        below = front.join(down, "term_id").select("ancestor", F.col("child").alias("term_id")).distinct()
        front = materialize(below.join(found, ["ancestor", "term_id"], "left_anti"))
        if front.isEmpty():
            return found
        found = found.union(front)
    raise ValueError(f"the taxonomy is deeper than {most_depth} levels")


def levels(terms: DataFrame) -> DataFrame:
    """The tree of terms: (term_id, parent, nivel, hijos) from the roots (parent 0) down; orphans and cycles are not in it."""
    up = closure(terms)
    known = terms.select("term_id", "parent").distinct()
    roots = known.where("parent = 0").select(F.col("term_id").alias("ancestor"))
    inside = up.join(roots, "ancestor", "left_semi").select("term_id").distinct()
    depth = up.join(inside, "term_id", "left_semi").groupBy("term_id").agg((F.count("*") - 1).alias("nivel"))
    children = known.groupBy(F.col("parent").alias("term_id")).agg(F.count("*").alias("hijos"))
    return depth.join(known, "term_id").join(children, "term_id", "left").select("term_id", "parent", "nivel", F.coalesce("hijos", F.lit(0)).alias("hijos"))


def subtree(terms: DataFrame, roots: list[int]) -> DataFrame:
    """Ids of the given terms and all their descendants."""
    return closure(terms).where(F.col("ancestor").isin(*roots)).select("term_id").distinct()


def in_scope(census: DataFrame, bridge: DataFrame, ids: DataFrame, taxonomy: str, first: int | None = None, last: int | None = None, undated: bool = False) -> DataFrame:
    """Articles with any of the terms, within the years, dated unless `undated`."""
    hit = bridge.where(F.col("taxonomy") == taxonomy).join(ids, "term_id", "left_semi").select("wp_id")
    rows = census.join(hit, "wp_id", "left_semi")
    inside = F.lit(True)
    if first is not None:
        inside = inside & (year(F.col("date")) >= first)
    if last is not None:
        inside = inside & (year(F.col("date")) <= last)
    dated = F.col("date_valid") & inside
    return rows.where(dated | ~F.col("date_valid") if undated else dated)


def primary_section(articles: DataFrame, bridge: DataFrame, terms: DataFrame, taxonomy: str) -> DataFrame:
    """Adds `seccion`: the name of the article's smallest term of the taxonomy, chosen terms or not."""
    least = bridge.where(F.col("taxonomy") == taxonomy).groupBy("wp_id").agg(F.min("term_id").alias("term_id"))
    named = least.join(terms.where(F.col("taxonomy") == taxonomy).select("term_id", "name"), "term_id").select("wp_id", F.col("name").alias("seccion"))
    return articles.join(named, "wp_id", "left").withColumn("seccion", F.coalesce("seccion", F.lit(NO_SECTION)))


def tree_counts(terms: DataFrame, bridge: DataFrame, taxonomy: str) -> DataFrame:
    """Per term: articles with that very term, and distinct articles in its subtree (not the sum of its children)."""
    one = bridge.where(F.col("taxonomy") == taxonomy).select("wp_id", "term_id").distinct()
    own = one.groupBy("term_id").agg(F.count("*").alias("propios"))
    up = closure(terms.where(F.col("taxonomy") == taxonomy))
    total = one.join(up, "term_id").select("ancestor", "wp_id").distinct().groupBy(F.col("ancestor").alias("term_id")).agg(F.count("*").alias("total"))
    rows = terms.where(F.col("taxonomy") == taxonomy).select("term_id", "name", "parent").join(total, "term_id").join(own, "term_id", "left")
    return rows.select("term_id", "name", "parent", F.coalesce("propios", F.lit(0)).alias("propios"), "total")


def round_robin(articles: DataFrame, n: int, stratum: str = "seccion", key: str = "wp_id") -> DataFrame:
    """n articles, taking one of each stratum in turn, smallest ids first.

    No stratum can give more than n, so each is cut to n before ranks are given.
    """
    w = Window.partitionBy(stratum).orderBy(key)
    ranked = articles.withColumn("puesto", F.row_number().over(w)).where(F.col("puesto") <= n)
    return ranked.orderBy("puesto", key).limit(n)


def queue_by_category(batch: DataFrame, bridge: DataFrame, terms: DataFrame, taxonomy: str) -> DataFrame:
    """Articles of a batch per term: total, done (extracted) and pending."""
    rows = bridge.where(F.col("taxonomy") == taxonomy).join(batch.select("wp_id", "extraido"), "wp_id")
    n = rows.groupBy("term_id").agg(F.count("*").alias("total"), F.count_if("extraido").alias("hechos"))
    return n.join(terms.where(F.col("taxonomy") == taxonomy).select("term_id", "name", "parent"), "term_id").withColumn("pendientes", F.col("total") - F.col("hechos"))


def without_category(batch: DataFrame, bridge: DataFrame, taxonomy: str) -> DataFrame:
    loose = batch.join(bridge.where(F.col("taxonomy") == taxonomy).select("wp_id"), "wp_id", "left_anti")
    return loose.agg(F.count("*").alias("total"), F.count_if("extraido").alias("hechos"))


def queue_tree(queue: DataFrame) -> DataFrame:
    """Two-level queue: rows whose parent is not in it become roots; roots count the pending of their children."""
    ids = queue.select(F.col("term_id").alias("parent"))
    child = queue.join(ids, "parent", "left_semi")
    below = child.groupBy(F.col("parent").alias("term_id")).agg(F.sum("pendientes").alias("abajo"), F.count("*").alias("hijos"))
    rows = queue.join(child.select("term_id").withColumn("es_hijo", F.lit(True)), "term_id", "left").join(below, "term_id", "left")
    return rows.select("term_id", "name", F.coalesce("es_hijo", F.lit(False)).alias("es_hijo"), F.coalesce("hijos", F.lit(0)).alias("hijos"), (F.col("pendientes") + F.coalesce("abajo", F.lit(0))).alias("pendientes_total"))


def cost_seconds(n: DataFrame, each: float = 1.9) -> DataFrame:
    return n.select("n", F.round(F.col("n") * each, 4).alias("segundos"))


def pending(batch: DataFrame, done: DataFrame, only_calibration: bool = False) -> DataFrame:
    """Articles of a batch not yet processed."""
    rows = batch.where("calibra") if only_calibration else batch
    return rows.join(done.select("wp_id"), "wp_id", "left_anti")


def selection_label(selected: DataFrame, terms: DataFrame, order: str = "term_id", none: str = "Selección") -> DataFrame:
    """One row: the names of the topmost selected terms, both of two, or the first and how many more (`etiqueta`)."""
    top = top_selected(selected, terms).join(terms.select("term_id", "name", F.col(order).alias("_o")), "term_id")
    first = top.agg(F.count("*").alias("n"), F.min(F.struct("_o", "name")).alias("a"), F.max(F.struct("_o", "name")).alias("b"))
    more = F.concat(F.col("a.name"), F.lit(" y "), F.when(F.col("n") == 2, F.col("b.name")).otherwise(F.concat((F.col("n") - 1).cast("string"), F.lit(" más"))))
    return first.select(F.when(F.col("n") == 0, none).when(F.col("n") == 1, F.col("a.name")).otherwise(more).alias("etiqueta"))


def annotable(batch: DataFrame, census: DataFrame, articles: DataFrame) -> DataFrame:
    """The calibrating articles of a batch with title, date and section, and text and number of words if their body is there, by date and id."""
    rows = batch.where("calibra").join(census.select("wp_id", "title", "date", F.col("section").alias("seccion")), "wp_id")
    return rows.join(articles.select("wp_id", "texto", "palabras"), "wp_id", "left").orderBy("date", "wp_id").select("wp_id", "seccion", "title", "date", "texto", "palabras")


def top_selected(selected: DataFrame, terms: DataFrame) -> DataFrame:
    """Of the selected terms those without a selected ancestor."""
    up = closure(terms).where("ancestor <> term_id")
    covered = up.join(selected.select(F.col("term_id").alias("ancestor")), "ancestor", "left_semi").select("term_id")
    return selected.join(covered, "term_id", "left_anti")
