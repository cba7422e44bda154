"""Span algebra: overlaps, greedy selection, alias groups and panel rows. Spans are half-open, in characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import ui_fold
from tessera.operators.components import connected_components
from tessera.operators.sinks import _newest

#: Types whose marks are not carried to other occurrences of the same text.
ALONE = ("monto",)


def overlap(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    return (a_from < b_to) & (b_from < a_to)


def overlap_join(left: DataFrame, right: DataFrame, how: str = "inner", on: tuple[str, ...] = ("wp_id", "pi", "tipo"), prefix: str = "h_") -> DataFrame:
    """Pairs of spans of the same place and type that overlap; right columns get a prefix.

    An equi-join with a range condition, so a hash or merge join does it, not a nested loop.
    """
    r = right.select(*(F.col(c).alias(f"{prefix}{c}") for c in right.columns))
    cond = overlap(F.col("ini"), F.col("fin"), F.col(f"{prefix}ini"), F.col(f"{prefix}fin"))
    for c in on:
        cond = cond & (F.col(c) == F.col(f"{prefix}{c}"))
    return left.join(r, cond, how)


def greedy(df: DataFrame, by: list[str]) -> DataFrame:
    """Per place the spans kept when they are taken by score, then length, then start, and none may overlap a kept one.

    A paragraph bounds its group. Returned one row per kept span.
    """
    best = F.struct((-F.col("score")).alias("s"), (F.col("ini") - F.col("fin")).alias("l"), "ini", "fin", "tipo", "texto")
    grouped = df.groupBy(*by).agg(F.array_sort(F.collect_list(best)).alias("x"))
    kept = F.aggregate(
        "x",
        F.slice("x", 1, 0),
        lambda acc, e: F.when(F.exists(acc, lambda a: (e["ini"] < a["fin"]) & (e["fin"] > a["ini"])), acc).otherwise(F.concat(acc, F.array(e))),
    )
    rows = grouped.select(*by, F.explode(kept).alias("e"))
    return rows.select(*by, "e.ini", "e.fin", "e.tipo", "e.texto", (-F.col("e.s")).alias("score"))


def crossing(df: DataFrame, on: tuple[str, ...] = ("wp_id", "pi")) -> DataFrame:
    """Pairs of marks (a.mid < b.mid) that neither are apart nor nest strictly."""
    a, b = df.alias("a"), df.alias("b")
    cond = F.col("a.mid") < F.col("b.mid")
    for c in on:
        cond = cond & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    ai, af, bi, bf = (F.col(x) for x in ("a.ini", "a.fin", "b.ini", "b.fin"))
    inside = ((ai <= bi) & (bf <= af)) | ((bi <= ai) & (af <= bf))
    same = (ai == bi) & (af == bf)
    return a.join(b, cond & overlap(ai, af, bi, bf) & (~inside | same)).select(*(F.col(f"a.{c}") for c in on), F.col("a.mid").alias("mid_a"), F.col("b.mid").alias("mid_b"))


def alias_groups(marks: DataFrame) -> DataFrame:
    """Per article and alias group: canonical text (no post before a post, then the longest, then the first), forms, marks."""
    rank = F.struct((F.col("tipo") != "cargo").cast("int"), F.length("texto"))
    n = marks.where(F.col("grupo").isNotNull()).groupBy("wp_id", "grupo")
    return n.agg(F.max_by("texto", F.struct(rank, -F.col("mid"))).alias("canonico"), F.count_distinct("texto").alias("formas"), F.count("*").alias("menciones"))


def leave_group(marks: DataFrame, leaving: DataFrame) -> DataFrame:
    """marks with those of `leaving` (wp_id, mid) out of their group; the others of the group stay together."""
    out = leaving.select("wp_id", "mid").distinct().withColumn("_out", F.lit(True))
    return marks.join(out, ["wp_id", "mid"], "left").withColumn("grupo", F.when(F.col("_out").isNull(), F.col("grupo"))).select(marks.columns)


def panel_rows(marks: DataFrame) -> DataFrame:
    """Rows of the panel: a group, else a text, else (types that stand alone) each mark by itself."""
    key = (
        F.when(F.col("grupo").isNotNull(), F.concat(F.lit("g:"), "grupo"))
        .when(F.col("tipo").isin(*ALONE), F.concat(F.lit("m:"), F.col("mid").cast("string")))
        .otherwise(F.concat(F.lit("t:"), ui_fold(F.col("texto"))))
    )
    return marks.groupBy("wp_id", "tipo", key.alias("clave")).agg(F.count("*").alias("menciones"), F.count_distinct("texto").alias("formas"))


def absorb_orphans(marks: DataFrame) -> DataFrame:
    """Marks without a group join the (smallest) group of the same folded form and type in their article."""
    m = marks.withColumn("_f", ui_fold(F.col("texto")))
    known = m.where(F.col("grupo").isNotNull()).groupBy("wp_id", "tipo", "_f").agg(F.min("grupo").alias("_g"))
    return m.join(known, ["wp_id", "tipo", "_f"], "left").withColumn("grupo", F.coalesce("grupo", "_g")).select(marks.columns)


def lexicon(marks: DataFrame, least: int = 3) -> DataFrame:
    """Per (text, type): articles that have it, and whether the text has several types; longest first when applied."""
    n = marks.where(F.length("texto") >= least).groupBy("texto", "tipo").agg(F.count_distinct("wp_id").alias("articulos"))
    kinds = n.groupBy("texto").agg((F.count("*") > 1).alias("ambiguo"))
    return n.join(kinds, "texto")


def visible(proposals: DataFrame, cuts: DataFrame, blocked: DataFrame, default: float = 0.5) -> DataFrame:
    """Proposals at or over their type's cut that are not blocked."""
    p = proposals.join(F.broadcast(cuts), "tipo", "left").where(F.col("score") >= F.coalesce("corte", F.lit(default))).drop("corte")
    b = blocked.select(F.col("tipo").alias("_t"), F.lower("texto").alias("_x")).distinct()
    return p.join(b, (F.col("tipo") == F.col("_t")) & (F.lower("texto") == F.col("_x")), "left_anti")


def first_mention(marks: DataFrame) -> DataFrame:
    """The first mark of each text in a paragraph, which a relation by text points at."""
    return _newest(marks, ["wp_id", "pi", "texto"], F.struct("ini", "fin", "mid"), largest=False)


def next_mention(marks: DataFrame) -> DataFrame:
    """The mark that follows in reading order, the first one after the last."""
    w = Window.partitionBy("wp_id").orderBy("pi", "ini", "fin", "mid")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return marks.select("wp_id", "mid", F.coalesce(F.lead("mid").over(w), F.first("mid").over(whole)).alias("siguiente"))


def paragraphs(docs: DataFrame, text: str = "text", key: str = "doc_id", sep: str = "\n\n") -> DataFrame:
    """(key, pi, parrafo): the non-blank paragraphs of a text, numbered from 0."""
    parts = F.filter(F.split(text, sep), lambda p: F.trim(p) != "")
    return docs.select(key, F.posexplode(parts).alias("pi", "parrafo"))


def join_aliases(marks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Marks after pairs (wp_id, a, b) of them were declared one: old groups and marks of the same form go along.

    Marks, their groups and their folded forms are nodes of one graph; a component that a declared pair touches is a group,
    named by its smallest node.
    """
    m = marks.withColumn("_m", F.concat_ws("\u0001", "wp_id", F.lit("m"), F.format_string("%020d", "mid")))
    form = F.concat_ws("\u0001", "wp_id", F.lit("f"), "tipo", ui_fold(F.col("texto")))
    group = F.concat_ws("\u0001", "wp_id", F.lit("g"), "grupo")
    node = lambda c: F.concat_ws("\u0001", "wp_id", F.lit("m"), F.format_string("%020d", c))
    declared = pairs.select(node("a").alias("u"), node("b").alias("v"))
    edges = declared.union(m.where(F.col("grupo").isNotNull()).select("_m", group)).union(m.select("_m", form))
    labels = connected_components(edges)
    touched = labels.join(declared.select(F.col("u").alias("node")), "node", "left_semi").select("root").distinct()
    names = labels.join(touched, "root", "left_semi").select(F.col("node").alias("_m"), F.col("root").alias("_g"))
    return m.join(names, "_m", "left").withColumn("grupo", F.coalesce(F.regexp_replace("_g", "\u0001", ":"), "grupo")).select(marks.columns)


def segments(paragraphs: DataFrame, marks: DataFrame, key: str = "wp_id") -> DataFrame:
    """Each paragraph cut at its marks' ends, in order: (key, pi, n, texto, marcas), texts together being the paragraph.

    marcas lists the marks around a piece from the outermost in, which is the nesting of a paragraph's tree.
    """
    m = marks.groupBy(key, "pi").agg(F.array_sort(F.collect_list(F.struct("ini", (-F.col("fin")).alias("f"), "mid"))).alias("ms"))
    j = paragraphs.join(m, [key, "pi"], "left")
    size = F.length("parrafo")
    ends = F.concat(F.array(F.lit(0), size), F.coalesce(F.transform("ms", lambda x: x["ini"]), F.array().cast("array<int>")), F.coalesce(F.transform("ms", lambda x: -x["f"]), F.array().cast("array<int>")))
    cuts = F.filter(F.array_sort(F.array_distinct(ends)), lambda c: (c >= 0) & (c <= size))
    rows = j.withColumn("_c", cuts).select(key, "pi", "parrafo", "ms", "_c", F.posexplode(F.slice("_c", 1, F.greatest(F.size("_c") - 1, F.lit(0)))).alias("n", "_a"))
    rows = rows.withColumn("_b", F.element_at("_c", F.col("n") + 2))
    around = F.array_join(F.transform(F.filter(F.coalesce("ms", F.array().cast("array<struct<ini:int,f:int,mid:bigint>>")), lambda x: (x["ini"] <= F.col("_a")) & (-x["f"] >= F.col("_b"))), lambda x: x["mid"].cast("string")), ",")
    return rows.select(key, "pi", "n", F.expr("substring(parrafo, _a + 1, _b - _a)").alias("texto"), around.alias("marcas"))
