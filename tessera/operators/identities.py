"""A base of identities for use beyond one archive: what decisions and curated lists agree on, and a judge's part in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fold
from tessera.operators.components import connected_components

# Weight of a decision's source (any other, as a judge, weighs 1), and types whose names mean the same everywhere.
WEIGHTS = {"persona": 3, "quien-ai": 2, "regla": 2}
ACTORS = ("persona", "organizacion", "lugar", "obra")


def _node(name: Column) -> Column:
    """A name under its type; forms that fold alike are one."""
    return F.concat(F.col("tipo"), F.lit("\u0001"), fold(name))


def base(decisions: DataFrame, curated: DataFrame, from_base: str = "identidades") -> DataFrame:
    """Entries of the base: tipo, clase, canonico, formas, fuentes.

    decisions: (tipo, a, b, decision, fuente); curated: (grupo, nombre) of persons. Of the decisions on a pair, whichever way
    round, the one of heaviest source counts, then distinct before same, then the smallest names; what came from the base itself,
    posts and other types, and names of a single word, which mean one or another by archive, are left out. Clase
    `misma` is a component of names that are the same (two forms at least): the longest form is canonical, ties by
    alphabet, and `fuentes` lists the sources of its links. `distinta` keeps two names apart, both in `formas`; where the links make
    them one all the same it is a `conflicto`, for a person to look at. Null or blank names are left out.
    """
    words = lambda c: F.size(F.filter(F.split(fold(F.col(c)), " "), lambda w: w != ""))
    d = decisions.where(F.col("decision").isin("misma", "distinta") & ~F.coalesce(F.col("fuente") == from_base, F.lit(False)) & F.col("tipo").isin(*ACTORS))
    d = d.where((words("a") >= 2) & (words("b") >= 2)).select("tipo", "decision", "fuente", "a", "b", _node(F.col("a")).alias("na"), _node(F.col("b")).alias("nb"))
    weights = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    rank = F.struct(-F.coalesce(weights[F.col("fuente")], F.lit(1)), "decision", "a", "b", "fuente")
    best = d.groupBy(F.least("na", "nb").alias("u"), F.greatest("na", "nb").alias("v")).agg(F.min_by(F.struct("tipo", "decision", "fuente", "a", "b", "na", "nb"), rank).alias("d")).select("u", "v", "d.*")

    c = curated.where(fold(F.col("nombre")) != "").select("grupo", "nombre", F.lit("persona").alias("tipo"))
    c = c.select("grupo", "tipo", "nombre", _node(F.col("nombre")).alias("n"))
    # A group is a star around its smallest name, not all pairs of it.
    hubs = c.groupBy("grupo").agg(F.min("n").alias("u"))
    spokes = c.join(hubs, "grupo").select("u", F.col("n").alias("v"), F.lit("quien-ai").alias("fuente")).distinct()
    links = best.where("decision = 'misma'").select("u", "v", "fuente").union(spokes).where("u <> v")
    roots = connected_components(links.select("u", "v"))

    seen = best.select("tipo", F.col("a").alias("nombre"), F.col("na").alias("n")).union(best.select("tipo", "b", "nb")).union(c.select("tipo", "nombre", "n"))
    forms = seen.groupBy("tipo", "n").agg(F.min_by("nombre", F.struct(-F.length("nombre"), "nombre")).alias("forma"))
    placed = forms.join(roots.select(F.col("node").alias("n"), "root"), "n", "left").withColumn("root", F.coalesce("root", "n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.length("forma")).alias("l"), "forma"))), lambda x: x["forma"])
    groups = placed.groupBy("tipo", "root").agg(listed.alias("formas")).where(F.size("formas") > 1)
    sources = links.join(roots.select(F.col("node").alias("u"), "root"), "u").groupBy("root").agg(F.array_sort(F.collect_set("fuente")).alias("fuentes"))
    same = groups.join(sources, "root").select("tipo", F.lit("misma").alias("clase"), F.element_at("formas", 1).alias("canonico"), F.slice("formas", 2, 1 << 30).alias("formas"), "fuentes")

    at = lambda c, s: placed.select(F.col("n").alias(c), F.col("forma").alias(f"f{s}"), F.col("root").alias(f"r{s}"))
    apart = best.where("decision = 'distinta'").join(at("u", "u"), "u").join(at("v", "v"), "v")
    kind = F.when(F.col("ru") == F.col("rv"), "conflicto").otherwise("distinta")
    return same.union(apart.select("tipo", kind, F.lit(None).cast("string"), F.array("fu", "fv"), F.array("fuente")))


def applied(cases: DataFrame, entries: DataFrame, decided: DataFrame, confidence: float = 0.9) -> DataFrame:
    """Decisions that the base settles on open cases (clave, tipo, a, b): clave, decision, confianza, fuente.

    Two forms of one entry are the same, two that an entry keeps apart are distinct; what is decided (clave) is not
    touched. A case whose names an entry joins and another parts is left open, as are conflicts.
    """
    e = entries.where(F.col("clase").isin("misma", "distinta")).select("tipo", "clase", F.xxhash64("tipo", "clase", "canonico", "formas").alias("id"), F.explode(F.array_compact(F.concat(F.array("canonico"), "formas"))).alias("f"))
    e = e.select("tipo", "clase", "id", fold(F.col("f")).alias("f")).distinct()
    side = lambda s: e.select("tipo", "clase", "id", F.col("f").alias(f"f{s}"))
    c = cases.join(decided.select("clave").distinct(), "clave", "left_anti").withColumns({"fa": fold(F.col("a")), "fb": fold(F.col("b"))})
    met = c.where("fa <> fb").join(side("a"), ["tipo", "fa"]).join(side("b"), ["tipo", "clase", "id", "fb"])
    one = met.groupBy("clave").agg(F.min("clase").alias("decision"), F.count_distinct("clase").alias("k")).where("k = 1")
    return one.select("clave", "decision", F.lit(confidence).alias("confianza"), F.lit("identidades").alias("fuente"))


def settled(cases: DataFrame, verdicts: DataFrame, judge: str = "juez", least: float = 0.75) -> DataFrame:
    """Decisions on cases (clave, tipo, confianza, motivo) by rule, and by a judge's verdicts (clave, veredicto, confianza, razon) for the rest.

    Sure spellings (0.99 or more) and the same post with or without a prefix are decided by rule (confidence 1 and 0.85). A verdict of
    same or distinct counts from `least` on; any other, or a weaker one, postpones the case with the reason why. Cases without a
    verdict stay open. Of several verdicts on a case the surest counts, then the smallest. Reasons end at 300 characters.
    """
    sure = F.col("confianza") >= 0.99
    post = (F.col("tipo") == "cargo") & F.col("motivo").startswith("el mismo cargo")
    c = cases.withColumn("regla", F.when(sure, "el mismo nombre con otra grafía").when(post, "el mismo cargo con o sin «ex»"))
    said = lambda d, k, f, r: F.struct(d.alias("decision"), k.cast("double").alias("confianza"), f.alias("fuente"), F.substring(r, 1, 300).alias("razon"))
    ruled = c.where("regla is not null").select("clave", said(F.lit("misma"), F.when(sure, 1.0).otherwise(0.85), F.lit("regla"), F.col("regla")).alias("d"))
    v = verdicts.select("clave", F.lower(F.coalesce("veredicto", F.lit("duda"))).alias("v"), F.coalesce(F.col("confianza").cast("double"), F.lit(0.0)).alias("k"), F.coalesce("razon", F.lit("")).alias("r"))
    v = v.groupBy("clave").agg(F.min_by(F.struct("v", "k", "r"), F.struct(-F.col("k"), "v", "r")).alias("m")).select("clave", "m.*")
    j = c.where("regla is null").select("clave").join(v, "clave")
    firm = F.col("v").isin("misma", "distinta") & (F.col("k") >= least)
    why = F.concat(F.when(F.col("v") == "ambiguo", "ambiguo: ").otherwise("duda: "), "r")
    judged = j.select("clave", said(F.when(firm, F.col("v")).otherwise("posponer"), F.col("k"), F.lit(judge), F.when(firm, F.col("r")).otherwise(why)).alias("d"))
    return ruled.union(judged).select("clave", "d.*")
