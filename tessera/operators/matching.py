"""Two-level matching of annotations: spans one to one, relations through the spans they join, and curves over score cut-offs.

Entities are (wp_id, pi, i, ini, fin, tipo[, score]) with inclusive token spans and `i` their number in the paragraph; relations
are (wp_id, pi, a, b, predicado[, score, orden]) between such numbers. A paragraph bounds its lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vocabulary import SYMMETRIC
from tessera.operators.calibrate import PREDICATE_CUTS, PRUNED

PARAGRAPH = ["wp_id", "pi"]
#: Entities that teach a model what is none; they count on neither side (fixed value).
DECOY = "senuelo"
#: The lowest scores that are collected: entities, and relations between entities of at least WORKING (fixed values).
ENTITY_FLOOR, RELATION_FLOOR, WORKING = 0.3, 0.2, 0.5


def matched(entities: DataFrame, gold: DataFrame, best_first: bool = False) -> DataFrame:
    """(wp_id, pi, i, g): entities matched one to one with gold ones of their type that they overlap.

    Entities choose in order of their number, or by falling score (`best_first`; ties by number), each the first gold entity
    that is still free. By falling score, what entities over any cut-off get does not depend on those under it.
    """
    order = [(-F.col("score")).alias("o"), "i"] if best_first else ["i"]
    mine = entities.where(F.col("tipo") != DECOY).groupBy(*PARAGRAPH).agg(F.array_sort(F.collect_list(F.struct(*order, "ini", "fin", "tipo"))).alias("p"))
    theirs = gold.where(F.col("tipo") != DECOY).groupBy(*PARAGRAPH).agg(F.array_sort(F.collect_list(F.struct(F.col("i").alias("g"), "ini", "fin", "tipo"))).alias("y"))

    kinds = dict(entities.dtypes)["i"], dict(gold.dtypes)["i"]
    return mine.join(theirs, PARAGRAPH).select(*PARAGRAPH, F.explode(_hits("p", "y", *kinds)).alias("h")).select(*PARAGRAPH, "h.i", "h.g")


def _hits(mine: str, theirs: str, i: str = "bigint", g: str = "bigint") -> Column:
    """Array of (i, g): entities of a list, in its order, with the first free ones of the other list."""

    def choose(state: Column, p: Column) -> Column:
        fits = F.filter(state["free"], lambda y: (y["tipo"] == p["tipo"]) & (y["ini"] <= p["fin"]) & (p["ini"] <= y["fin"]))
        taken = F.get(fits, F.lit(0))["g"]
        hit = F.struct(F.filter(state["free"], lambda y: y["g"] != taken).alias("free"), F.concat(state["hits"], F.array(F.struct(p["i"].alias("i"), taken.alias("g")))).alias("hits"))
        return F.when(F.size(fits) > 0, hit).otherwise(state)

    none = F.array().cast(f"array<struct<i:{i},g:{g}>>")
    return F.aggregate(mine, F.struct(F.col(theirs).alias("free"), none.alias("hits")), choose)["hits"]


def _ratios(n: DataFrame) -> DataFrame:
    """Counts vp, fp, fn with p, r, f1 and the number of gold ones, rounded to six digits."""
    over = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    vp, fp, fn = F.col("vp"), F.col("fp"), F.col("fn")
    return n.withColumns({"p": over(vp, vp + fp), "r": over(vp, vp + fn), "f1": over(2 * vp, 2 * vp + fp + fn), "oro": vp + fn})


def _with_total(n: DataFrame, by: str, counts: list[str]) -> DataFrame:
    every = n.withColumn(by, F.explode(F.array(F.col(by), F.lit("*"))))
    return every.groupBy(by).agg(*(F.sum(c).alias(c) for c in counts))


def entity_report(entities: DataFrame, gold: DataFrame) -> DataFrame:
    """Per type and over all (`*`): vp, fp, fn, p, r, f1, oro of the one-to-one matching."""
    hits = matched(entities, gold)
    one, zero = F.lit(1), F.lit(0)
    proposed = entities.where(F.col("tipo") != DECOY).select(*PARAGRAPH, "i", "tipo").join(hits.select(*PARAGRAPH, "i", one.alias("k")), [*PARAGRAPH, "i"], "left")
    missed = gold.where(F.col("tipo") != DECOY).select(*PARAGRAPH, F.col("i").alias("g"), "tipo").join(hits.select(*PARAGRAPH, "g"), [*PARAGRAPH, "g"], "left_anti")
    k = F.coalesce("k", zero)
    rows = proposed.select("tipo", k.alias("vp"), (1 - k).alias("fp"), zero.alias("fn")).union(missed.select("tipo", zero, zero, one))
    return _ratios(_with_total(rows, "tipo", ["vp", "fp", "fn"]))


def _keys(relations: DataFrame, symmetric: tuple[str, ...]) -> DataFrame:
    """Relations with their ends as a key (x, y): ascending if the predicate holds both ways."""
    turn = F.col("predicado").isin(*symmetric) & (F.col("a") > F.col("b"))
    return relations.withColumns({"x": F.when(turn, F.col("b")).otherwise(F.col("a")), "y": F.when(turn, F.col("a")).otherwise(F.col("b"))})


def _gold_keys(gold: DataFrame, relations: DataFrame, symmetric: tuple[str, ...]) -> DataFrame:
    """Distinct gold relations whose ends are no decoys."""
    real = gold.where(F.col("tipo") != DECOY)
    end = lambda c: real.select(*PARAGRAPH, F.col("i").alias(c))
    return _keys(relations.join(end("a"), [*PARAGRAPH, "a"]).join(end("b"), [*PARAGRAPH, "b"]), symmetric).select(*PARAGRAPH, "x", "y", "predicado").distinct()


def judged_relations(entities: DataFrame, relations: DataFrame, gold: DataFrame, gold_relations: DataFrame, symmetric: tuple[str, ...] = SYMMETRIC, hits: DataFrame | None = None) -> DataFrame:
    """Relations with the gold ends of their ends (x, y; null where an end found none) and `juicio`: acierto, invertida or fallo.

    A relation hits if both its ends are matched and gold has that relation between what they are matched with; of predicates
    that hold both ways either direction does. `invertida` says that gold has it the other way round.
    """
    hits = matched(entities, gold) if hits is None else hits
    end = lambda c, g: hits.select(*PARAGRAPH, F.col("i").alias(c), F.col("g").alias(g))
    r = relations.join(end("a", "ga"), [*PARAGRAPH, "a"], "left").join(end("b", "gb"), [*PARAGRAPH, "b"], "left")
    r = _keys(r.withColumnsRenamed({"a": "_a", "b": "_b", "ga": "a", "gb": "b"}), symmetric).drop("a", "b").withColumnsRenamed({"_a": "a", "_b": "b"})
    keys = _gold_keys(gold, gold_relations, symmetric)
    r = r.join(keys.withColumn("_hit", F.lit(True)), [*PARAGRAPH, "x", "y", "predicado"], "left")
    back = keys.where(~F.col("predicado").isin(*symmetric)).select(*PARAGRAPH, F.col("y").alias("x"), F.col("x").alias("y"), "predicado", F.lit(True).alias("_back"))
    r = r.join(back, [*PARAGRAPH, "x", "y", "predicado"], "left")
    return r.withColumn("juicio", F.when(F.col("_hit"), "acierto").when(F.col("_back"), "invertida").otherwise("fallo")).drop("_hit", "_back")


def relation_report(entities: DataFrame, relations: DataFrame, gold: DataFrame, gold_relations: DataFrame, symmetric: tuple[str, ...] = SYMMETRIC, once: bool = False) -> DataFrame:
    """Per predicate and over all (`*`): vp, fp, fn, directas, invertidas, p, r, f1, oro, direccion.

    `direccion` is the share of relations with the right pair and predicate that also have the right direction, over
    predicates that hold one way (null without any). A reversed relation is a wrong one. With `once` a gold relation is hit
    once, further relations that hit it are wrong; else each counts.
    """
    judged = judged_relations(entities, relations, gold, gold_relations, symmetric)
    right = F.col("juicio") == "acierto"
    place = [*PARAGRAPH, "x", "y", "predicado"]
    n = judged.groupBy(*place, "juicio").agg(F.count("*").alias("n"))
    good = F.when(right, F.lit(1) if once else F.col("n")).otherwise(0)
    one_way = ~F.col("predicado").isin(*symmetric)
    direct = F.when(right & one_way, F.col("n")).otherwise(0)
    turned = F.when(F.col("juicio") == "invertida", F.col("n")).otherwise(0)
    rows = n.select("predicado", good.alias("vp"), (F.col("n") - good).alias("fp"), F.lit(0).alias("fn"), direct.alias("directas"), turned.alias("invertidas"))
    missed = _gold_keys(gold, gold_relations, symmetric).join(n.where(right), place, "left_anti")
    zero = F.lit(0)
    rows = rows.union(missed.select("predicado", zero, zero, F.lit(1), zero, zero))
    out = _ratios(_with_total(rows, "predicado", ["vp", "fp", "fn", "directas", "invertidas"]))
    return out.withColumn("direccion", F.round(F.col("directas") / F.nullif(F.col("directas") + F.col("invertidas"), F.lit(0)), 6))


def ceiling(silver: DataFrame, silver_relations: DataFrame, gold: DataFrame, gold_relations: DataFrame, symmetric: tuple[str, ...] = SYMMETRIC, least: int = 5) -> DataFrame:
    """How well an annotator does on the paragraphs that gold has too: nivel (tipo, predicado), clase, vp, fp, fn, p, r, f1, oro.

    What learns from the annotator will hardly be better. Relations count once on either side; predicates with fewer than
    `least` relations in all are only part of the total (`*`).
    """
    long = lambda c, name: F.col(c).cast("long").alias(name)
    ents = lambda df, k: df.select(*PARAGRAPH, F.lit(k).alias("k"), long("i", "u"), long("ini", "v"), long("fin", "w"), F.col("tipo").alias("c"))
    ties = lambda df, k: df.select(*PARAGRAPH, F.lit(k), long("a", "u"), long("b", "v"), F.lit(None).cast("long"), "predicado")
    rows = ents(silver, 0).union(ties(silver_relations, 1)).union(ents(gold, 2)).union(ties(gold_relations, 3))
    # All that is said of a paragraph meets once, as four lists.
    fields = lambda *names: F.struct(*(F.col(c).alias(n) for c, n in zip("uvwc", names)))
    tie = F.struct(F.col("u").alias("a"), F.col("v").alias("b"), F.col("c").alias("predicado"))
    parts = {"s": fields("i", "ini", "fin", "tipo"), "r": tie, "y": fields("g", "ini", "fin", "tipo"), "q": tie}
    lists = rows.where("wp_id is not null and pi is not null").groupBy(*PARAGRAPH).agg(*(F.collect_list(F.when(F.col("k") == k, x)).alias(n) for k, (n, x) in enumerate(parts.items())))
    real = lambda c: F.array_sort(F.filter(c, lambda e: e["tipo"] != DECOY)).alias(c)
    p = lists.where((F.size("s") > 0) & (F.size("y") > 0)).select(real("s"), "r", real("y"), "q")

    def key(a: Column, b: Column, predicate: Column) -> Column:
        turn = predicate.isin(*symmetric) & (a > b)
        return F.struct(F.when(turn, b).otherwise(a).alias("x"), F.when(turn, a).otherwise(b).alias("y"), predicate.alias("predicado"))

    def keys(said: str, ends: str, i: str) -> Column:
        there = lambda n: F.exists(ends, lambda e: e[i] == n)
        return F.array_distinct(F.transform(F.filter(said, lambda t: there(t["a"]) & there(t["b"])), lambda t: key(t["a"], t["b"], t["predicado"])))

    p = p.select("s", "y", _hits("s", "y").alias("h"), keys("r", "s", "i").alias("ours"), keys("q", "y", "g").alias("gold"))
    at = lambda i: F.get(F.filter("h", lambda h: h["i"] == i), F.lit(0))["g"]
    p = p.select("s", "y", "h", "gold", F.transform("ours", lambda t: key(at(t["x"]), at(t["y"]), t["predicado"])).alias("found"))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    count = lambda level, of, vp, every, fn: F.struct(F.lit(level).alias("nivel"), of.alias("clase"), vp.alias("vp"), every.alias("n"), fn.alias("fn"))
    each = F.concat(
        F.transform("s", lambda e: count("tipo", e["tipo"], F.exists("h", lambda h: h["i"] == e["i"]).cast("long"), one, zero)),
        F.transform(F.filter("y", lambda e: ~F.exists("h", lambda h: h["g"] == e["g"])), lambda e: count("tipo", e["tipo"], zero, zero, one)),
        F.transform("found", lambda t: count("predicado", t["predicado"], zero, one, zero)),
        F.transform(F.array_intersect("gold", "found"), lambda t: count("predicado", t["predicado"], one, zero, zero)),
        F.transform(F.array_except("gold", "found"), lambda t: count("predicado", t["predicado"], zero, zero, one)),
    )
    n = p.select(F.explode(each).alias("e")).groupBy("e.nivel", "e.clase").agg(*(F.sum(f"e.{c}").alias(c) for c in ("vp", "n", "fn")))
    n = n.withColumn("clase", F.explode(F.array("clase", F.lit("*")))).groupBy("nivel", "clase").agg(F.sum("vp").alias("vp"), (F.sum("n") - F.sum("vp")).alias("fp"), F.sum("fn").alias("fn"))
    enough = (F.col("nivel") == "tipo") | (F.col("clase") == "*") | (F.col("vp") + F.col("fp") + F.col("fn") >= least)
    return _ratios(n.where(enough)).select("nivel", "clase", "vp", "fp", "fn", "p", "r", "f1", "oro")


# Scores for the choice of cut-offs --------------------------------------------------------------------------------------


def scored_entities(entities: DataFrame, gold: DataFrame, floor: float = ENTITY_FLOOR, best_first: bool = True) -> DataFrame:
    """(wp_id, pi, i, clase, score, acierto) of the entities at or over the floor, from one matching of all of them.

    By falling score, the same entities hit at every cut-off as in a matching of only those over it, so one pass gives the
    whole curve; in reading order (best_first=False) an entity under a cut-off may have taken another one's gold.
    """
    rows = entities.where((F.col("score") >= floor) & (F.col("tipo") != DECOY))
    hits = matched(rows, gold, best_first).select(*PARAGRAPH, "i", F.lit(True).alias("_hit"))
    return rows.join(hits, [*PARAGRAPH, "i"], "left").select(*PARAGRAPH, "i", F.col("tipo").alias("clase"), "score", F.coalesce("_hit", F.lit(False)).alias("acierto"))


def scored_relations(
    entities: DataFrame, relations: DataFrame, gold: DataFrame, gold_relations: DataFrame, floor: float = RELATION_FLOOR, working: float = WORKING, symmetric: tuple[str, ...] = SYMMETRIC, best_first: bool = True
) -> DataFrame:
    """(wp_id, pi, orden, clase, score, acierto) of the relations at or over the floor, between entities of at least `working`.

    Of relations that hit the same gold one the highest score counts (or the first in order), the others miss.
    """
    sure = entities.where(F.col("score") >= working)
    end = lambda c: sure.select(*PARAGRAPH, F.col("i").alias(c))
    r = relations.where(F.col("score") >= floor).join(end("a"), [*PARAGRAPH, "a"], "left_semi").join(end("b"), [*PARAGRAPH, "b"], "left_semi")
    judged = judged_relations(sure, r, gold, gold_relations, symmetric)
    place = [*PARAGRAPH, "x", "y", "predicado"]
    first = F.struct(-F.col("score"), "orden") if best_first else F.struct("orden")
    won = judged.where("juicio = 'acierto'").groupBy(*place).agg(F.min_by("orden", first).alias("orden")).select(*PARAGRAPH, "orden", F.lit(True).alias("_hit"))
    return judged.join(won, [*PARAGRAPH, "orden"], "left").select(*PARAGRAPH, "orden", F.col("predicado").alias("clase"), "score", F.coalesce("_hit", F.lit(False)).alias("acierto"))


def gold_counts(gold: DataFrame) -> DataFrame:
    """(clase, oro): gold entities of each type."""
    return gold.where(F.col("tipo") != DECOY).groupBy(F.col("tipo").alias("clase")).agg(F.count("*").alias("oro"))


def gold_relation_counts(gold: DataFrame, gold_relations: DataFrame, symmetric: tuple[str, ...] = SYMMETRIC) -> DataFrame:
    """(clase, oro): distinct gold relations of each predicate."""
    return _gold_keys(gold, gold_relations, symmetric).groupBy(F.col("predicado").alias("clase")).agg(F.count("*").alias("oro"))


def curve(scored: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision-recall curve of each class: clase, corte (every score that occurs), vp, fp, fn, p, r, f1.

    Scores are counted first, so the running sums of a class are over its distinct scores, not over its rows.
    """
    n = scored.groupBy("clase", F.col("score").alias("corte")).agg(F.count_if("acierto").alias("si"), F.count_if(~F.col("acierto")).alias("no"))
    w = Window.partitionBy("clase").orderBy(F.desc("corte")).rowsBetween(Window.unboundedPreceding, 0)
    rows = n.select("clase", "corte", F.sum("si").over(w).alias("vp"), F.sum("no").over(w).alias("fp")).join(gold, "clase", "left")
    rows = rows.withColumn("fn", F.coalesce("oro", F.lit(0)) - F.col("vp")).drop("oro")
    return _ratios(rows).drop("oro")


def chosen_cuts(scored: DataFrame, gold: DataFrame, default: float = 0.5, support: int = 3, prune: float = 0.2) -> DataFrame:
    """Per class with `support` gold ones: clase, corte of best F1, f1, podado (cut-off 1.01 if even that F1 is under `prune`).

    The default gives way only to a grid value that is better by over 1e-9; of equally good ones the lowest wins.
    """
    grid = scored.sparkSession.createDataFrame([(default, 0)] + [(c, 1) for c in PREDICATE_CUTS], "corte double, turno int")
    h = scored.groupBy("clase", "score").agg(F.count_if("acierto").alias("si"), F.count_if(~F.col("acierto")).alias("no"))
    known = gold.where(F.col("oro") >= support)
    at = F.coalesce(F.col("score") >= F.col("corte"), F.lit(False))
    side = lambda c: F.sum(F.when(at, F.col(c)).otherwise(0))
    n = known.crossJoin(F.broadcast(grid)).join(h, "clase", "left").groupBy("clase", "oro", "corte", "turno").agg(side("si").alias("vp"), side("no").alias("fp"))
    f = n.withColumn("f", F.coalesce(2 * F.col("vp") / F.nullif(F.col("vp") + F.col("fp") + F.col("oro"), F.lit(0)), F.lit(0.0)))
    base = f.where("turno = 0").select("clase", F.col("f").alias("base"), F.col("corte").alias("vigente"))
    tops = f.where("turno = 1").groupBy("clase").agg(F.max_by(F.struct("corte", "f"), F.struct(F.round("f", 9), -F.col("corte"))).alias("m"))
    better = F.col("m.f") > F.col("base") + 1e-9
    j = base.join(tops, "clase").select("clase", F.when(better, F.col("m.corte")).otherwise(F.col("vigente")).alias("corte"), F.when(better, F.col("m.f")).otherwise(F.col("base")).alias("f1"))
    return j.select("clase", "corte", F.round("f1", 6).alias("f1"), F.when(F.col("f1") < prune, F.lit(PRUNED)).otherwise(F.col("corte")).alias("podado"))


def measured(scored: DataFrame, gold: DataFrame, cuts: DataFrame, policies: dict[str, tuple[str | None, float]]) -> DataFrame:
    """Precision, recall and F1 over all classes of each policy: politica, vp, fp, fn, p, r, f1.

    A policy is the column of `cuts` that it takes cut-offs from (or none) and the cut-off of classes without one.
    """
    c = cuts.select("clase", *dict.fromkeys(k for k, _ in policies.values() if k))
    named = scored.join(F.broadcast(c), "clase", "left")
    cut = lambda k, d: F.coalesce(F.col(k), F.lit(d)) if k else F.lit(d)
    tries = F.explode(F.array(*(F.struct(F.lit(name).alias("politica"), cut(k, d).alias("corte")) for name, (k, d) in policies.items()))).alias("t")
    rows = named.select("score", "acierto", tries).groupBy("t.politica").agg(F.count_if((F.col("score") >= F.col("t.corte")) & F.col("acierto")).alias("vp"), F.count_if((F.col("score") >= F.col("t.corte")) & ~F.col("acierto")).alias("fp"))
    total = gold.agg(F.coalesce(F.sum("oro"), F.lit(0)).alias("n"))
    return _ratios(rows.crossJoin(F.broadcast(total)).withColumn("fn", F.col("n") - F.col("vp")).drop("n")).drop("oro")
