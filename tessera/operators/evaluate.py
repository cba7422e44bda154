"""Evaluation: matching against gold, agreement and consensus of annotators, comparison of runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vocabulary import SYMMETRIC
from tessera.operators.calibrate import f1
from tessera.operators.marking import proper_nouns
from tessera.operators.spans import overlap_join

SPAN = ["wp_id", "pi", "ini", "fin", "tipo"]


def against_gold(props: DataFrame, gold: DataFrame, cuts: list[float]) -> DataFrame:
    """Per cut: proposals, hits (several may share a gold mark), gold marks found, precision, recall and F1."""
    grid = F.broadcast(props.sparkSession.createDataFrame([(c,) for c in cuts], "corte double"))
    g = gold.select(*SPAN).distinct()
    p = props.select(*SPAN, "score").distinct()
    joined = overlap_join(p, g, "left")
    best = joined.groupBy(*SPAN, "score").agg(F.max(F.col("h_ini").isNotNull()).alias("acierto"))
    n = best.crossJoin(grid).where("score >= corte").groupBy("corte").agg(F.count("*").alias("propuestas"), F.count_if("acierto").alias("vp"))
    used = joined.where(F.col("h_ini").isNotNull()).groupBy("h_wp_id", "h_pi", "h_ini", "h_fin", "h_tipo").agg(F.max("score").alias("s"))
    used = used.crossJoin(grid).where("s >= corte").groupBy("corte").agg(F.count("*").alias("usadas"))
    j = grid.join(n, "corte", "left").join(used, "corte", "left").crossJoin(g.agg(F.count("*").alias("oro")))
    j = j.select("corte", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("propuestas", "vp", "usadas")), "oro")
    return j.select("corte", "propuestas", "vp", (F.col("oro") - F.col("usadas")).alias("fn"), F.round(f1(F.col("vp"), F.col("propuestas") - F.col("vp"), F.col("oro") - F.col("usadas")), 6).alias("f1"))


def one_to_one(props: DataFrame, gold: DataFrame) -> DataFrame:
    """Greedy one-to-one matching by overlap of inclusive token spans, in reading order; per type vp, fp, fn.

    The spans of a paragraph are one row on either side, so a batch of rows is matched at a time.
    """

    @F.pandas_udf("tipo array<string>, vp array<long>, fp array<long>, fn array<long>")
    def match(p: pd.Series, g: pd.Series) -> pd.DataFrame:
        rows = []
        for mine, theirs in zip(p, g):
            n: dict[str, list[int]] = {}
            free = [(x["ini"], x["fin"], x["tipo"]) for x in theirs] if theirs is not None else []
            for x in mine if mine is not None else ():
                hit = next((y for y in free if y[2] == x["tipo"] and y[0] <= x["fin"] and x["ini"] <= y[1]), None)
                n.setdefault(x["tipo"], [0, 0, 0])[0 if hit else 1] += 1
                if hit:
                    free.remove(hit)
            for _, _, tipo in free:
                n.setdefault(tipo, [0, 0, 0])[2] += 1
            rows.append((list(n), *([c[k] for c in n.values()] for k in range(3))))
        return pd.DataFrame(rows, columns=["tipo", "vp", "fp", "fn"])

    keys = ["wp_id", "pi"]
    side = lambda df, name: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ini", "fin", "tipo"))).alias(name))
    joined = side(props, "p").join(side(gold, "g"), keys, "full").select(match("p", "g").alias("m"))
    each = joined.select(F.explode(F.arrays_zip("m.tipo", "m.vp", "m.fp", "m.fn")).alias("x")).select("x.*")
    n = each.groupBy("tipo").agg(*(F.sum(c).alias(c) for c in ("vp", "fp", "fn")))
    return n.withColumn("f1", F.round(f1(F.col("vp"), F.col("fp"), F.col("fn")), 6))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Dice agreement of two annotators per type and over all (type `*`), by exact span and type."""
    x = a.select(*SPAN).distinct().withColumn("a", F.lit(1))
    y = b.select(*SPAN).distinct().withColumn("b", F.lit(1))
    j = x.join(y, SPAN, "full")
    n = j.withColumn("tipo", F.explode(F.array("tipo", F.lit("*")))).groupBy("tipo").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count(F.col("a") + F.col("b")).alias("ambas"))
    return n.withColumn("acuerdo", F.round(2 * F.col("ambas") / (F.col("n_a") + F.col("n_b")), 6))


def discrepancies(a: DataFrame, b: DataFrame) -> DataFrame:
    """Spans that only one of two annotators has."""
    x, y = a.select(*SPAN).distinct(), b.select(*SPAN).distinct()
    return x.join(y, SPAN, "left_anti").withColumn("solo", F.lit("a")).union(y.join(x, SPAN, "left_anti").withColumn("solo", F.lit("b")))


def consensus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*SPAN).intersect(b.select(*SPAN))


def consensus_relations(ents_a: DataFrame, rels_a: DataFrame, ents_b: DataFrame, rels_b: DataFrame, symmetric: tuple[str, ...] = SYMMETRIC) -> tuple[DataFrame, DataFrame]:
    """What two annotators agree on in the paragraphs that both have: (entities, relations) of b, renumbered.

    Entities (wp_id, pi, i, ini, fin, tipo) agree by exact span and type; relations (wp_id, pi, a, b, predicado, cuando) if both
    ends agree and a has that predicate between the same spans, either way round where it holds both ways. Of entities of one
    span with several types relations point at the last.
    """
    place = ["wp_id", "pi"]
    agreed = ents_b.join(ents_a.select(*SPAN).distinct(), SPAN, "left_semi")
    ents = agreed.withColumn("n", F.row_number().over(Window.partitionBy(*place).orderBy("i")) - 1)

    def spans_of(rels: DataFrame, ents: DataFrame) -> DataFrame:
        end = lambda c, s: ents.select(*place, F.col("i").alias(c), F.struct("ini", "fin").alias(s))
        r = rels.join(end("a", "x"), [*place, "a"]).join(end("b", "y"), [*place, "b"])
        turn = F.col("predicado").isin(*symmetric) & (F.col("x") > F.col("y"))
        return r.withColumns({"kx": F.when(turn, F.col("y")).otherwise(F.col("x")), "ky": F.when(turn, F.col("x")).otherwise(F.col("y"))})

    said = spans_of(rels_a, ents_a).select(*place, "kx", "ky", "predicado").distinct()
    number = ents.groupBy(*place, F.struct("ini", "fin").alias("s")).agg(F.max("n").alias("n"))
    at = lambda s, n: number.select(*place, F.col("s").alias(s), F.col("n").alias(n))
    both = spans_of(rels_b, ents_b).join(said, [*place, "kx", "ky", "predicado"], "left_semi").join(at("x", "na"), [*place, "x"]).join(at("y", "nb"), [*place, "y"])
    return ents.select(*place, F.col("n").alias("i"), "ini", "fin", "tipo"), both.select(*place, F.col("na").alias("a"), F.col("nb").alias("b"), "predicado", "cuando")


def model_agreement(reference: DataFrame, candidates: DataFrame, least: float = 0.5) -> DataFrame:
    """Per model of candidates (modelo, wp_id, pi, ini, fin, tipo, score) how far it agrees with a reference run: modelo, comunes, acuerdo.

    Over the articles that both have: twice the model's sure entities that overlap one of the reference, over both runs' entities.
    """
    sure = lambda df, *k: df.where(F.col("score") >= least).select(*k, *SPAN).distinct()
    common = candidates.select("modelo", "wp_id").distinct().join(reference.select("wp_id").distinct(), "wp_id", "left_semi")
    b = sure(candidates, "modelo").join(common, ["modelo", "wp_id"], "left_semi").groupBy("modelo", "wp_id", "pi", "tipo").agg(F.collect_list(F.struct("ini", "fin")).alias("y"))
    a = sure(reference).groupBy("wp_id", "pi", "tipo").agg(F.collect_list(F.struct("ini", "fin")).alias("x"))
    hit = F.filter("y", lambda m: F.exists("x", lambda t: (m["ini"] < t["fin"]) & (t["ini"] < m["fin"])))
    theirs = b.join(a, ["wp_id", "pi", "tipo"], "left").groupBy("modelo").agg(F.sum(F.when(F.col("x").isNull(), 0).otherwise(F.size(hit))).alias("casadas"), F.sum(F.size("y")).alias("n_b"))
    ours = common.join(a, "wp_id").groupBy("modelo").agg(F.sum(F.size("x")).alias("n_a"))
    n = common.groupBy("modelo").agg(F.count("*").alias("comunes")).join(theirs, "modelo", "left").join(ours, "modelo", "left").fillna(0)
    return n.select("modelo", "comunes", F.round(2 * F.col("casadas") / F.greatest(F.col("n_a") + F.col("n_b"), F.lit(1)), 6).alias("acuerdo"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per type: spans of run a that overlap one of run b, spans of either without a partner, and the share that agrees.

    Both runs' spans of a paragraph and type meet as two lists, so either side is shuffled once and no pair becomes a row.
    """
    place = ["wp_id", "pi", "tipo"]
    side = lambda df, name: df.groupBy(*place).agg(F.collect_set(F.struct("ini", "fin")).alias(name))
    lists = side(a, "x").join(side(b, "y"), place, "full")
    meets = lambda mine, theirs: F.coalesce(F.size(F.filter(mine, lambda m: F.exists(theirs, lambda t: (m["ini"] < t["fin"]) & (t["ini"] < m["fin"])))), F.lit(0))
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    hit, back = F.when(F.col("y").isNull() | F.col("x").isNull(), 0).otherwise(meets("x", "y")), F.when(F.col("y").isNull() | F.col("x").isNull(), 0).otherwise(meets("y", "x"))
    j = lists.groupBy("tipo").agg(F.sum(hit).alias("emparejadas"), F.sum(n("x") - hit).alias("solo_a"), F.sum(n("y") - back).alias("solo_b"))
    return j.withColumn("acuerdo", F.round(F.col("emparejadas") / (F.col("emparejadas") + F.col("solo_a") + F.col("solo_b")), 6))


def decisions_agree(a: DataFrame, b: DataFrame) -> DataFrame:
    """Decisions on the same key that agree or differ."""
    j = a.select("clave", F.col("decision").alias("x")).join(b.select("clave", F.col("decision").alias("y")), "clave")
    return j.agg(F.count_if(F.col("x") == F.col("y")).alias("coinciden"), F.count_if(F.col("x") != F.col("y")).alias("difieren"))


def leakage(training: DataFrame, apart: DataFrame, key: str) -> DataFrame:
    """Held-out rows that are in training: must be empty."""
    return apart.join(training.select(key), key, "left_semi")


def generic_rate(props: DataFrame, sure: float = 0.9) -> DataFrame:
    """Share of entities of naming types written wholly in lower case, and how many of those are sure."""
    low = F.col("texto") == F.lower("texto")
    named = props.where(~F.col("tipo").isin("monto", "cargo"))
    return named.agg(F.count("*").alias("n"), F.round(F.avg(low.cast("double")), 6).alias("tasa"), F.count_if(low & (F.col("score") >= sure)).alias("seguras"))


def runs_against_decisions(run: DataFrame, kept: DataFrame, proposals: DataFrame, cut: float) -> DataFrame:
    """Per reviewed article, what a run found again: of the marks kept, and of the proposals that people deleted.

    A proposal is deleted if no kept mark of its type overlaps it. Columns: wp_id, halladas, conservadas, repetidas, borradas, propuestas.
    """
    place = ["wp_id", "pi", "ini", "fin", "tipo"]
    gold = kept.select(*place).distinct()
    reviewed = gold.select("wp_id").distinct()
    gone = overlap_join(proposals.select(*place).distinct().join(reviewed, "wp_id", "left_semi"), gold, "left_anti")
    found = run.where(F.col("score") >= cut).select(*place).distinct().join(reviewed, "wp_id", "left_semi")

    def hits(df: DataFrame, names: tuple[str, str]) -> DataFrame:
        again = overlap_join(df, found, "left").groupBy(*place).agg(F.max(F.col("h_wp_id").isNotNull()).alias("hit"))
        return again.groupBy("wp_id").agg(F.count_if("hit").alias(names[0]), F.count("*").alias(names[1]))

    out = hits(gold, ("halladas", "conservadas")).join(hits(gone, ("repetidas", "borradas")), "wp_id", "left")
    out = out.join(found.groupBy("wp_id").agg(F.count("*").alias("propuestas")), "wp_id", "left")
    return out.select("wp_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("halladas", "conservadas", "repetidas", "borradas", "propuestas")))


def verdict_tally(verdicts: DataFrame) -> DataFrame:
    """Per type how many verdicts of each kind, and their share: tipo, veredicto, n, cuota."""
    n = verdicts.groupBy("tipo", "veredicto").agg(F.count("*").alias("n"))
    return n.join(n.groupBy("tipo").agg(F.sum("n").alias("all")), "tipo").select("tipo", "veredicto", "n", F.round(F.col("n") / F.col("all"), 6).alias("cuota"))


def suspicious_empty(paragraphs: DataFrame, marks: DataFrame, least: int = 2) -> DataFrame:
    """Paragraphs (wp_id, pi, propios) without a mark though `least` words in them look like proper nouns: to be tried again."""
    some = paragraphs.withColumn("propios", proper_nouns(F.col("parrafo"))).where(F.col("propios") >= least)
    return some.join(marks.select("wp_id", "pi"), ["wp_id", "pi"], "left_anti").select("wp_id", "pi", "propios")
