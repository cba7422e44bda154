"""Calibration of score cut-offs from human review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.spans import overlap_join

# 26 cuts for types, 13 for predicates.
TYPE_CUTS = [round(0.30 + 0.05 * i, 2) for i in range(12)] + [i / 100 for i in range(86, 100)]
PREDICATE_CUTS = [round(0.30 + 0.05 * i, 2) for i in range(13)]
PRUNED = 1.01


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)


def _histogram(props: DataFrame, by: str) -> DataFrame:
    """Scores to four digits with how many proposals have them, accepted or not: the sweep works on this."""
    return props.groupBy(by, F.round("score", 4).alias("s")).agg(F.count_if("aceptada").alias("si"), F.count_if(~F.col("aceptada")).alias("no"))


def sweep(props: DataFrame, added: DataFrame, current: DataFrame, by: str = "tipo", cuts: list[float] = TYPE_CUTS) -> DataFrame:
    """Per type the cut of best F1: base (at the current cut), best cut and its F1.

    Accepted proposals under a cut are missed, like what people added; the current cut only gives way to one that is better
    by more than 1e-9, and of equally good ones the lowest wins. Proposals under the current cut were never shown: leave
    them out beforehand. The grid is small and meets a histogram, not the proposals.
    """
    h = _histogram(props, by)
    grid = props.sparkSession.createDataFrame([(c,) for c in cuts], "corte double")
    at = F.col("s") >= F.col("corte")
    n = h.crossJoin(F.broadcast(grid)).groupBy(by, "corte").agg(F.sum(F.when(at, F.col("si")).otherwise(0)).alias("vp"), F.sum(F.when(at, F.col("no")).otherwise(0)).alias("fp"), F.sum(F.when(~at, F.col("si")).otherwise(0)).alias("perdidas"))
    all_in = h.groupBy(by).agg(F.sum("si").alias("t_vp"), F.sum("no").alias("t_fp"))
    j = n.join(all_in, by).join(F.broadcast(added), by, "left").join(F.broadcast(current), by, "left")
    extra = F.coalesce("anadidas", F.lit(0))
    j = j.select(by, "corte", F.coalesce("vigente", F.lit(0.5)).alias("vigente"), f1(F.col("t_vp"), F.col("t_fp"), extra).alias("base"), f1(F.col("vp"), F.col("fp"), extra + F.col("perdidas")).alias("f"))
    j = j.withColumn("mejora", F.round(F.col("f"), 9) > F.round(F.col("base") + 1e-9, 9))
    best = j.groupBy(by, "vigente", "base").agg(F.max_by(F.struct("corte", "f", "mejora"), F.struct("mejora", F.when(F.col("mejora"), F.round("f", 9)), -F.col("corte"))).alias("m"))
    return best.select(by, "vigente", F.when(F.col("m.mejora"), F.col("m.corte")).otherwise(F.col("vigente")).alias("corte"), F.round("base", 6).alias("f1_antes"), F.round(F.when(F.col("m.mejora"), F.col("m.f")).otherwise(F.col("base")), 6).alias("f1_despues"))


def accepted(shown: DataFrame, marks: DataFrame) -> DataFrame:
    """Shown proposals with `aceptada`: a human mark of the same type overlaps (several proposals may claim one mark)."""
    columns = ["wp_id", "pi", "ini", "fin", "tipo", "texto", "score"]
    counted = shown.groupBy(*columns).agg(F.count("*").alias("_n"))
    joined = overlap_join(counted, marks.select("wp_id", "pi", "ini", "fin", "tipo"), "left")
    judged = joined.groupBy(*columns).agg(F.first("_n").alias("_n"), F.max(F.col("h_wp_id").isNotNull()).alias("aceptada"))
    return judged.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n")


def added_marks(marks: DataFrame, shown: DataFrame) -> DataFrame:
    """Human marks that no shown proposal overlaps."""
    return overlap_join(marks, shown.select("wp_id", "pi", "ini", "fin", "tipo"), "left_anti")


def blocklist(judged: DataFrame, least: int = 2) -> DataFrame:
    """(type, lower-cased text) rejected `least` times or more."""
    return judged.where("not aceptada").groupBy("tipo", F.lower("texto").alias("texto")).agg(F.count("*").alias("rechazos")).where(F.col("rechazos") >= least)


def dictionary(added: DataFrame, least: int = 3, times: int = 1) -> DataFrame:
    """(type, text) that people added, of `least` bytes or more."""
    return added.where(F.octet_length("texto") >= least).groupBy("tipo", "texto").agg(F.count("*").alias("veces")).where(F.col("veces") >= times)


def predicate_cuts(scores: DataFrame, by: str = "predicado", support: int = 3, floor: float = 0.2) -> DataFrame:
    """Per predicate with enough support the cut of best F1 (the lowest of equals), or the pruning cut if that is too low."""
    h = _histogram(scores, by)
    grid = scores.sparkSession.createDataFrame([(c,) for c in PREDICATE_CUTS], "corte double")
    at = F.col("s") >= F.col("corte")
    n = h.crossJoin(F.broadcast(grid)).groupBy(by, "corte").agg(
        F.sum(F.when(at, F.col("si")).otherwise(0)).alias("vp"), F.sum(F.when(at, F.col("no")).otherwise(0)).alias("fp"), F.sum(F.when(~at, F.col("si")).otherwise(0)).alias("fn"), F.sum("si").alias("apoyo")
    )
    n = n.where(F.col("apoyo") >= support).withColumn("f", F.round(f1(F.col("vp"), F.col("fp"), F.col("fn")), 9))
    best = n.groupBy(by, "apoyo").agg(F.max_by(F.struct("corte", "f"), F.struct("f", -F.col("corte"))).alias("m"))
    return best.select(by, F.col("apoyo").cast("long"), F.when(F.col("m.f") < floor, F.lit(PRUNED)).otherwise(F.col("m.corte")).alias("corte"), F.round("m.f", 6).alias("f1"))


def policies(scores: DataFrame, cuts: dict[str, float], by: str = "predicado") -> DataFrame:
    """Precision, recall and F1 of each global cut."""
    h = _histogram(scores, by)
    grid = scores.sparkSession.createDataFrame(sorted(cuts.items()), "politica string, corte double")
    at = F.col("s") >= F.col("corte")
    n = h.crossJoin(F.broadcast(grid)).groupBy("politica").agg(F.sum(F.when(at, F.col("si")).otherwise(0)).alias("vp"), F.sum(F.when(at, F.col("no")).otherwise(0)).alias("fp"), F.sum(F.when(~at, F.col("si")).otherwise(0)).alias("fn"))
    p, r = F.col("vp") / F.nullif(F.col("vp") + F.col("fp"), F.lit(0)), F.col("vp") / F.nullif(F.col("vp") + F.col("fn"), F.lit(0))
    return n.select("politica", F.round(F.coalesce(p, F.lit(0.0)), 6).alias("p"), F.round(F.coalesce(r, F.lit(0.0)), 6).alias("r"), F.round(f1(F.col("vp"), F.col("fp"), F.col("fn")), 6).alias("f1"))


def seeded(current: DataFrame, defaults: DataFrame) -> DataFrame:
    """Current cuts with the model's defaults where a type has none."""
    return defaults.join(current, "tipo", "full").select("tipo", F.coalesce("vigente", "defecto").alias("corte"))


def asking_floor(cuts: DataFrame, floor: float = 0.30) -> DataFrame:
    """The score from which a model is asked once: the lowest cut-off, `floor` at most. Cut-offs then apply to what is stored (`piso`)."""
    return cuts.agg(F.least(F.lit(floor), F.coalesce(F.min("corte"), F.lit(floor))).alias("piso"))


def saved(batches: DataFrame, cuts: DataFrame, blocked: DataFrame) -> DataFrame:
    """batches (lote_id, ...) with their calibration as JSON in `calibracion`: cut-offs by type and blocked (type, text); null without any.

    A batch bounds its lists; a calibration that was there before gives way to the new one.
    """
    c = cuts.groupBy("lote_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tipo", "corte")))).alias("umbrales"))
    b = blocked.groupBy("lote_id").agg(F.array_sort(F.collect_set(F.struct("tipo", "texto"))).alias("bloqueadas"))
    both = c.join(b, "lote_id", "full").select("lote_id", F.to_json(F.struct("umbrales", "bloqueadas")).alias("_c"))
    rest = [x for x in batches.columns if x != "calibracion"]
    old = F.col("calibracion") if "calibracion" in batches.columns else F.lit(None).cast("string")
    return batches.join(both, "lote_id", "left").select(*rest, F.coalesce("_c", old).alias("calibracion"))


def restored(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cuts, blocked) of saved() batches; what is no calibration counts as none."""
    c = F.from_json("calibracion", "umbrales map<string,double>, bloqueadas array<struct<tipo:string,texto:string>>")
    rows = batches.select("lote_id", c.alias("c"))
    return rows.select("lote_id", F.explode("c.umbrales").alias("tipo", "corte")), rows.select("lote_id", F.explode("c.bloqueadas").alias("b")).select("lote_id", "b.*")


def top_rejected(judged: DataFrame, k: int = 20) -> DataFrame:
    return blocklist(judged, 1).orderBy(F.desc("rechazos"), "tipo", "texto").limit(k)
