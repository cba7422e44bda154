"""Reading a model's answers about paragraphs: JSON to placed entities and relations, with counts of all that is refused."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.checks import teachable
from tessera.functions.text import FOLD_FROM, FOLD_TO, located
from tessera.functions.vocabulary import TYPES
from tessera.operators.relations import without_mirrors
from tessera.scratch import materialize

PLACE = ["wp_id", "pi"]
WHEN = ("vigente", "pasada", "futura")


class Answers(NamedTuple):
    """entities: wp_id, pi, i, ini, fin, tipo, texto; relations: wp_id, pi, orden, a, b, predicado, cuando (a and b are numbers i of
    entities); rejected_hints: wp_id, pi, orden, pista (JSON); refused: wp_id, pi, motivo, n."""

    entities: DataFrame
    relations: DataFrame
    rejected_hints: DataFrame
    refused: DataFrame


def _plain(c: Column) -> Column:
    return F.translate(F.lower(c), FOLD_FROM, FOLD_TO)


def _said(v: Column, *names: str) -> Column:
    """The first of these fields that is there, as text."""
    return F.coalesce(*(F.try_variant_get(v, f"$.{n}", "string") for n in names))


def _items(v: Column, *names: str) -> Column:
    """(orden, x): the objects of the first of these lists that is there."""
    listed = F.coalesce(*(F.try_variant_get(v, f"$.{n}", "array<variant>") for n in names))
    numbered = F.transform(listed, lambda x, k: F.struct(k.alias("orden"), x.alias("x")))
    return F.filter(numbered, lambda y: F.schema_of_variant(y["x"]).startswith("OBJECT"))


def _in_turn(place: Column, said: Column) -> Column:
    """Said entities (orden, dicho, tipo) with their places, wordings that differ in case alone each behind the one before: array of (orden, dicho, tipo, ini, fin)."""
    none = F.array().cast("array<struct<orden:int,dicho:string,tipo:string,ini:int,fin:int>>")

    def step(acc: Column, w: Column) -> Column:
        same = F.filter(acc, lambda h: h["fin"].isNotNull() & (F.lower(h["dicho"]) == F.lower(w["dicho"])))
        cur = F.coalesce(F.try_element_at(same, F.lit(-1))["fin"], F.lit(0))
        known = (w["dicho"] != "") & w["tipo"].isNotNull()
        # Lists of one, so that a place is looked for once.
        spot = lambda c: F.transform(F.array(F.when(known, located(F.substr(place, c + 1), w["dicho"]))), lambda z: F.struct(w["orden"].alias("orden"), w["dicho"].alias("dicho"), w["tipo"].alias("tipo"), (z["ini"] + c).alias("ini"), (z["fin"] + c).alias("fin")))
        return F.concat(acc, F.flatten(F.transform(F.array(cur), spot)))

    return F.aggregate(said, none, step)


def read(answers: DataFrame, predicates: DataFrame, decoy: str | None = "grupo generico", parents: tuple[str, str] = ("padre de", "hijo de")) -> Answers:
    """Answers (wp_id, pi, parrafo, salida), one a paragraph, as entities with places and relations with numbers.

    An answer may have words around its JSON and English field names. Each wording is looked for as it is, then case aside, then accents
    aside, behind the last place of the same wording; pronouns as persons and amounts without a figure go. `decoy` is a type asked
    of the model to keep generic groups out of the others: such entities stay, their relations go. A relation names its
    ends by their wording or by the text found; the first entity with it counts. Of a relation and its mirror the first
    stays; where both predicates of `parents` hold for one pair in one direction both go.
    Reasons: json_invalido, tipo_desconocido, no_localizada, pronombre, monto_sin_cifra, rel_predicado_desconocido, rel_mal_formada,
    rel_extremo_no_marcado, rel_con_senuelo, rel_tipos_no_admitidos, rel_contradictoria. Items that are no objects are passed over.
    """
    whole = F.try_parse_json("salida")
    inner = F.try_parse_json(F.regexp_extract("salida", r"(?s)\{.*\}", 0))
    parsed = answers.select(*PLACE, "parrafo", F.coalesce(whole, inner).alias("v")).withColumn("ok", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    v = F.col("v")

    keys = {**{k: k for k in TYPES}, **({decoy: decoy} if decoy else {})}
    kinds = F.create_map(*(F.lit(c) for kv in keys.items() for c in kv))
    field = lambda y, *names: _said(y["x"], *names)
    wording = lambda y, *names: F.trim(F.coalesce(field(y, *names), F.lit("")))
    entity = lambda y: F.struct(y["orden"].alias("orden"), wording(y, "texto", "text").alias("dicho"), kinds[_plain(field(y, "tipo", "type"))].alias("tipo"))
    tie = lambda y: F.struct(y["orden"].alias("orden"), wording(y, "a").alias("na"), wording(y, "b").alias("nb"), _plain(field(y, "predicado", "pred", "predicate", "relation")).alias("_p"), F.lower(field(y, "cuando", "when")).alias("cuando"))
    hint = lambda y: F.struct(y["orden"].alias("orden"), F.to_json(y["x"]).alias("pista"))
    lists = {"ents": F.transform(_items(v, "entidades", "entities"), entity), "ties": F.transform(_items(v, "relaciones", "relations"), tie), "hints": F.transform(_items(v, "pistas_rechazadas"), hint)}
    p = parsed.select(*PLACE, "ok", F.coalesce("parrafo", F.lit("")).alias("parrafo"), *(F.when(F.col("ok"), x).alias(c) for c, x in lists.items()))
    p = p.withColumn("ents", _in_turn(F.col("parrafo"), F.col("ents")))

    def judged(h: Column) -> Column:
        text = F.substr("parrafo", h["ini"] + 1, h["fin"] - h["ini"])
        unknown = (h["dicho"] == "") | h["tipo"].isNull()
        why = F.when(unknown, "tipo_desconocido").when(h["ini"].isNull(), "no_localizada").when(~teachable(text, h["tipo"]), F.when(h["tipo"] == "monto", "monto_sin_cifra").otherwise("pronombre"))
        return F.struct(*(h[c].alias(c) for c in ("orden", "dicho", "tipo", "ini", "fin")), text.alias("texto"), why.alias("motivo"))

    p = p.withColumn("ents", F.transform("ents", judged))
    # A paragraph's entities are one list, numbered as they were said.
    p = p.withColumn("marks", F.transform(F.filter("ents", lambda h: h["motivo"].isNull()), lambda h, i: F.struct(i.alias("i"), *(h[c].alias(c) for c in ("ini", "fin", "tipo", "texto", "dicho")))))
    named = lambda n: F.get(F.filter("marks", lambda m: (m["texto"] == n) | (m["dicho"] == n)), F.lit(0))
    ends = lambda t: F.struct(*(t[c].alias(c) for c in ("orden", "na", "nb", "_p", "cuando")), named(t["na"]).alias("ma"), named(t["nb"]).alias("mb"))
    p = p.withColumn("ties", F.transform("ties", ends))
    # An answer is read once; all that follows reads what was made of it.
    p = materialize(p.select(*PLACE, "ok", F.transform("ents", lambda h: h["motivo"]).alias("lost"), "marks", "ties", "hints"))
    marks = p.select(*PLACE, F.explode("marks").alias("m")).select(*PLACE, "m.i", "m.ini", "m.fin", "m.tipo", "m.texto")
    r = p.select(*PLACE, F.explode("ties").alias("t")).select(*PLACE, "t.orden", "t.na", "t.nb", "t._p", "t.cuando", *(F.col(f"t.m{s}.{c}").alias(n) for s in "ab" for c, n in (("i", s), ("tipo", f"tipo_{s}"))))
    r = r.join(F.broadcast(predicates.select(_plain(F.col("predicado")).alias("_p"), "predicado")), "_p", "left")
    # The vocabulary spelt out by types, so that no relation has to be looked at for it.
    any_type = F.array(*(F.lit(k) for k in TYPES))
    spelt = lambda c, to: F.explode(F.when(F.size(c) == 0, any_type).otherwise(F.col(c))).alias(to)
    fits = predicates.select("predicado", spelt("desde", "tipo_a"), "hasta").select("predicado", "tipo_a", spelt("hasta", "tipo_b"), F.lit(True).alias("_fits"))
    r = r.join(F.broadcast(fits), ["predicado", "tipo_a", "tipo_b"], "left")
    formed = (F.col("na") != "") & (F.col("nb") != "") & (F.col("na") != F.col("nb"))
    lure = F.lit(False) if decoy is None else (F.col("tipo_a") == decoy) | (F.col("tipo_b") == decoy)
    lost = F.when(F.col("predicado").isNull(), "rel_predicado_desconocido").when(~formed, "rel_mal_formada").when(F.col("a").isNull() | F.col("b").isNull(), "rel_extremo_no_marcado")
    r = r.withColumn("motivo", lost.when(lure, "rel_con_senuelo").when(F.col("_fits").isNull(), "rel_tipos_no_admitidos"))
    kept = without_mirrors(r.where("motivo is null").withColumn("score", F.lit(1.0)), PLACE, "orden")
    # The predicates between two entities of a paragraph are few.
    kin = F.collect_set(F.when(F.col("predicado").isin(*parents), F.col("predicado"))).over(Window.partitionBy(*PLACE, "a", "b"))
    kept = kept.withColumn("_kin", F.size(kin))
    clash = (F.col("_kin") == 2) & F.col("predicado").isin(*parents)
    both = kept.where(clash).select(*PLACE, "a", "b").distinct()
    ties = kept.where(~clash).select(*PLACE, "orden", "a", "b", "predicado", F.when(F.col("cuando").isin(*WHEN), F.col("cuando")).otherwise(WHEN[0]).alias("cuando"))

    hints = p.select(*PLACE, F.explode("hints").alias("h")).select(*PLACE, "h.orden", "h.pista")
    reason = lambda df, c: df.select(*PLACE, c.alias("motivo"))
    every = reason(p.where("not ok"), F.lit("json_invalido")).union(reason(p, F.explode("lost"))).union(reason(r, F.col("motivo"))).union(reason(both, F.lit("rel_contradictoria")))
    refused = every.where("motivo is not null").groupBy(*PLACE, "motivo").agg(F.count("*").alias("n"))
    return Answers(marks, ties, hints, refused)
