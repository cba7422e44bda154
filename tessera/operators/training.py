"""From reviewed paragraphs to training rows: glued titles, gold rows, hints, resolved ends, strata, reports."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.checks import GLUED_TITLE, gate, teachable
from tessera.functions.text import generic
from tessera.functions.vocabulary import PREDICATES, SYMMETRIC, TYPES
from tessera.operators.marking import tokens
from tessera.operators.relations import admissible
from tessera.operators.spans import greedy

PLACE = ["wp_id", "pi"]


def split_titles(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Persons with a title glued to their name are cut: (marks, relations).

    marks: (wp_id, pi, ini, fin, tipo, texto). The person keeps the name; the title becomes a post unless one is marked over
    it, and the two are related, as past if the title starts with ex. Titles of over three words stay. Null texts stay.
    """
    title, name = F.regexp_extract("texto", GLUED_TITLE, 1), F.regexp_extract("texto", GLUED_TITLE, 2)
    m = marks.withColumns({"_t": title, "_n": name})
    cut = (F.col("tipo") == "persona") & (F.col("_t") != "") & (F.trim("_n") != "") & (F.size(F.split("_t", r"\s+")) <= 3)
    m = m.withColumn("_cut", F.coalesce(cut, F.lit(False)))
    at = F.col("ini") + F.position("_t", "texto") - 1
    glued = m.where("_cut").select(*PLACE, (F.col("fin") - F.length("_n")).alias("ini"), "fin", at.alias("ini_t"), (at + F.length("_t")).alias("fin_t"), F.col("_t").alias("titulo"), F.col("_n").alias("nombre")).distinct()
    posts = marks.where("tipo = 'cargo'").select(*PLACE, F.struct("ini", "fin").alias("p"))
    over = (F.col("p.ini") <= F.col("ini_t")) & (F.col("p.fin") >= F.col("fin_t"))
    best = glued.join(posts, PLACE).where(over).groupBy(*PLACE, "ini", "fin").agg(F.min("p").alias("p"))
    found = glued.join(best, [*PLACE, "ini", "fin"], "left")
    kept = m.where("not _cut").select(*PLACE, "ini", "fin", "tipo", "texto")
    persons = glued.select(*PLACE, "ini", "fin", F.lit("persona").alias("tipo"), F.col("nombre").alias("texto"))
    new = found.where("p is null").select(*PLACE, F.col("ini_t").alias("ini"), F.col("fin_t").alias("fin"), F.lit("cargo").alias("tipo"), F.col("titulo").alias("texto")).distinct()
    past = F.when(F.lower("titulo").startswith("ex"), "pasada").otherwise("vigente")
    ties = found.select(*PLACE, F.col("ini").alias("a"), F.coalesce("p.ini", "ini_t").alias("b"), F.lit("ocupa el cargo").alias("predicado"), past.alias("cuando")).distinct()
    return kept.unionByName(persons).unionByName(new), ties


def gold_rows(marks: DataFrame, relations: DataFrame) -> DataFrame:
    """Per paragraph its marks and the relations between two of them, by their index in reading order.

    Titles (pi below zero) and marks of the retired type `evento` go, and with them their relations. marks: (wp_id, pi, mid,
    ini, fin, tipo, texto); relations: (wp_id, a_mid, b_mid, predicado, cuando). A paragraph bounds its lists.
    """
    m = marks.where("pi >= 0 and tipo <> 'evento'")
    m = m.withColumn("i", F.row_number().over(Window.partitionBy(*PLACE).orderBy("ini", "fin", "mid")) - 1)
    end = lambda s: m.select("wp_id", F.col("mid").alias(f"{s}_mid"), F.col("pi").alias(f"pi_{s}"), F.col("i").alias(s))
    r = relations.join(end("a"), ["wp_id", "a_mid"]).join(end("b"), ["wp_id", "b_mid"]).where("pi_a = pi_b")
    ties = r.groupBy("wp_id", F.col("pi_a").alias("pi")).agg(F.array_sort(F.collect_list(F.struct("a", "b", "predicado", "cuando"))).alias("relaciones"))
    ents = m.groupBy(*PLACE).agg(F.array_sort(F.collect_list(F.struct("i", "ini", "fin", "tipo", "texto"))).alias("entidades"))
    return ents.join(ties, PLACE, "left")


def resolved_ends(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations between texts as relations between entities: each end is the first entity of the paragraph with that text.

    entities: (wp_id, pi, i, texto); relations: (wp_id, pi, cabeza, cola, predicado, score). Ends that no entity has, and
    relations of an entity to itself, go.
    """
    first = entities.groupBy(*PLACE, "texto").agg(F.min("i").alias("i"))
    end = lambda text, i: first.select(*PLACE, F.col("texto").alias(text), F.col("i").alias(i))
    return relations.join(end("cabeza", "a"), [*PLACE, "cabeza"]).join(end("cola", "b"), [*PLACE, "cola"]).where("a <> b").select(*PLACE, "a", "b", "predicado", "score")


def hints(aligned: DataFrame, posts: DataFrame) -> DataFrame:
    """Per paragraph the entities of two outside lists, each with the first type said of it: wp_id, pi, texto, tipo.

    aligned: (wp_id, pi, orden, a, tipo_a, b, tipo_b); posts: (wp_id, pi, orden, persona, cargo). The first list comes first.
    """
    said = lambda df, text, tipo, k, side: df.select(*PLACE, F.col(text).alias("texto"), tipo.alias("tipo"), F.struct(F.lit(k).alias("l"), F.col("orden").alias("o"), F.lit(side).alias("s")).alias("x"))
    all_ = said(aligned, "a", F.col("tipo_a"), 0, 0).union(said(aligned, "b", F.col("tipo_b"), 0, 1)).union(said(posts, "persona", F.lit("persona"), 1, 0)).union(said(posts, "cargo", F.lit("cargo"), 1, 1))
    return all_.where(F.col("wp_id").isNotNull()).groupBy(*PLACE, "texto").agg(F.min_by("tipo", "x").alias("tipo"))


def strata(paragraphs: DataFrame, related: DataFrame, court: DataFrame) -> DataFrame:
    """Membership of each paragraph (wp_id, pi, parrafo) in the strata F, PL, J, E, N, A and R, as one row each: wp_id, pi, estrato.

    related: (wp_id, pi, predicado), null predicates being other relations (PL, where the paragraph has none of F);
    court: wp_id of articles with proceedings, which J needs besides its words.
    """
    r = related.groupBy(*PLACE).agg(F.max(F.col("predicado").isNotNull()).alias("f"))
    p = paragraphs.join(r, PLACE, "left").join(court.select("wp_id").distinct().withColumn("c", F.lit(True)), "wp_id", "left")
    text, family = F.col("parrafo"), F.coalesce("f", F.lit(False))
    flags = {
        "F": family,
        "PL": F.col("f").isNotNull() & ~family,
        "J": F.col("c").isNotNull() & gate(text, "J") & ~family,
        "E": gate(text, "E"),
        "N": gate(text, "N"),
        "A": gate(text, "A"),
        "R": F.lit(True),
    }
    return p.select(*PLACE, F.explode(F.array_compact(F.array(*(F.when(c, k) for k, c in flags.items())))).alias("estrato"))


def _dice(seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *PLACE))


def pilot_sample(members: DataFrame, quotas: dict[str, int], seed: int = 7) -> DataFrame:
    """The first rows of each stratum by a hash, as many as its quota; members: (wp_id, pi, estrato), in one stratum each."""
    out = None
    for name, n in quotas.items():
        part = members.where(F.col("estrato") == name).orderBy(_dice(seed), *PLACE).limit(n).select(*PLACE, "estrato")
        out = part if out is None else out.unionByName(part)
    return out


def pilot_report(rows: DataFrame) -> DataFrame:
    """Per model: paragraphs, invalid ones, median and 90th percentile (the value at index 0.9 n) of seconds, median tokens a second.

    rows: (modelo, invalido, segundos, tokens). The percentile ranks distinct values, not rows.
    """
    speed = F.when(~F.col("invalido") & (F.col("tokens") > 0) & (F.col("segundos") > 0), F.col("tokens") / F.col("segundos"))
    total = rows.groupBy("modelo").agg(F.count("*").alias("parrafos"), F.count_if("invalido").alias("invalidos"), F.round(F.median("segundos"), 6).alias("mediana"), F.round(F.median(speed), 6).alias("fichas_s"))
    n = rows.where("segundos is not null").groupBy("modelo", "segundos").agg(F.count("*").alias("k"))
    w = Window.partitionBy("modelo")
    upto = F.sum("k").over(w.orderBy("segundos").rowsBetween(Window.unboundedPreceding, 0))
    p90 = n.withColumns({"u": upto, "n": F.sum("k").over(w)}).where("u > floor(n * 0.9)").groupBy("modelo").agg(F.min("segundos").alias("p90"))
    return total.join(p90, "modelo", "left")


def family_report(paragraphs: DataFrame, relations: DataFrame, family: DataFrame) -> DataFrame:
    """Per model what it found again of an outside list of kinship and of hints: modelo, pistas, recuperadas, familia, predicado, direccion.

    paragraphs: (modelo, wp_id, pi, invalido, pistas, recuperadas); relations: (modelo, wp_id, pi, orden, ea, eb, predicado) between
    texts; family: (wp_id, pi, cabeza, cola, predicado, simetrico). A kinship counts as found by the paragraph's first relation of
    its predicate whose texts are the same or hold one another, either way round; it has the right direction if it holds both ways or the
    first texts match. Invalid paragraphs count for nothing.
    """
    fine = paragraphs.where(~F.col("invalido"))
    holds = lambda x, y: F.contains(x, y) | F.contains(y, x)
    ask = fine.select("modelo", *PLACE).join(family.withColumn("q", F.monotonically_increasing_id()), PLACE)
    low = ask.select("modelo", *PLACE, "q", "predicado", "simetrico", F.lower("cabeza").alias("h"), F.lower("cola").alias("t"))
    j = low.join(relations.select("modelo", *PLACE, "orden", "predicado", F.lower("ea").alias("x"), F.lower("eb").alias("y")), ["modelo", *PLACE, "predicado"], "left")
    pair = (holds(F.col("x"), F.col("h")) & holds(F.col("y"), F.col("t"))) | (holds(F.col("x"), F.col("t")) & holds(F.col("y"), F.col("h")))
    j = j.withColumn("dir", F.when(F.coalesce(pair, F.lit(False)), F.struct("orden", (F.col("simetrico") | holds(F.col("x"), F.col("h"))).alias("d"))))
    each = j.groupBy("modelo", "q").agg(F.min("dir").alias("m")).groupBy("modelo").agg(F.count("*").alias("familia"), F.count("m").alias("predicado"), F.count_if("m.d").alias("direccion"))
    hints = fine.groupBy("modelo").agg(F.coalesce(F.sum("pistas"), F.lit(0)).alias("pistas"), F.coalesce(F.sum("recuperadas"), F.lit(0)).alias("recuperadas"))
    return hints.join(each, "modelo", "left").fillna(0, ["familia", "predicado", "direccion"])


def model_table(articles: DataFrame, entities: DataFrame, relations: DataFrame, least: float = 0.5) -> DataFrame:
    """Per model: articles, seconds for 1,000 words, sure entities, share of them written generically (posts and amounts aside), relations.

    articles: (modelo, wp_id, palabras, segundos); entities: (modelo, wp_id, tipo, texto, score); relations: (modelo, wp_id).
    """
    a = articles.groupBy("modelo").agg(F.count("*").alias("articulos"), F.round(F.sum("segundos") * 1000 / F.greatest(F.sum("palabras"), F.lit(1)), 6).alias("seg_mil"))
    named = ~F.col("tipo").isin("cargo", "monto")
    e = entities.where(F.col("score") >= least).groupBy("modelo").agg(F.count("*").alias("entidades"), F.round(F.count_if(named & generic(F.col("texto"))) / F.greatest(F.count_if(named), F.lit(1)), 6).alias("genericas"))
    r = relations.groupBy("modelo").agg(F.count("*").alias("relaciones"))
    return a.join(e, "modelo", "left").join(r, "modelo", "left").fillna(0, ["entidades", "genericas", "relaciones"])


def _fit(m: Column) -> Column:
    return m["p"].isNotNull() & m["tipo"].isin(*TYPES) & F.coalesce(teachable(m["texto"], m["tipo"]), F.lit(False))


def _span(m: Column) -> Column:
    """A mark's first and last token; the struct sorts the longest mark first."""
    touched = F.transform("t", lambda t, k: F.when((t["fin"] > m["ini"]) & (t["ini"] < m["fin"]), k))
    return F.struct((m["ini"] - m["fin"]).alias("l"), m["i"].alias("i"), F.array_min(touched).alias("p"), F.array_max(touched).alias("u"), m["tipo"].alias("tipo"), m["texto"].alias("texto"))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with tokens `t`, all marks as spans `todas`, and `ner`: spans that stay, `de` being the marks that each stands for."""

    def place(ner: Column, m: Column) -> Column:
        hit = F.array_position(F.transform(ner, lambda n: (n["tipo"] == m["tipo"]) & (n["p"] <= m["u"]) & (m["p"] <= n["u"])), True)
        new = F.array(F.struct(m["p"].alias("p"), m["u"].alias("u"), m["tipo"].alias("tipo"), F.array(m["i"]).alias("de")))
        alias = lambda n: F.struct(n["p"].alias("p"), n["u"].alias("u"), n["tipo"].alias("tipo"), F.concat(n["de"], F.array(m["i"])).alias("de"))
        return F.when(hit == 0, F.concat(ner, new)).otherwise(F.transform(ner, lambda n, k: F.when(k == hit - 1, alias(n)).otherwise(n)))

    e = rows.withColumn("t", tokens(F.col("parrafo")))
    e = e.withColumn("todas", F.array_sort(F.transform("entidades", _span)))
    none = F.array().cast("array<struct<p:int,u:int,tipo:string,de:array<int>>>")
    return e.withColumn("ner", F.aggregate(F.filter("todas", _fit), none, place))


def _examined(rows: DataFrame, predicates: DataFrame) -> DataFrame:
    """Rows with fichas, ner, pares (null without any) and `motivos`, why marks and relations did not become part of them, once for each.

    All of it comes from the paragraph's own lists, so nothing is shuffled.
    """
    vocabulary = predicates.agg(F.collect_list(F.struct("predicado", "desde", "hasta")).alias("_v"))
    e = _placed(rows).crossJoin(F.broadcast(vocabulary))
    spot = lambda i: F.get(F.filter(F.transform("ner", lambda n, k: F.struct(k.alias("k"), n["tipo"].alias("tipo"), n["de"].alias("de"))), lambda n: F.array_contains(n["de"], i)), F.lit(0))
    e = e.withColumn("_t", F.transform("relaciones", lambda r, k: F.struct(k.alias("orden"), r["predicado"].alias("predicado"), spot(r["a"]).alias("a"), spot(r["b"]).alias("b"))))
    fits = lambda kinds, x: (F.size(kinds) == 0) | F.array_contains(kinds, x["tipo"])
    admits = lambda t: F.exists("_v", lambda p: (p["predicado"] == t["predicado"]) & fits(p["desde"], t["a"]) & fits(p["hasta"], t["b"]))
    apart = lambda t: F.coalesce(t["a"]["k"] != t["b"]["k"], F.lit(False))
    tie = lambda t, ok: F.struct(*(t[c].alias(c) for c in ("orden", "predicado")), t["a"]["k"].alias("a"), t["b"]["k"].alias("b"), ok.alias("ok"))
    e = e.withColumn("_t", F.transform("_t", lambda t: tie(t, F.when(apart(t), F.coalesce(admits(t), F.lit(False))))))

    # A relation has its first place; the other way round comes behind it.
    said = lambda t, v, a, b: F.struct(F.struct(t["orden"].alias("orden"), F.lit(v).alias("v")).alias("o"), t[a].alias("a"), t[b].alias("b"), t["predicado"].alias("predicado"))
    good = F.filter("_t", lambda t: t["ok"])
    both = F.concat(F.transform(good, lambda t: said(t, 0, "a", "b")), F.transform(F.filter(good, lambda t: t["predicado"].isin(*SYMMETRIC)), lambda t: said(t, 1, "b", "a")))
    e = e.withColumn("_p", F.array_sort(both))
    once = F.filter("_p", lambda x: ~F.exists("_p", lambda y: (y["o"] < x["o"]) & (y["a"] == x["a"]) & (y["b"] == x["b"]) & (y["predicado"] == x["predicado"])))
    e = e.withColumn("_p", F.transform(once, lambda y: F.struct(y["a"].alias("a"), y["b"].alias("b"), y["predicado"].alias("predicado"))))

    def unmarked(m: Column) -> Column:
        known, teaches = F.coalesce(m["tipo"].isin(*TYPES), F.lit(False)), F.coalesce(teachable(m["texto"], m["tipo"]), F.lit(False))
        return F.when(~known, "tipo_fuera").when(~teaches & (m["tipo"] == "monto"), "monto_sin_cifra").when(~teaches, "pronombre").when(m["p"].isNull(), "fuera_de_rango")

    def unrelated(t: Column) -> Column:
        known = F.coalesce(t["predicado"].isin(*(p[0] for p in PREDICATES)), F.lit(False))
        return F.when(t["ok"].isNull(), "rel_sin_extremo").when(~known, "rel_predicado_fuera").when(~t["ok"], "rel_tipos_no_admitidos")

    same = F.array_repeat(F.lit("solape_mismo_tipo"), F.size(F.filter("todas", _fit)) - F.size("ner"))
    empty = F.when(F.size("ner") < 1, F.array(F.lit("sin_entidades")))
    none = F.array().cast("array<string>")
    why = F.concat(*(F.coalesce(x, none) for x in (F.array_compact(F.transform("todas", unmarked)), same, empty, F.array_compact(F.transform("_t", unrelated)))))
    kept = F.transform("ner", lambda n: F.struct(n["p"].alias("p"), n["u"].alias("u"), n["tipo"].alias("tipo")))
    return e.select(*rows.columns, F.col("t.tok").alias("fichas"), kept.alias("ner"), F.when(F.size("_p") > 0, F.col("_p")).alias("pares"), why.alias("motivos"))


def examples(rows: DataFrame, predicates: DataFrame) -> DataFrame:
    """Training examples of paragraphs (wp_id, pi, parrafo, entidades, relaciones as of `gold_rows`): wp_id, pi, fichas, ner, relaciones.

    Marks become spans of tokens, widened to whole ones, the longest first; one that overlaps a span of its type is an alias
    of it, so relations to either survive. Pronouns, amounts without a figure and unknown types go. Relations between spans
    keep their first place if their predicate admits the types; those that hold both ways are doubled. Null texts have no tokens.
    """
    return _examined(rows, predicates).select(*PLACE, "fichas", "ner", F.col("pares").alias("relaciones"))


def discards(rows: DataFrame, predicates: DataFrame) -> DataFrame:
    """Why marks and relations of paragraphs did not become part of `examples`: wp_id, pi, motivo, n.

    Marks: tipo_fuera, pronombre, monto_sin_cifra, fuera_de_rango, solape_mismo_tipo (kept as an alias). Relations:
    rel_sin_extremo, rel_predicado_fuera, rel_tipos_no_admitidos. Paragraphs left without spans: sin_entidades.
    """
    return _examined(rows, predicates).select(*PLACE, F.explode("motivos").alias("motivo")).groupBy(*PLACE, "motivo").agg(F.count("*").alias("n"))


def training_set(rows: DataFrame, predicates: DataFrame, apart: DataFrame, test: DataFrame, one_in: int = 5, seed: int = 1) -> DataFrame:
    """Rows for the export (see sources.export): examples with their set, and counts of what was left out and why.

    rows: (wp_id, pi, parrafo, entidades, relaciones, fuente, conjunto, estrato), fuente being oro, plata or sintetico. Gold takes
    the place of other rows of its paragraph. Articles of `apart` (wp_id) go to the set apartado, and the job fails if one has
    other rows than gold; of articles of `test` gold goes to the set prueba and the rest is left out. Silver relations of
    persons with organisations are memberships. Of paragraphs without spans one in `one_in` stays, by a hash.
    Null sets are `train`; beside gold a paragraph occurs once.
    """
    gold = F.col("fuente") == "oro"
    no = F.lit(None).cast("boolean")
    flags = apart.select("wp_id", F.lit(True).alias("_a"), no.alias("_p")).union(test.select("wp_id", no, F.lit(True))).groupBy("wp_id").agg(F.max("_a").alias("_a"), F.max("_p").alias("_p"))
    # Rows are dealt by article once; a paragraph's few rows meet there.
    trodden = F.when(F.col("wp_id").isNotNull() & F.col("pi").isNotNull(), F.max(gold).over(Window.partitionBy(*PLACE)))
    r = rows.join(flags, "wp_id", "left").withColumn("_oro", F.coalesce(trodden, F.lit(False)))
    over, held, tried = F.col("_oro") & ~gold, F.col("_a").isNotNull(), F.col("_p").isNotNull()
    leak = F.raise_error(F.concat(F.lit("held-out paragraph "), F.concat_ws("/", *PLACE), F.lit(" in "), F.col("fuente")))
    kept = F.when(held & gold, F.lit("apartado")).when(held, leak.cast("string")).when(tried & gold, F.lit("prueba")).otherwise(F.coalesce("conjunto", F.lit("train")))
    out = F.when(over, "plata_pisada_por_oro").when(~held & tried & ~gold, "plata_en_prueba_fuera")
    r = r.withColumn("_fuera", out).withColumn("conjunto", F.when(F.col("_fuera").isNull(), kept))
    none = F.map_from_arrays(F.array(F.coalesce("_fuera", F.lit(""))), F.array(F.lit(1).cast("long")))
    left_out = r.where("_fuera is not null").select(*PLACE, "conjunto", "fuente", "estrato", F.lit(None).cast("string").alias("parrafo"), none.alias("descartes"))
    r = r.where("_fuera is null")
    kind = lambda i: F.get(F.filter("entidades", lambda m: m["i"] == i), F.lit(0))["tipo"]
    wrong = lambda x: (F.col("fuente") == "plata") & (x["predicado"] == "parte de") & (kind(x["a"]) == "persona") & (kind(x["b"]) == "organizacion")
    turned = F.transform("relaciones", lambda x: x.withField("predicado", F.when(wrong(x), "miembro de").otherwise(x["predicado"])))
    r = r.withColumns({"relaciones": turned, "_turned": F.size(F.filter("relaciones", wrong))})
    j = _examined(r, predicates).withColumn("cuando", F.transform("relaciones", lambda y: y["cuando"]))
    kinds = F.array_distinct("motivos")
    counts = F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter("motivos", lambda m: m == k)).cast("long")))
    members = F.when(F.col("_turned") > 0, F.map_concat(counts, F.create_map(F.lit("parte_de_a_miembro_de"), F.col("_turned").cast("long")))).otherwise(counts)
    few = (F.size("ner") > 0) | (F.pmod(F.xxhash64(F.lit(seed), *PLACE), F.lit(one_in)) == 0)
    columns = [*PLACE, "conjunto", "fuente", "estrato", "parrafo", "descartes", "fichas", "ner", "pares", "cuando"]
    j = j.withColumn("descartes", members).withColumn("conjunto", F.when(few, F.col("conjunto")))
    return j.select(*columns).unionByName(left_out, allowMissingColumns=True)


#: Types whose names mean the same wherever they stand in a paragraph; amounts repeat by chance.
REPEATABLE = ("persona", "organizacion", "lugar", "obra", "ley", "cargo")


def _whole(t: str | None, n: str | None) -> list[int]:
    return [m.start() for m in re.finditer(rf"(?<!\w){re.escape(n)}(?!\w)", t)] if t and n else []


def repeated(paragraphs: DataFrame, marks: DataFrame, least: int = 3) -> DataFrame:
    """Further places of marked texts in their own paragraph: wp_id, pi, ini, fin, tipo, texto.

    A place is the same spelling as a whole word, overlaps no mark, and takes the type of the text's first mark; of places that
    overlap one another the text that is marked earlier has it, then the longer one. Amounts and texts under `least` characters are not repeated.
    """

    @F.pandas_udf("array<int>")
    def places(texts: pd.Series, needles: pd.Series) -> pd.Series:
        return pd.Series([_whole(t, n) for t, n in zip(texts, needles)])

    first = marks.where(F.col("tipo").isin(*REPEATABLE) & (F.length("texto") >= least)).groupBy(*PLACE, "texto").agg(F.min(F.struct("ini", "fin", "tipo")).alias("m"))
    taken = marks.groupBy(*PLACE).agg(F.collect_list(F.struct("ini", "fin")).alias("_taken"))
    at = first.join(paragraphs.select(*PLACE, "parrafo"), PLACE).join(taken, PLACE).withColumn("en", places("parrafo", "texto"))
    spots = at.select(*PLACE, "texto", "m.tipo", (-F.col("m.ini")).cast("double").alias("score"), "_taken", F.explode("en").alias("ini")).withColumn("fin", F.col("ini") + F.length("texto"))
    free = spots.where(~F.exists("_taken", lambda k: (k["ini"] < F.col("fin")) & (k["fin"] > F.col("ini"))))
    return greedy(free, PLACE).select(*PLACE, "ini", "fin", "tipo", "texto")


def gold_sheet(paragraphs: DataFrame, sheet: DataFrame, said: DataFrame, predicates: DataFrame, proposed: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A hand-written sheet applied to its articles, each wholly or not at all: (marks, relations, problems).

    paragraphs: (wp_id, pi, parrafo); sheet: (wp_id, pi, texto, tipo), a type with a star designates without naming; said:
    (wp_id, pi, a, predicado, b, cuando) between texts. Longer texts are placed first, at every place between word bounds, else
    at every place, amounts at their first; of equals the earlier wins. Paragraphs of the same articles that neither sheet nor said
    has take what was `proposed`: marks (wp_id, pi, ini, fin, texto, tipo), at their further places too (see repeated), and
    relations as of said, under the same rules. Problems: tipo, texto, predicado, extremo, admite, misma.
    """
    s = sheet.select(*PLACE, "texto", F.rtrim("tipo", F.lit("*")).alias("tipo"), F.col("tipo").endswith("*").alias("designa")).distinct()
    own = sheet.select(*PLACE).union(said.select(*PLACE)).distinct()

    @F.pandas_udf("array<int>")
    def places(texts: pd.Series, needles: pd.Series) -> pd.Series:
        found = []
        for t, n in zip(texts, needles):
            found.append(_whole(t, n) or ([m.start() for m in re.finditer(re.escape(n), t)] if t and n else []))
        return pd.Series(found)

    w = s.join(paragraphs.select(*PLACE, "parrafo"), PLACE, "left").withColumn("en", places("parrafo", "texto"))
    w = w.withColumn("mal", F.when(~F.coalesce(F.col("tipo").isin(*TYPES), F.lit(False)), "tipo").when(F.size("en") < 1, "texto"))
    spots = w.where("mal is null").select(*PLACE, "texto", "tipo", F.explode(F.when(F.col("tipo") == "monto", F.slice("en", 1, 1)).otherwise(F.col("en"))).alias("ini"))
    spots = spots.withColumns({"fin": F.col("ini") + F.length("texto"), "score": F.length("texto").cast("double")})
    marks = greedy(spots, PLACE).drop("score").join(s, [*PLACE, "texto", "tipo"]).groupBy(*PLACE, "ini", "fin", "texto", "tipo").agg(F.max("designa").alias("designa"))
    if proposed is not None:
        left = lambda df: df.join(own, PLACE, "left_anti").join(own.select("wp_id").distinct(), "wp_id", "left_semi")
        kept = left(proposed[0]).select(*PLACE, "ini", "fin", "texto", "tipo").distinct()
        more = kept.unionByName(repeated(paragraphs, kept)).withColumn("designa", F.lit(False))
        marks, said = marks.unionByName(more), said.unionByName(left(proposed[1]).select(said.columns))
    first = marks.groupBy(*PLACE, "texto").agg(F.min_by(F.struct("ini", "fin", "tipo"), F.struct("ini", "fin")).alias("m"))
    end = lambda c: first.select(*PLACE, F.col("texto").alias(c), F.col("m").alias(f"m{c}"), F.col("m.tipo").alias(f"tipo_{c}"))
    r = said.withColumn("cuando", F.when(F.col("cuando").isin("vigente", "pasada", "futura"), F.col("cuando")).otherwise("vigente"))
    r = r.join(end("a"), [*PLACE, "a"], "left").join(end("b"), [*PLACE, "b"], "left").select(*PLACE, "a", "predicado", "b", "cuando", "ma", "mb", "tipo_a", "tipo_b")
    fits = admissible(r.select("predicado", "tipo_a", "tipo_b").distinct(), predicates).withColumn("cabe", F.lit(True))
    r = r.join(fits, ["predicado", "tipo_a", "tipo_b"], "left")
    known = F.coalesce(F.col("predicado").isin(*(p[0] for p in PREDICATES)), F.lit(False))
    wrong = F.when(~known, "predicado").when(F.col("ma").isNull() | F.col("mb").isNull(), "extremo").when(F.col("cabe").isNull(), "admite").when(F.col("ma") == F.col("mb"), "misma")
    r = r.withColumn("mal", wrong)
    problems = w.where("mal is not null").select(*PLACE, F.col("mal").alias("problema"), "texto").union(r.where("mal is not null").select(*PLACE, "mal", F.concat_ws(" ", "a", "predicado", "b"))).distinct()
    bad = problems.select("wp_id").distinct()
    turn = F.col("predicado").isin(*SYMMETRIC) & (F.col("ma") > F.col("mb"))
    ties = r.where("mal is null").select(*PLACE, F.when(turn, F.col("mb")).otherwise(F.col("ma")).alias("x"), F.when(turn, F.col("ma")).otherwise(F.col("mb")).alias("y"), "predicado", "cuando")
    ties = ties.select(*PLACE, F.col("x.ini").alias("a"), F.col("y.ini").alias("b"), "predicado", "cuando").distinct()
    return marks.join(bad, "wp_id", "left_anti"), ties.join(bad, "wp_id", "left_anti"), problems


def held_out(candidates: DataFrame, sections: dict[str, int], regions: tuple[str, ...], eras: tuple[str, ...], from_regions: int = 3, per_era: int = 10, total: int = 30, seed: int = 2026) -> DataFrame:
    """Keys to hold out (wp_id, seccion, tramo), by a hash: minimums of sections and of the regions, then eras filled up, cut to `per_era`, and any up to `total`.

    candidates: one row a key. Each step needs no more of its rows than all steps take together, so that many of each go to one task.
    """
    steps = [(F.col("seccion") == s, n) for s, n in sections.items()] + [(F.col("seccion").isin(*regions), from_regions)]
    steps += [(F.col("tramo") == e, per_era) for e in eras] + [(F.lit(True), total)]
    most = sum(n for _, n in steps)
    c = candidates.select("wp_id", "seccion", "tramo", F.md5(F.concat_ws("|", F.lit(str(seed)), "wp_id")).alias("d"))
    pool = None
    for cond, _ in steps:
        part = c.where(cond).orderBy("d", "wp_id").limit(most)
        pool = part if pool is None else pool.union(part)

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        left = rows.sort_values(["d", "wp_id"])
        chosen = left.iloc[:0]

        def take(of: pd.DataFrame, n: int) -> None:
            nonlocal chosen
            chosen = pd.concat([chosen, of[~of.wp_id.isin(chosen.wp_id)].head(max(n, 0))])

        for name, n in sections.items():
            take(left[left.seccion == name], n)
        take(left[left.seccion.isin(regions)], from_regions)
        for era in eras:
            take(left[left.tramo == era], per_era - int((chosen.tramo == era).sum()))
        kept = chosen.sort_values(["d", "wp_id"]).groupby("tramo", dropna=False).head(per_era)
        spare = left[~left.wp_id.isin(chosen.wp_id)].head(max(total - len(kept), 0))
        return pd.concat([kept, spare])[["wp_id", "seccion", "tramo"]]

    return pool.distinct().withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(pick, "wp_id long, seccion string, tramo string")
