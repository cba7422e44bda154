"""Aligning an outside list of quotes and relations with the archive's paragraphs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.checks import outside_kin, outside_relation, outside_type
from tessera.functions.text import name_variants, url_key
from tessera.functions.unicode_folds import alignment_fold
from tessera.operators.marking import _plain

#: A shorter quote proves nothing; of a long one its first and last words are tried as well.
LEAST_CHARS, EDGE_WORDS = 20, 12


def by_url(rows: DataFrame, census: DataFrame) -> DataFrame:
    """Rows with the article of the same address, whatever its scheme, www or closing slash; null without one.

    Articles whose addresses differ in that alone are different ones: an address written just like the row's comes first, and of
    several the smallest wp_id. The spellings of an address are few.
    """
    spelt = census.where("link is not null").groupBy(url_key(F.col("link")).alias("_u"), "link").agg(F.min("wp_id").alias("wp_id"))
    c = spelt.groupBy("_u").agg(F.min("wp_id").alias("_any"), F.map_from_entries(F.collect_list(F.struct("link", "wp_id"))).alias("_by"))
    j = rows.withColumn("_u", url_key(F.col("url"))).join(c, "_u", "left")
    return j.withColumn("wp_id", F.coalesce(F.try_element_at("_by", F.col("url")), F.col("_any"))).drop("_u", "_any", "_by")


def fragments(quotes: DataFrame) -> DataFrame:
    """(id, wp_id, intento, trozo): the folded quote (0), and of one of over 12 words its first (1) and last (2) twelve."""
    q = quotes.select("id", "wp_id", alignment_fold(F.col("cita")).alias("c")).where(F.length("c") >= LEAST_CHARS).withColumn("w", F.split("c", " "))
    edges = F.array(F.col("c"), F.array_join(F.slice("w", 1, EDGE_WORDS), " "), F.array_join(F.slice("w", -EDGE_WORDS, EDGE_WORDS), " "))
    tries = F.when(F.size("w") > EDGE_WORDS, edges).otherwise(F.array("c"))
    return q.select("id", "wp_id", F.posexplode(tries).alias("intento", "trozo"))


def locate_quotes(quotes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The paragraph that holds each quote, and where in its folded text: id, pi, intento, en.

    quotes: (id, wp_id, cita); paragraphs: (wp_id, pi, parrafo). The whole quote is looked for first, then its first words, then
    its last; of several paragraphs the earliest counts. Texts are compared folded; a match may begin and end inside a word.
    The second and third word of a fragment of four words or more are whole in any match, so such fragments meet only the
    paragraphs of their article that have these two in a row; shorter ones meet all of its paragraphs. Quotes under 20
    characters prove nothing and are left out.
    """
    f = fragments(quotes).withColumn("w", F.split("trozo", " "))
    pair = F.concat_ws(" ", F.get("w", F.lit(1)), F.get("w", F.lit(2)))
    f = f.select("id", "wp_id", "intento", "trozo", F.when(F.size("w") >= 4, F.xxhash64(pair)).alias("g"))
    p = paragraphs.select("wp_id", "pi", alignment_fold(F.col("parrafo")).alias("x"))
    words = F.split("x", " ")
    pairs = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.xxhash64(F.concat_ws(" ", F.get("w", i), F.get("w", i + 1))))
    index = p.withColumn("w", words).where(F.size("w") > 1).select("wp_id", "pi", F.explode(F.array_distinct(pairs)).alias("g"))
    met = f.where("g is not null").join(index, ["wp_id", "g"]).join(p, ["wp_id", "pi"])
    near = met.select("id", "intento", "trozo", "pi", "x").union(f.where("g is null").join(p, "wp_id").select("id", "intento", "trozo", "pi", "x"))
    hit = near.withColumn("en", F.position("trozo", "x") - 1).where("en >= 0")
    return hit.groupBy("id").agg(F.min(F.struct("intento", "pi", "en")).alias("m")).select("id", "m.pi", "m.intento", "m.en")


def outcomes(rows: DataFrame, census: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Each row (id, url, cita, a, b) with its article, paragraph and the reason it ends with.

    sin cita, sin artículo, cita no hallada, extremo no hallado, mismo tramo, alineada.
    """
    placed = by_url(rows, census)
    quotes = placed.where(F.col("cita").isNotNull() & F.col("wp_id").isNotNull())
    j = placed.join(locate_quotes(quotes, paragraphs), "id", "left").join(paragraphs, ["wp_id", "pi"], "left")
    there = lambda c: F.contains(F.lower("parrafo"), F.lower(c))
    reason = (
        F.when(F.col("cita").isNull() | (F.trim("cita") == ""), "sin cita")
        .when(F.col("wp_id").isNull(), "sin artículo")
        .when(F.col("parrafo").isNull(), "cita no hallada")
        .when(~F.coalesce(there("a") & there("b"), F.lit(False)), "extremo no hallado")
        .when(F.lower("a") == F.lower("b"), "mismo tramo")
        .otherwise("alineada")
    )
    return j.select("id", "wp_id", "pi", reason.alias("motivo"))


def tally(found: DataFrame) -> DataFrame:
    return found.groupBy("motivo").agg(F.count("*").alias("n"))


def hint_recall(hints: DataFrame, annotated: DataFrame) -> DataFrame:
    """Hints (wp_id, pi, a, b) and how many an annotated relation of the paragraph confirms, whichever way round."""
    pair = lambda x, y: F.concat_ws("|", F.array_sort(F.array(F.lower(x), F.lower(y))))
    h = hints.select("wp_id", "pi", pair("a", "b").alias("par")).distinct()
    r = annotated.select("wp_id", "pi", pair("a", "b").alias("par")).distinct().withColumn("_r", F.lit(1))
    return h.join(r, ["wp_id", "pi", "par"], "left").agg(F.count("*").alias("pistas"), F.count("_r").alias("confirmadas"))


# Relations and posts of outside runs ------------------------------------------------------------------------------------

# Trades that name no post.
LOOSE_TRADES = (
    "abogado", "abogada", "periodista", "empresario", "empresaria", "político", "politico", "política",
    "economista", "escritor", "escritora", "académico", "académica", "investigador", "investigadora",
    "analista", "activista", "líder", "lider", "dirigente", "funcionario", "funcionaria", "experto", "experta",
)


def nearest(parrafo: Column, variants: Column, near: Column) -> Column:
    """Where the first of these wordings that is there stands: struct (ini, fin), of several places the one nearest to `near`.

    Wordings are as of `name_variants`: folded words, which may stand with any signs between them, accents and case aside, as
    whole words; ties go to the earlier place. Null if none is there.
    """

    @F.pandas_udf("struct<ini:int,fin:int>")
    def of(texts: pd.Series, wordings: pd.Series, nears: pd.Series) -> pd.DataFrame:
        rows = []
        for t, ws, n in zip(texts, wordings, nears):
            found, flat = None, _plain(t or "")
            for w in ws if ws is not None else ():
                spots = [m.span() for m in re.finditer(r"(?<!\w)" + r"[\W_]+".join(map(re.escape, w.split())) + r"(?!\w)", flat)] if w.strip() else []
                if spots:
                    found = min(spots, key=lambda s: abs(s[0] - (n if n == n and n is not None else 0)))
                    break
            rows.append(found or (None, None))
        return pd.DataFrame(rows, columns=["ini", "fin"]).astype("Int32")

    return of(parrafo, variants, near)


def _spot(parrafo: str, name: str, near: Column) -> Column:
    at = nearest(F.col(parrafo), name_variants(F.col(name)), near)
    return F.when(at["ini"].isNotNull(), at)


def relations_of_runs(rows: DataFrame, census: DataFrame, paragraphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aligned, outcomes) of relations that outside runs found in articles.

    rows: (id, corrida, url, citas array, a, b, clase_a, clase_b, relacion), no id in two rows, null names being unknown entities; census: (wp_id, link);
    paragraphs: (wp_id, pi, parrafo). The first quote that the article has gives the paragraph, and the ends are looked for near it
    (see nearest). Outcomes (id, corrida, motivo), one a row, the first that holds: sin_cita, sin_noticia, sin_entidad,
    cita_no_hallada, extremo_no_hallado, mismo_tramo, tipo_desconocido, duplicada, alineada. Aligned rows: wp_id, pi, a, b (ini, fin,
    texto, tipo), predicado (null for relations that an annotator has to tell apart), simetrico, relacion, cita, and corridas, all
    runs that found the same; of those the one of smallest run and id stays. Empty tables give no rows.
    """
    r = by_url(rows.withColumn("citas", F.filter("citas", lambda c: F.trim(c) != "")), census).withColumn("n", F.coalesce(F.size("citas"), F.lit(0)))
    asked = r.where("wp_id is not null and n > 0 and a is not null and b is not null").select("id", "wp_id", F.posexplode("citas").alias("k", "cita"))
    met = locate_quotes(asked.select(F.struct("id", "k").alias("id"), "wp_id", "cita"), paragraphs).select("id.id", F.struct("id.k", "pi", "en").alias("h"))
    j = r.join(met.groupBy("id").agg(F.min("h").alias("h")), "id", "left").withColumn("pi", F.col("h.pi")).join(paragraphs.select("wp_id", "pi", "parrafo"), ["wp_id", "pi"], "left")
    j = j.withColumns({"xa": _spot("parrafo", "a", F.col("h.en")), "xb": _spot("parrafo", "b", F.col("h.en")), "kin": outside_kin(F.col("relacion")), "fate": outside_relation(F.col("relacion"))})
    why = (
        F.when(F.col("n") < 1, "sin_cita")
        .when(F.col("wp_id").isNull(), "sin_noticia")
        .when(F.col("a").isNull() | F.col("b").isNull(), "sin_entidad")
        .when(F.col("pi").isNull(), "cita_no_hallada")
        .when(F.col("xa").isNull() | F.col("xb").isNull(), "extremo_no_hallado")
        .when(F.col("xa") == F.col("xb"), "mismo_tramo")
        .when(F.col("fate").isNull(), "tipo_desconocido")
    )
    j = j.withColumn("motivo", why)
    said, distant = F.upper(F.trim("relacion")), F.col("fate") == "familiar"
    j = j.withColumns({"predicado": F.when(distant, "familiar de").otherwise(F.col("kin.predicado")), "simetrico": distant | F.coalesce("kin.simetrico", F.lit(False))})
    key = ["wp_id", "pi", "xa", "xb", "clave"]
    fine = j.where("motivo is null").withColumn("clave", F.coalesce("predicado", said))
    first = fine.groupBy(*key).agg(F.min(F.struct("corrida", "id")).alias("m"), F.array_sort(F.collect_set("corrida")).alias("corridas"))
    kept = fine.join(first.select(*key, F.col("m.id").alias("id"), F.col("m.corrida").alias("corrida"), "corridas"), [*key, "id", "corrida"])
    end = lambda x, c: F.struct(F.col(f"{x}.ini").alias("ini"), F.col(f"{x}.fin").alias("fin"), F.expr(f"substring(parrafo, {x}.ini + 1, {x}.fin - {x}.ini)").alias("texto"), outside_type(F.col(c)).alias("tipo"))
    aligned = kept.select("id", "wp_id", "pi", end("xa", "clase_a").alias("a"), end("xb", "clase_b").alias("b"), "predicado", "simetrico", said.alias("relacion"), F.get("citas", F.col("h.k")).alias("cita"), "corridas")
    stays = kept.select("id", "corrida", F.lit("alineada").alias("_m"))
    outcomes = j.select("id", "corrida", "motivo").join(stays, ["id", "corrida"], "left").select("id", "corrida", F.coalesce("motivo", "_m", F.lit("duplicada")).alias("motivo"))
    return aligned, outcomes


def posts_of_runs(rows: DataFrame, census: DataFrame, paragraphs: DataFrame, loose: tuple[str, ...] = LOOSE_TRADES) -> tuple[DataFrame, DataFrame]:
    """(aligned, outcomes) of posts that outside runs gave to entities.

    rows: (id, corrida, url, persona, clase, cargo). A post is placed in the first paragraph that has it and, nearest to it,
    the person. Outcomes (id, corrida, motivo): sin_persona_o_noticia, oficio_suelto (a loose trade, or one word in small letters),
    no_hallado, duplicado, alineado; posts under four characters are no rows of it. Aligned: id, wp_id, pi, cargo and
    persona (ini, fin, texto), corrida: of equal ones the smallest run and id.
    """
    r = by_url(rows.withColumn("cargo", F.trim("cargo")).where(F.length("cargo") >= 4), census)
    small = (F.col("cargo") == F.lower("cargo")) & (F.col("cargo") != F.upper("cargo")) & ~F.contains("cargo", F.lit(" "))
    why = F.when(F.col("persona").isNull() | F.col("wp_id").isNull() | ~F.coalesce(outside_type(F.col("clase")) == "persona", F.lit(False)), "sin_persona_o_noticia").when(F.lower("cargo").isin(*loose) | small, "oficio_suelto")
    r = r.withColumn("motivo", why)
    p = r.where("motivo is null").join(paragraphs.select("wp_id", "pi", "parrafo"), "wp_id").withColumn("xc", _spot("parrafo", "cargo", F.lit(0))).where("xc is not null")
    p = p.withColumn("xp", _spot("parrafo", "persona", F.col("xc.ini"))).where("xp is not null")
    text = lambda x: F.struct(F.col(f"{x}.ini").alias("ini"), F.col(f"{x}.fin").alias("fin"), F.expr(f"substring(parrafo, {x}.ini + 1, {x}.fin - {x}.ini)").alias("texto"))
    spots = p.groupBy("id", "corrida", "wp_id").agg(F.min_by(F.struct("pi", text("xc").alias("cargo"), text("xp").alias("persona")), "pi").alias("h")).select("id", "corrida", "wp_id", "h.*")
    key = ["wp_id", "pi", "cargo", "persona"]
    first = spots.groupBy(*key).agg(F.min(F.struct("corrida", "id")).alias("m")).select(*key, "m.*")
    end = spots.select("id", "corrida").join(first.select("id", "corrida", F.lit("alineado").alias("m")), ["id", "corrida"], "left").select("id", "corrida", F.coalesce("m", F.lit("duplicado")).alias("_m"))
    outcomes = r.select("id", "corrida", "motivo").join(end, ["id", "corrida"], "left").select("id", "corrida", F.coalesce("motivo", "_m", F.lit("no_hallado")).alias("motivo"))
    return first.select("id", "corrida", *key), outcomes


def report_of_runs(outcomes: DataFrame) -> DataFrame:
    """Rows of each run by outcome, and in all (total)."""
    return outcomes.select("corrida", "motivo").union(outcomes.select("corrida", F.lit("total"))).groupBy("corrida", "motivo").agg(F.count("*").alias("n"))
