"""Entity resolution: name similarity by type, case queue, canonical names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import core, fold, initials, pair_key, post_core
from tessera.operators.components import connected_components

#: Below this confidence a pair is not even proposed.
LEAST = 0.4


def subsequence(short: Column, long: Column) -> Column:
    """True if the words of `short` stand in `long` in the same order."""
    step = lambda j, w: F.when(j == 0, F.lit(0)).otherwise(
        F.when(F.array_position(F.slice(long, j, F.size(long) + 1), w) == 0, F.lit(0)).otherwise((j + F.array_position(F.slice(long, j, F.size(long) + 1), w)).cast("int"))
    )
    return F.aggregate(short, F.lit(1), step) > 0


def initials_in_order(ca: Column, cb: Column, ia: Column, ib: Column) -> Column:
    """The one that abbreviates keeps its last word (three bytes or more) and its initials stand in order in the other's; either way round."""

    def one(x: Column, y: Column, ix: Column, iy: Column) -> Column:
        last = F.try_element_at(x, F.lit(-1))
        return (F.octet_length(last) >= 3) & F.array_contains(y, last) & subsequence(ix, iy)

    return F.coalesce((F.size(ia) >= 2) & (F.size(ib) >= 2) & (one(ca, cb, ia, ib) | one(cb, ca, ib, ia)), F.lit(False))


def generic_similarity(ca: Column, cb: Column, fa: Column, fb: Column, ia: Column, ib: Column) -> Column:
    """0 to 1: same fold, all words of the shorter in the longer, shared word and first initials, or most words shared."""
    common = F.size(F.array_intersect(ca, cb))
    less, more = F.least(F.size(ca), F.size(cb)), F.greatest(F.size(ca), F.size(cb))
    heads = F.aggregate(F.zip_with(ia, ib, lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, e: F.struct((s["n"] + (s["go"] & e).cast("int")).alias("n"), (s["go"] & e).alias("go")), lambda s: s["n"])
    union = F.size(F.array_distinct(ca)) + F.size(F.array_distinct(cb)) - common
    jaccard = common / F.nullif(union, F.lit(0))
    return (
        F.when((F.size(ca) == 0) | (F.size(cb) == 0), 0.0)
        .when(fa == fb, 1.0)
        .when(common == 0, 0.0)
        .when(common == less, 0.55 + 0.3 * (less / more))
        .when(heads >= 2, 0.45 + 0.05 * common)
        .when(jaccard >= 0.5, jaccard * 0.8)
        .otherwise(0.0)
    )


def similarity(tipo: Column, a: str, b: str) -> Column:
    """Similarity of two prepared names (structs of fold, core, initials, post), by their type."""
    x, y = F.col(a), F.col(b)
    a_short = F.size(x["core"]) <= F.size(y["core"])
    pick = lambda f: (F.when(a_short, x[f]).otherwise(y[f]), F.when(a_short, y[f]).otherwise(x[f]))
    short, long = pick("core")
    person = (
        F.when(F.size(short) == 0, 0.0)
        .when(subsequence(short, long), F.when(F.size(short) == 1, 0.45).otherwise(0.6 + 0.3 * (F.size(short) / F.size(long))))
        .when(initials_in_order(x["core"], y["core"], x["ini"], y["ini"]), 0.55)
        .otherwise(0.0)
    )
    post = F.when((F.size(x["post"]) > 0) & (x["post"] == y["post"]), 0.85).otherwise(0.0)
    other = generic_similarity(x["core"], y["core"], x["fold"], y["fold"], x["ini"], y["ini"])
    return F.when(x["fold"] == y["fold"], 1.0).when(tipo == "persona", person).when(tipo == "cargo", post).when(tipo.isin("ley", "monto"), 0.0).otherwise(other)


def prepared(names: DataFrame) -> DataFrame:
    n = F.col("nombre")
    return names.withColumn("p", F.struct(fold(n).alias("fold"), core(n).alias("core"), initials(n).alias("ini"), post_core(n).alias("post")))


def _pairs(p: DataFrame) -> DataFrame:
    """Pairs (tipo, a, b) of prepared names that some rule may accept.

    Equal folds and posts meet on those. Of two names that share two thirds of the shorter one's words (as those do that hold
    each other's words, or have a Jaccard index of a half) the shorter offers its rarest words, as many as cannot all be
    missing, and the longer all of its. Names that share one word only meet on it together with their initials.
    """
    w = p.select("tipo", "nombre", F.explode(F.array_distinct("p.core")).alias("w"))
    often = w.groupBy("tipo", "w").agg(F.count("*").alias("n"))
    rare = w.join(often, ["tipo", "w"]).groupBy("tipo", "nombre").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("x"))
    p = p.join(rare.select("tipo", "nombre", F.col("x.w").alias("x")), ["tipo", "nombre"], "left").withColumn("x", F.coalesce("x", F.array().cast("array<string>")))
    ini, words = F.col("p.ini"), F.col("x")
    tag = lambda t, c: F.transform(c, lambda v: F.concat(F.lit(t), v))
    only = lambda cond, c: F.when(cond, c).otherwise(F.array().cast("array<string>"))
    post = F.array_join("p.post", " ")
    equal = F.concat(tag("f:", F.array("p.fold")), only(post != "", tag("p:", F.array(post))))
    person, worded = F.col("tipo") == "persona", ~F.col("tipo").isin("cargo", "ley", "monto")
    heads = only(worded & ~person & (F.size(ini) >= 2), F.transform(words, lambda v: F.concat_ws(":", F.lit("h"), v, ini[0], ini[1])))
    enough = (F.size(words) - F.ceil(F.size(words) * 2 / 3) + 1).cast("int")
    offered = F.concat(equal, heads, only(worded, tag("c:", F.slice(words, 1, enough))), only(person & (F.size(ini) >= 2), F.array(F.concat_ws(":", F.lit("l"), F.try_element_at("p.core", F.lit(-1)), ini[0]))))
    each = F.flatten(F.transform(words, lambda v: F.transform(F.array_distinct(ini), lambda i: F.concat_ws(":", F.lit("l"), v, i))))
    asked = F.concat(equal, heads, only(worded, tag("c:", words)), only(person & (F.size(ini) >= 2), each))
    side = lambda keys, c: p.select("tipo", F.col("nombre").alias(c), F.explode(F.array_distinct(keys)).alias("k"))
    j = side(offered, "x").join(side(asked, "y"), ["tipo", "k"]).where("x <> y")
    return j.select("tipo", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def cases(names: DataFrame, decided: DataFrame | None = None, aliases: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """Pairs of names of a type with confidence `least` or more, without decided pairs and declared aliases; each is scored once."""
    p = prepared(names.select("nombre", "tipo", "menciones"))
    pairs = _pairs(p)
    side = lambda s: p.select(F.col("tipo"), F.col("nombre").alias(s), F.col("p").alias(f"p{s}"), F.col("menciones").alias(f"m{s}"))
    scored = pairs.join(side("a"), ["tipo", "a"]).join(side("b"), ["tipo", "b"])
    # Rounded before it is compared and sorted.
    scored = scored.withColumn("confianza", F.round(similarity(F.col("tipo"), "pa", "pb"), 2)).where(F.col("confianza") >= least)
    out = scored.select("tipo", "a", "b", "confianza", (F.col("ma") + F.col("mb")).alias("menciones"), pair_key(F.col("a"), F.col("b")).alias("clave"))
    if decided is not None:
        out = out.join(decided.where("decision <> 'posponer'").select("clave"), "clave", "left_anti")
    if aliases is not None:
        out = out.join(aliases.select(pair_key(F.col("a"), F.col("b")).alias("clave")), "clave", "left_anti")
    return out


def queue(found: DataFrame, k: int) -> DataFrame:
    """The k most doubtful cases, those with more mentions first."""
    return found.orderBy("confianza", F.desc("menciones"), "a", "b", "tipo").limit(k)


def canonical_names(same: DataFrame) -> DataFrame:
    """(nombre, canonico) over pairs (a, b) decided to be the same: the longest name of a component, ties by alphabet."""
    labels = connected_components(same.select(F.col("a").alias("u"), F.col("b").alias("v")))
    best = labels.groupBy("root").agg(F.min_by("node", F.struct(-F.length("node"), "node")).alias("canonico"))
    return labels.join(best, "root").select(F.col("node").alias("nombre"), "canonico")


def in_article(mentions: DataFrame) -> DataFrame:
    """Short forms within an article with the full form they stand for, if exactly one full form fits: wp_id, tipo, texto, canonico.

    Full forms have two significant words or more; forms of one fold are one, written as its longest. A short form
    fits a full one of its type (persons and organisations only) that has its word, or whose initials its capitals are.
    """
    m = prepared(mentions.where(F.col("tipo").isin("persona", "organizacion")).select("wp_id", "tipo", F.col("texto").alias("nombre")).distinct())
    full = m.where(F.size("p.core") >= 2).groupBy("wp_id", "tipo", "p.fold").agg(F.max_by(F.struct("nombre", "p"), F.struct(F.length("nombre"), "nombre")).alias("x"))
    words = F.transform("x.p.core", lambda w: F.concat(F.lit("w:"), w))
    keys = F.array_distinct(F.concat(words, F.array(F.concat(F.lit("s:"), F.array_join("x.p.ini", "")))))
    full = full.select("wp_id", "tipo", F.col("x.nombre").alias("canonico"), F.explode(keys).alias("k"))
    letters = F.regexp_replace("nombre", r"[^\p{L}]", "")
    capitals = ~F.col("nombre").rlike(r"\p{Ll}") & (letters != "")
    tries = F.array_compact(F.array(F.concat(F.lit("w:"), F.col("p.core")[0]), F.when(capitals, F.concat(F.lit("s:"), F.lower(letters)))))
    short = m.where(F.size("p.core") == 1).select("wp_id", "tipo", F.col("nombre").alias("texto"), F.explode(tries).alias("k"))
    n = short.join(full, ["wp_id", "tipo", "k"]).groupBy("wp_id", "tipo", "texto").agg(F.count_distinct("canonico").alias("k"), F.min("canonico").alias("canonico"))
    return n.where("k = 1").drop("k")


def recanonised(proposals: DataFrame) -> DataFrame:
    """A batch's proposals with `canon` resolved anew within each article: the full form of a short one, null for all else."""
    plain = proposals.drop("canon")
    forms = in_article(plain).withColumnRenamed("canonico", "canon")
    return plain.join(forms, ["wp_id", "tipo", "texto"], "left").select(*plain.columns, "canon")


def declared_aliases(marks: DataFrame) -> DataFrame:
    """Pairs of different texts that people put into one group."""
    g = marks.where(F.col("grupo").isNotNull()).select("wp_id", "grupo", "texto").distinct()
    a, b = g.alias("a"), g.alias("b")
    j = a.join(b, (F.col("a.wp_id") == F.col("b.wp_id")) & (F.col("a.grupo") == F.col("b.grupo")) & (F.col("a.texto") < F.col("b.texto")))
    return j.select(F.col("a.texto").alias("a"), F.col("b.texto").alias("b")).distinct()


def progress(decisions: DataFrame) -> DataFrame:
    return decisions.agg(F.count_if(F.col("decision") != "posponer").alias("decididas"), F.count_if(F.col("decision") == "posponer").alias("pospuestas"))


# Weight of each source of a decision.
SOURCE_WEIGHTS = {"persona": 3, "quien-ai": 2, "regla": 2, "juez": 1}


def identities(decisions: DataFrame) -> DataFrame:
    """Names that decisions make one, per type: canonical name, forms, and whether a decision of distinct contradicts it.

    Where sources disagree on a pair the heaviest decides.
    """
    weight = F.create_map(*(x for k, v in SOURCE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))))
    best = decisions.groupBy("tipo", "a", "b").agg(F.max_by("decision", F.struct(F.coalesce(weight[F.col("fuente")], F.lit(0)), "decision")).alias("decision"))
    tag = lambda c: F.concat("tipo", F.lit("\u0001"), c)
    same = best.where("decision = 'misma'").select(tag("a").alias("a"), tag("b").alias("b"))
    named = canonical_names(same)
    part = lambda c, i: F.split(c, "\u0001")[i]
    apart = best.where("decision = 'distinta'").select(tag("a").alias("x"), tag("b").alias("y"))
    clash = apart.join(named.select(F.col("nombre").alias("x"), F.col("canonico").alias("cx")), "x").join(named.select(F.col("nombre").alias("y"), F.col("canonico").alias("cy")), "y").where("cx = cy")
    clash = clash.select(F.col("cx").alias("canonico")).distinct().withColumn("_c", F.lit(True))
    forms = named.groupBy("canonico").agg(F.array_join(F.array_sort(F.collect_set(part("nombre", 1))), "|").alias("formas"))
    return forms.join(clash, "canonico", "left").select(part("canonico", 0).alias("tipo"), part("canonico", 1).alias("canonico"), "formas", F.coalesce("_c", F.lit(False)).alias("conflicto"))


def apply_identities(found: DataFrame, base: DataFrame, confidence: float = 0.9) -> DataFrame:
    """Cases that a base of identities settles: both names among the forms of one entry (tipo, formas array)."""
    f = base.withColumn("_id", F.monotonically_increasing_id()).select("_id", "tipo", F.explode("formas").alias("forma"))
    side = lambda c: f.select("tipo", "_id", fold(F.col("forma")).alias(f"_f{c}"))
    j = found.withColumns({"_fa": fold(F.col("a")), "_fb": fold(F.col("b"))}).join(side("a"), ["tipo", "_fa"]).join(side("b"), ["tipo", "_id", "_fb"])
    return j.select("tipo", "a", "b").distinct().withColumns({"decision": F.lit("misma"), "confianza": F.lit(confidence), "fuente": F.lit("identidades")})


def judged(verdicts: DataFrame) -> DataFrame:
    """Decisions from a judge's verdicts: sure pairs by rule, unsure verdicts postponed."""
    sure = (F.col("confianza") >= 0.99) | F.col("mismo_cargo")
    d = F.when(sure, "misma").when(F.col("veredicto") < 0.75, "posponer").otherwise(F.col("decision"))
    return verdicts.withColumns({"decision": d, "fuente": F.when(sure, "regla").otherwise("juez")})


def imported_aliases(found: DataFrame, curated: DataFrame, profiles: DataFrame, mentions: DataFrame, least: int = 2) -> DataFrame:
    """Decisions on cases of persons (tipo, a, b, clave) that outside lists settle: clave, a, b, decision, confianza.

    Two names of one curated group are the same (0.95); two that only ever resolved to the same profile, `least` times or
    more each, too (0.9); two full names with different profiles, neither within the other, are distinct (0.9).
    curated: (grupo, nombre); profiles: (nombre, perfil); mentions: (nombre, perfil), one row a mention.
    """
    f = lambda df: df.withColumn("f", fold(F.col("nombre")))
    own = f(profiles).where("f <> ''").groupBy("f").agg(F.min("perfil").alias("ficha"))
    seen = f(mentions).where("f <> ''").groupBy("f", "perfil").agg(F.count("*").alias("n")).groupBy("f").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.min("perfil").alias("u"))
    seen = seen.select("f", F.when((F.col("k") == 1) & (F.col("n") >= least), F.col("u")).alias("u"))
    groups = f(curated).where("f <> ''").groupBy("f").agg(F.collect_set("grupo").alias("g"))
    known = own.join(seen, "f", "full").join(groups, "f", "full")
    side = lambda s: known.select(F.col("f").alias(f"f{s}"), F.struct("ficha", "u", "g").alias(f"k{s}"))
    c = found.where("tipo = 'persona'").withColumns({"fa": fold(F.col("a")), "fb": fold(F.col("b"))})
    c = c.join(side("a"), "fa", "left").join(side("b"), "fb", "left").withColumns({"wa": F.split("fa", " "), "wb": F.split("fb", " ")})
    nested = F.when(F.size("wa") <= F.size("wb"), subsequence(F.col("wa"), F.col("wb"))).otherwise(subsequence(F.col("wb"), F.col("wa")))
    profile = lambda s: F.coalesce(f"k{s}.ficha", f"k{s}.u")
    full = (F.size("wa") >= 2) & (F.size("wb") >= 2) & ~nested
    group = F.coalesce(F.arrays_overlap("ka.g", "kb.g"), F.lit(False))
    said = lambda d, k: F.struct(F.lit(d).alias("decision"), F.lit(k).alias("confianza"))
    verdict = F.when(group, said("misma", 0.95)).when(F.col("ka.u") == F.col("kb.u"), said("misma", 0.9)).when(full & (profile("a") != profile("b")), said("distinta", 0.9))
    return c.withColumn("v", verdict).where("v is not null").select("clave", "a", "b", "v.decision", "v.confianza")
