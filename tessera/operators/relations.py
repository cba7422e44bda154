"""Relations between mentions: canonical ends, mirrors, admissible types, contradictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vocabulary import SYMMETRIC
from tessera.operators.sinks import _newest


def canonical_ends(df: DataFrame, symmetric: tuple[str, ...] = SYMMETRIC) -> DataFrame:
    """The ends of symmetric relations in ascending order."""
    turn = F.col("predicado").isin(*symmetric) & (F.col("a") > F.col("b"))
    return df.withColumns({"a": F.when(turn, F.col("b")).otherwise(F.col("a")), "b": F.when(turn, F.col("a")).otherwise(F.col("b"))})


def with_mentions(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """relations (wp_id, a_mid, b_mid, ...) with text, type and paragraph of both ends; those that lack an end go."""
    end = lambda s: mentions.select("wp_id", F.col("mid").alias(f"{s}_mid"), F.col("pi").alias(f"pi_{s}"), F.col("texto").alias(f"texto_{s}"), F.col("tipo").alias(f"tipo_{s}"))
    return relations.join(end("a"), ["wp_id", "a_mid"]).join(end("b"), ["wp_id", "b_mid"])


def without_mirrors(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of a relation and its mirror the one of higher score stays, the earlier one on ties."""
    keyed = df.withColumns({"_x": F.least("a", "b"), "_y": F.greatest("a", "b")})
    return _newest(keyed, [*by, "predicado", "_x", "_y"], F.struct("score", -F.col(order))).drop("_x", "_y")


def admissible(df: DataFrame, predicates: DataFrame) -> DataFrame:
    """Relations whose predicate goes from and to the types of their ends (an empty list admits any)."""
    p = F.broadcast(predicates.select("predicado", "desde", "hasta"))
    fits = lambda types, kind: (F.size(types) == 0) | F.array_contains(types, F.col(kind))
    return df.join(p, "predicado").where(fits("desde", "tipo_a") & fits("hasta", "tipo_b")).drop("desde", "hasta")


def applicable(pairs: DataFrame, predicates: DataFrame, fallback: str = "vínculo sin tipo", inverse: bool = False) -> DataFrame:
    """Predicates that fit each pair of types; `inverse` suggests those for the pair turned round, the fallback aside."""
    p = F.broadcast(predicates)
    a, b = ("tipo_b", "tipo_a") if inverse else ("tipo_a", "tipo_b")
    fit = ((F.size("desde") == 0) | F.array_contains("desde", F.col(a))) & ((F.size("hasta") == 0) | F.array_contains("hasta", F.col(b)))
    rows = pairs.join(p, fit)
    rows = rows.where(F.col("predicado") != fallback) if inverse else rows
    return rows.select("tipo_a", "tipo_b", "predicado", "familia", "orden")


def filter_chain(df: DataFrame, cuts: DataFrame, predicates: DataFrame, default: float = 0.5) -> DataFrame:
    """Over their predicate's cut (one above 1 prunes it), not to itself, both ends typed, types admissible."""
    rows = df.join(F.broadcast(cuts), "predicado", "left").where(F.col("score") >= F.coalesce("corte", F.lit(default))).drop("corte")
    rows = rows.where((F.col("a") != F.col("b")) & F.col("tipo_a").isNotNull() & F.col("tipo_b").isNotNull())
    return admissible(rows, predicates)


def without_contradictions(df: DataFrame, one: str = "padre de", other: str = "hijo de") -> DataFrame:
    """Drops both where two predicates that exclude each other hold for the same ordered pair."""
    pair = ["wp_id", "a", "b"]
    both = df.where(F.col("predicado").isin(one, other)).groupBy(*pair).agg(F.count_distinct("predicado").alias("k")).where("k = 2").select(*pair)
    bad = df.where(F.col("predicado").isin(one, other)).join(both, pair, "left_semi").select(*pair, "predicado").distinct()
    return df.join(bad, [*pair, "predicado"], "left_anti")


def conventional(df: DataFrame) -> DataFrame:
    """A person is a member of an organisation, not a part of it."""
    turn = (F.col("predicado") == "parte de") & (F.col("tipo_a") == "persona") & (F.col("tipo_b") == "organizacion")
    return df.withColumn("predicado", F.when(turn, "miembro de").otherwise(F.col("predicado")))


def translate(df: DataFrame, table: DataFrame, fallback: str = "vínculo sin tipo") -> DataFrame:
    """Predicates in another vocabulary, by (predicado, tipo_a, tipo_b) to (destino, invertir); others become the fallback."""
    t = F.broadcast(table.withColumnRenamed("predicado", "_p"))
    same = lambda c: F.col(f"_{c}").isNull() | (F.col(f"_{c}") == F.col(c))
    t = t.withColumnRenamed("tipo_a", "_tipo_a").withColumnRenamed("tipo_b", "_tipo_b")
    j = df.join(t, (F.col("predicado") == F.col("_p")) & same("tipo_a") & same("tipo_b"), "left")
    turn = F.coalesce("invertir", F.lit(False))
    swap = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    return j.withColumns(
        {"predicado": F.coalesce("destino", F.lit(fallback)), "a": swap("a", "b"), "b": swap("b", "a"), "tipo_a": swap("tipo_a", "tipo_b"), "tipo_b": swap("tipo_b", "tipo_a")}
    ).select(df.columns)


def checked(df: DataFrame, predicates: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Relations read from a model's text, with the reason why each is refused (null: accepted)."""
    p = F.broadcast(predicates.select(F.col("predicado").alias("_p"), "desde", "hasta"))
    j = df.join(p, F.col("predicado") == F.col("_p"), "left")
    fits = lambda kinds, t: (F.size(kinds) == 0) | F.array_contains(kinds, F.col(t))
    reason = (
        F.when(F.col("a").isNull() | F.col("b").isNull(), "extremo vacío")
        .when(F.col("a") == F.col("b"), "consigo mismo")
        .when(F.col("_p").isNull(), "predicado desconocido")
        .when(~F.col("tipo_a").isin(*types) | ~F.col("tipo_b").isin(*types), "tipo desconocido")
        .when(~(fits("desde", "tipo_a") & fits("hasta", "tipo_b")), "tipos no admitidos")
    )
    return j.withColumn("motivo", reason).drop("_p", "desde", "hasta")
