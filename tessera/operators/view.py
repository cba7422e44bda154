"""What a reviewer sees of an article: the proposals over their cut-offs, already grouped, and the relations between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import fold
from tessera.operators.spans import visible


def proposed_mentions(proposals: DataFrame, cuts: DataFrame, blocked: DataFrame, default: float = 0.5) -> DataFrame:
    """The visible proposals as mentions: wp_id, mid, pi, ini, fin, texto, tipo, auto, grupo, designa.

    proposals: (wp_id, pi, ini, fin, texto, tipo, score, canon). A group is what shares canonical form (else text) and type in
    the article; it counts proposals under the cut-off too, so a lone visible one may have a group. Its key is the folded form.
    An article bounds a window.
    """
    form = F.coalesce("canon", "texto")
    n = F.count("*").over(Window.partitionBy("wp_id", "tipo", form))
    grouped = proposals.withColumn("grupo", F.when(n >= 2, F.concat(F.lit("c:"), F.col("tipo"), F.lit(":"), fold(form))))
    shown = visible(grouped, cuts, blocked, default)
    mid = F.concat(F.lit("m"), F.concat_ws("-", "pi", "ini", "fin"))
    return shown.select("wp_id", mid.alias("mid"), "pi", "ini", "fin", "texto", "tipo", F.lit(True).alias("auto"), "grupo", F.lit(False).alias("designa"))


def proposed_relations(mentions: DataFrame, said: DataFrame) -> DataFrame:
    """Relations between texts as relations between mentions: wp_id, rid, a_mid, b_mid, predicado, cuando.

    said: (wp_id, pi, orden, a, b, predicado). Each end is the first mention of its text in the paragraph; relations without
    one of their ends, or of a mention to itself, go, and of two between the same mentions in one direction the first stays.
    """
    first = mentions.groupBy("wp_id", "pi", "texto").agg(F.min_by("mid", F.struct("ini", "fin")).alias("mid"))
    end = lambda c: first.select("wp_id", "pi", F.col("texto").alias(c), F.col("mid").alias(f"{c}_mid"))
    ends = said.join(end("a"), ["wp_id", "pi", "a"]).join(end("b"), ["wp_id", "pi", "b"]).where("a_mid <> b_mid")
    one = ends.groupBy("wp_id", "pi", "a_mid", "b_mid").agg(F.min_by("predicado", "orden").alias("predicado"))
    rid = F.concat(F.lit("r"), F.concat_ws("-", "pi", "a_mid", "b_mid"))
    return one.select("wp_id", rid.alias("rid"), "a_mid", "b_mid", "predicado", F.lit("vigente").alias("cuando"))
