"""Places in a text after parts of it were cut out, and back: a piecewise map that spans are looked up in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def removed_before(cuts: Column, at: Column) -> Column:
    """How many characters before `at` lie in cuts (array of disjoint struct ini, fin in order)."""
    return F.aggregate(cuts, F.lit(0), lambda n, c: n + F.greatest(F.least(at, c["fin"]) - c["ini"], F.lit(0)))


def place_before(cuts: Column, at: Column) -> Column:
    """The place in the whole text of a place in the shortened one: never inside a cut, so after it where one begins."""
    return F.aggregate(cuts, at, lambda p, c: F.when(c["ini"] <= p, p + c["fin"] - c["ini"]).otherwise(p))


def disjoint(cuts: DataFrame, keys: list[str]) -> DataFrame:
    """Per text its cuts, merged where they touch or overlap and in order: keys, cortes. Empty and null ones go."""
    whole = cuts.where("ini >= 0 and fin > ini").groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(F.col("ini").cast("int").alias("ini"), F.col("fin").cast("int").alias("fin")))).alias("c"))
    none = F.array().cast("array<struct<ini:int,fin:int>>")

    def join(done: Column, c: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["ini"].alias("ini"), F.greatest(last["fin"], c["fin"]).alias("fin"))
        touches = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["fin"] >= c["ini"])
        return F.when(touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(c)))

    return whole.select(*keys, F.aggregate("c", none, join).alias("cortes"))


def after_cuts(spans: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """spans (keys, ini, fin, ...) with their places in the text without its cuts; what a cut holds wholly goes, parts of a span that are cut off are taken off it."""
    j = spans.join(disjoint(cuts, keys), keys, "left")
    moved = lambda c: F.col(c) - F.coalesce(removed_before(F.col("cortes"), F.col(c)), F.lit(0))
    j = j.withColumns({"_i": moved("ini"), "_f": moved("fin")}).where("_f > _i or fin = ini")
    return j.select(*(F.col("_i").alias(c) if c == "ini" else F.col("_f").alias(c) if c == "fin" else F.col(c) for c in spans.columns))


def before_cuts(spans: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """spans in a text without its cuts, with their places in the whole text; one that a cut lies within covers it."""
    j = spans.join(disjoint(cuts, keys), keys, "left")
    first = F.coalesce(place_before(F.col("cortes"), F.col("ini")), F.col("ini"))
    last = F.when(F.col("fin") > F.col("ini"), F.coalesce(place_before(F.col("cortes"), F.col("fin") - 1) + 1, F.col("fin"))).otherwise(first)
    j = j.withColumns({"_i": first, "_f": last})
    return j.select(*(F.col("_i").alias(c) if c == "ini" else F.col("_f").alias(c) if c == "fin" else F.col(c) for c in spans.columns))


def without_cuts(texts: DataFrame, cuts: DataFrame, keys: list[str], text: str = "parrafo") -> DataFrame:
    """texts with their cuts taken out of `text`."""
    j = texts.join(disjoint(cuts, keys), keys, "left")
    ends = F.concat(F.array(F.lit(0)), F.transform("cortes", lambda c: c["fin"]))
    kept = F.concat(F.transform("cortes", lambda c, k: F.substring(F.col(text), F.get(ends, k) + 1, c["ini"] - F.get(ends, k))), F.array(F.substring(F.col(text), F.element_at(ends, -1) + 1, F.length(text))))
    return j.withColumn(text, F.when(F.col("cortes").isNull(), F.col(text)).otherwise(F.array_join(kept, ""))).select(texts.columns)


def back_to_paragraph(spans: DataFrame, bases: DataFrame, keys: list[str], base: str = "base") -> DataFrame:
    """spans found in paragraphs whose first `base` characters (a speaker's label) had been taken off, as places in the whole ones."""
    j = spans.join(bases.select(*keys, F.col(base).alias("_b")), keys, "left")
    moved = lambda c: (F.col(c) + F.coalesce("_b", F.lit(0))).cast(spans.schema[c].dataType)
    return j.withColumns({"ini": moved("ini"), "fin": moved("fin")}).select(spans.columns)
