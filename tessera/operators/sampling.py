"""Repeatable samples: strata with quotas, held-out sets, thinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _dice(seed: int, key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key))


def _die(seed: int, key: str) -> Column:
    """0 to 9,999."""
    return F.conv(F.substring(_dice(seed, key), 1, 8), 16, 10).cast("long") % 10_000


def quotas(df: DataFrame, quota: DataFrame, key: str = "wp_id", seed: int = 0) -> DataFrame:
    """Up to `cuota` rows of each stratum, picked by a hash; a row in several strata counts for the first by `prioridad`.

    df: (key, estrato) memberships. Ranks stop at the largest quota, so each task keeps no more rows of a stratum than that.
    """
    most = quota.agg(F.max("cuota")).first()[0] or 0
    m = df.join(F.broadcast(quota), "estrato")
    first = m.groupBy(key).agg(F.min_by(F.struct("estrato", "cuota"), F.struct("prioridad", "estrato")).alias("s")).select(key, "s.*")
    w = Window.partitionBy("estrato").orderBy(_dice(seed, key), key)
    return first.withColumn("orden", F.row_number().over(w)).where(F.col("orden") <= most).where("orden <= cuota").select(key, "estrato")


def split(df: DataFrame, share: float, key: str = "wp_id", seed: int = 1) -> DataFrame:
    """Adds `parte`: `val` for about `share` of the keys by hash, else `train`."""
    return df.withColumn("parte", F.when(_die(seed, key) < int(share * 10_000), "val").otherwise("train"))


def per_year(df: DataFrame, n: int, key: str = "wp_id", year: str = "anio") -> DataFrame:
    """n rows spread evenly over years, the remainder to the latest, smallest keys first; ranks stop at n."""
    years = df.select(year).distinct()
    ranked = years.withColumn("r", F.row_number().over(Window.orderBy(F.desc(year)))).crossJoin(years.agg(F.count("*").alias("k")))
    want = ranked.select(year, (F.floor(F.lit(n) / F.col("k")) + (F.col("r") <= n % F.col("k")).cast("int")).alias("cuota"))
    w = Window.partitionBy(year).orderBy(key)
    return df.join(F.broadcast(want), year).withColumn("orden", F.row_number().over(w)).where(F.col("orden") <= n).where("orden <= cuota").select(key, year)


def prefer(gold: DataFrame, silver: DataFrame, keys: list[str]) -> DataFrame:
    """Gold rows, and silver ones where gold has none."""
    g = gold.withColumn("fuente", F.lit("oro"))
    s = silver.join(gold.select(*keys), keys, "left_anti").withColumn("fuente", F.lit("plata"))
    return g.unionByName(s)


def thin_negatives(df: DataFrame, keep: int = 5, key: str = "wp_id") -> DataFrame:
    """All rows with content, and one in `keep` of the empty ones, by a hash of the key."""
    return df.where((~F.col("vacio")) | (F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(keep)) == 0))
