"""Connected components of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.scratch import drop_scratch, materialize


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Labels each node of an undirected graph with the smallest node of its component.

    edges: (u, v), of one comparable type. Returns (node, root) for every node that has an edge to another one.
    Alternates small-star and large-star steps, which connect nodes to the smallest neighbour, until nothing changes;
    a component of any shape takes about log(n) rounds. Each step is a partial minimum and an equi-join that AQE can
    split, so a hub with very many neighbours never has to fit into one task, and rounds are cut by scratch tables.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    e, before = materialize(e), None

    def digest(df: DataFrame) -> tuple:
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    before = digest(e)
    for _ in range(most_rounds if before[0] else 0):
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        both = small.select(F.col("u").alias("a"), F.col("v").alias("b")).union(small.select("v", "u"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        new = materialize(large)
        now = digest(new)
        drop_scratch(e)
        e = new
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("connected components did not converge")
    star = e.groupBy("u").agg(F.min("v").alias("root"))
    return star.select(F.col("u").alias("node"), "root").union(star.select(F.col("root"), F.col("root")).distinct())
