"""Archive profile: histograms, distributions, probes and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import materialize

SHORT_WORDS = 120


def year(date: Column) -> Column:
    return F.substring(date, 1, 4).try_cast("int")


def year_profile(census: DataFrame) -> DataFrame:
    """Articles per year of the validly dated; one row per year."""
    return census.where("date_valid").groupBy(year(F.col("date")).alias("anio")).agg(F.count("*").alias("n"))


def totals(census: DataFrame) -> DataFrame:
    """Total, undated, first and last year, in one row."""
    y = F.when(F.col("date_valid"), year(F.col("date")))
    return census.agg(F.count("*").alias("total"), F.count_if(~F.col("date_valid")).alias("sin_fecha"), F.min(y).alias("desde"), F.max(y).alias("hasta"))


def term_distribution(bridge: DataFrame, terms: DataFrame, taxonomy: str) -> DataFrame:
    """Articles per term of a taxonomy."""
    one = bridge.where(F.col("taxonomy") == taxonomy).groupBy("term_id").agg(F.count("*").alias("n"))
    return one.join(terms.where(F.col("taxonomy") == taxonomy).select("term_id", "name"), "term_id").select("term_id", "name", "n")


def count_by(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rows by a column: anomalies by kind, terms by taxonomy."""
    return df.groupBy(F.col(column).alias(name)).agg(F.count("*").alias("n"))


def completion(census: DataFrame, ledger: DataFrame) -> DataFrame:
    """Windows read, and windows there are: twelve a year and the leading tail."""
    y = year(F.col("date"))
    return census.where("date_valid").agg(((F.max(y) - F.min(y) + 1) * 12 + 1).cast("long").alias("ventanas")).crossJoin(ledger.agg(F.count_distinct("label").alias("hechas")))


def rank_percentiles(df: DataFrame, value: str, shares: dict[str, float], buckets: int = 200, times: str | None = None) -> DataFrame:
    """Elements at zero-based rank round((n - 1) * share) of the sorted values, one column per share; `times` says how often a row counts.

    Values are counted first, so what is ranked are the distinct values, spread over ranges that hold about as many of them
    each, outliers or not: their cumulative counts are sums within a range plus the totals of earlier ranges.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg((F.sum(times) if times else F.count("*")).alias("c"))
    edges = F.percentile_approx("v", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("edges")
    bounds = counts.agg(edges, F.sum("c").alias("n"))
    placed = counts.crossJoin(F.broadcast(bounds)).withColumn("bucket", F.size(F.filter("edges", lambda e: e < F.col("v")))).drop("edges")
    per = placed.groupBy("bucket").agg(F.sum("c").alias("bc"))
    before = per.select("bucket", F.coalesce(F.sum("bc").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    w = Window.partitionBy("bucket").orderBy("v")
    cum = placed.join(F.broadcast(before), "bucket").withColumn("upto", F.col("before") + F.sum("c").over(w))
    rank = lambda p: F.round((F.col("n") - 1) * p)
    return cum.agg(*(F.min(F.when(F.col("upto") > rank(p), F.col("v"))).alias(name) for name, p in shares.items()))


def probe(df: DataFrame) -> DataFrame:
    """Content probe of (words, blocks, broken): size, word percentiles by rank, shares in percent.

    What has the same three values is counted first and written down, so bodies are cleaned once whatever is asked of them.
    """
    c = materialize(df.groupBy("words", "blocks", "broken").agg(F.count("*").alias("c")))

    def share(flag: Column) -> Column:
        return F.round(100 * F.sum(F.when(flag, F.col("c")).otherwise(0)) / F.sum(F.when(flag.isNotNull(), F.col("c"))), 4)

    flags = c.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), share(F.col("blocks")).alias("pct_bloques"), share(F.col("words") < SHORT_WORDS).alias("pct_cortas"), share(F.col("broken")).alias("pct_rotas"))
    return flags.crossJoin(rank_percentiles(c, "words", {"p50": 0.5, "p90": 0.9}, times="c"))


def top_values(df: DataFrame, array: str, k: int = 6) -> DataFrame:
    """The k commonest elements of an array column, ties by name."""
    return df.select(F.explode(array).alias("valor")).groupBy("valor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "valor").limit(k)


def excess_duplicates(df: DataFrame, key: str) -> DataFrame:
    """Rows too many over all keys that occur more than once (empty keys aside), and how many such keys."""
    groups = df.where((F.col(key) != "") & F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excedente"), F.count("*").alias("grupos"))


def findings(census: DataFrame, bridge: DataFrame, probed: DataFrame, examples: int = 3) -> DataFrame:
    """Quality findings: kind, blocking, n, estimated, and up to `examples` smallest ids as a comma-separated text.

    Counts from the probe are extrapolated to the census and marked as estimated where the probe is smaller. What the probe
    says of each article is written down first, so bodies are cleaned once.
    """
    probed = materialize(probed.select("wp_id", "words", "broken"))
    total = census.agg(F.count("*").alias("t"))
    size = probed.agg(F.count("*").alias("p"))

    def ids(df: DataFrame) -> DataFrame:
        return df.select("wp_id").orderBy("wp_id").limit(examples).agg(F.array_join(F.array_sort(F.collect_list("wp_id")), ",").alias("ejemplos"))

    def exact(kind: str, blocking: bool, df: DataFrame, n: DataFrame) -> DataFrame:
        return n.crossJoin(ids(df)).select(F.lit(kind).alias("hallazgo"), F.lit(blocking).alias("bloquea"), F.col("n").cast("long").alias("n"), F.lit(False).alias("estimado"), "ejemplos")

    def guessed(kind: str, df: DataFrame) -> DataFrame:
        rows = df.agg(F.count("*").alias("k")).crossJoin(total).crossJoin(size).crossJoin(ids(df))
        n = F.coalesce(F.round(F.col("t") * F.col("k") / F.nullif(F.col("p"), F.lit(0))), F.lit(0)).cast("long")
        return rows.select(F.lit(kind).alias("hallazgo"), F.lit(False).alias("bloquea"), n.alias("n"), (F.col("p") < F.col("t")).alias("estimado"), "ejemplos")

    count = lambda df: df.agg(F.count("*").alias("n"))
    undated = census.where("not date_valid")
    keys = census.where("title_key <> ''").groupBy("title_key").agg(F.count("*").alias("n"), F.min("wp_id").alias("wp_id")).where("n > 1")
    bare = census.join(bridge.select("wp_id").distinct(), "wp_id", "left_anti")
    return (
        exact("fecha_invalida", True, undated, count(undated))
        .union(exact("duplicados", False, keys, keys.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))))
        .union(exact("sin_terminos", False, bare, count(bare)))
        .union(guessed("html_roto", probed.where("broken")))
        .union(guessed("notas_cortas", probed.where(F.col("words") < SHORT_WORDS)))
    )


def section_share(df: DataFrame, column: str, warn: float = 0.35) -> DataFrame:
    """Share of each section, a warning over `warn`, and whether it has one article or none."""
    n = df.groupBy(F.col(column).alias("seccion")).agg(F.count("*").alias("n"))
    all_rows = n.agg(F.sum("n").alias("t"))
    share = F.col("n") / F.col("t")
    return n.crossJoin(F.broadcast(all_rows)).select("seccion", "n", F.round(share, 6).alias("cuota"), (share > warn).alias("aviso"), (F.col("n") <= 1).alias("suelta"))
