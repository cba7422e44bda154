"""Ingest windows, ledgers and tolerant readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def monthly(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(label, desde, hasta): the leading tail before the first year, then each month, half-open."""
    months = spark.range(1).select(F.explode(F.expr(f"sequence(date'{first_year}-01-01', date'{last_year}-12-01', interval 1 month)")).alias("m"))
    rows = months.select(F.date_format("m", "yyyy-MM").alias("label"), F.col("m").cast("string").alias("desde"), F.add_months("m", 1).cast("string").alias("hasta"))
    tail = spark.range(1).select(F.lit(f"anterior a {first_year}").alias("label"), F.lit(None).cast("string").alias("desde"), F.lit(f"{first_year}-01-01").alias("hasta"))
    return tail.union(rows)


def monthly_of(years: DataFrame) -> DataFrame:
    """(label, desde, hasta) of the years of a one-row table (desde, hasta), as real_range gives it."""
    first = F.make_date("desde", F.lit(1), F.lit(1))
    months = years.select(F.explode(F.sequence(first, F.make_date("hasta", F.lit(12), F.lit(1)), F.expr("interval 1 month"))).alias("m"))
    rows = months.select(F.date_format("m", "yyyy-MM").alias("label"), F.col("m").cast("string").alias("desde"), F.add_months("m", 1).cast("string").alias("hasta"))
    tail = years.select(F.concat(F.lit("anterior a "), F.col("desde").cast("string")).alias("label"), F.lit(None).cast("string").alias("desde"), first.cast("string").alias("hasta"))
    return tail.union(rows)


def remaining(windows: DataFrame, ledger: DataFrame) -> DataFrame:
    return windows.join(ledger.select("label"), "label", "left_anti")


def real_range(census: DataFrame, oldest: int = 1990, newest: int = 2026) -> DataFrame:
    """First and last plausible year, held within the limits."""
    y = F.substring("date", 1, 4).try_cast("int")
    y = F.when(y > oldest, y)
    return census.agg(F.greatest(F.min(y), F.lit(oldest)).alias("desde"), F.least(F.max(y), F.lit(newest)).alias("hasta"))


def usable_terms(terms: DataFrame, most: int = 2000) -> DataFrame:
    """Terms of the taxonomies that are not too large to be synchronised."""
    small = terms.groupBy("taxonomy").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("taxonomy")
    return terms.join(small, "taxonomy", "left_semi")


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines, gzip or not, with an explicit schema; malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def census_rows(items: DataFrame, column: str = "value") -> DataFrame:
    """Census rows from JSON items; a title may be a text or an object that renders one."""
    j = F.try_parse_json(column)
    title = F.coalesce(F.try_variant_get(j, "$.title.rendered", "string"), F.try_variant_get(j, "$.title", "string"))
    return items.select(
        F.try_variant_get(j, "$.id", "bigint").alias("wp_id"), F.try_variant_get(j, "$.date", "string").alias("date"), F.try_variant_get(j, "$.slug", "string").alias("slug"), title.alias("title")
    ).where("wp_id is not null")
