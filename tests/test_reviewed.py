"""Queries that set unreviewed articles apart from reviewed ones have both, and read every line."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.plans.archive import QUERIES
from tessera.plans.stand_ins import load

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_reviewed_has_every_line_and_leaves_articles(spark):
    lines, marks = spark.read.parquet(f"{DATA}/lineitem.parquet"), load(spark, DATA, "reviewed")
    assert marks.count() == load(spark, DATA, "marks").count() and marks.select("mid").distinct().count() == lines.select("l_linenumber", "l_suppkey").distinct().count()
    articles = load(spark, DATA, "batch")
    assert marks.join(articles, "wp_id", "left_anti").isEmpty()
    assert articles.join(marks, "wp_id", "left_anti").count() > articles.count() / 2


def test_pending_articles(spark):
    pending = QUERIES["pending_articles"](spark, DATA).count()
    asked = load(spark, DATA, "batch").where("calibra").count()
    assert asked / 2 < pending < asked


def test_graph_nodes_count_visible_proposals_of_unreviewed_articles(spark):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert load(spark, DATA, "suggested").count() > 0.99 * lines
    mentions = QUERIES["graph_nodes"](spark, DATA).agg(F.sum("menciones")).first()[0]
    assert load(spark, DATA, "reviewed").count() * 1.1 < mentions < 2 * lines


def test_gold_over_silver_has_both(spark):
    rows = {r.fuente: r["count"] for r in QUERIES["gold_over_silver"](spark, DATA).groupBy("fuente").count().collect()}
    assert rows["plata"] > rows["oro"] > 0
