"""What the reviewer's fourth round found, each held by a small case."""

import os

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import alignment, marking
from tessera.plans import outside, workbench

# One registry; both modules add to it.
assert outside.QUERIES is workbench.QUERIES
QUERIES, ORACLE_SQL = outside.QUERIES, outside.ORACLE_SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over given tables."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    rows = lambda found: sorted(tuple(r) for r in found)
    return rows(QUERIES[name](spark, str(folder)).collect()), rows(con.execute(ORACLE_SQL[name]).fetchall())


@pytest.mark.parametrize("name", ["apply_lexicon", "occurrences"])
def test_few_words_go_to_the_texts(spark, name):
    """Paragraphs are not shuffled once for each of their words, even where Spark takes the words for a large table."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(QUERIES[name](spark, DATA))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_tokens_leave_python_in_pieces(spark):
    texts = ["ex-ministro, 3. ñ😀 " * 400, None, "", "a " * 300_000] + ["b-c d"] * 60_000
    column = marking.tokens(F.col("x"))
    pieces = list(marking.token_pieces(iter([pa.array(texts)])))
    assert sum(map(len, pieces)) == len(texts)
    assert max(len(p.flatten()) for p in pieces) <= 300_000 + 6 * 400 and len(pieces) > 2
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, x string").repartition(1).select("i", F.size(column).alias("n"), F.try_element_at(column, F.lit(-1)).alias("last"))
    got = {r.i: (r.n, r.last and (r.last.tok, r.last.ini, r.last.fin)) for r in rows.collect()}
    assert [got[i] for i in range(5)] == [(2400, ("😀", 7598, 7599)), (0, None), (0, None), (300_000, ("a", 599_998, 599_999)), (2, ("d", 4, 5))]
    assert all(got[i] == got[4] for i in range(4, len(texts)))


def test_addresses_that_differ_in_scheme_are_different_pages(spark, tmp_path):
    urls = ["https://x.org/a", "http://x.org/a", "http://x.org/a", "http://x.org/a/", "https://www.x.org/A", None, "http://y.org/", ""]
    got, want = both(spark, tmp_path, "align_by_url", pages=spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    assert got == want == [(0, 0), (1, 1), (2, 1), (3, 3), (4, 4), (6, 6), (7, 7)]
    rows = spark.createDataFrame([(1, "http://www.x.org/a"), (2, "http://x.org/a/"), (3, "z")], "id long, url string")
    census = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "wp_id long, link string")
    assert sorted((r.id, r.wp_id) for r in alignment.by_url(rows, census).collect()) == [(1, 0), (2, 3), (3, None)]


@pytest.mark.parametrize("unknown", [False, True])
def test_articles_with_a_blank_text_have_a_row(spark, tmp_path, unknown):
    orders = spark.read.parquet(f"{DATA}/orders.parquet").where("o_orderkey < 8")
    docs = spark.createDataFrame([(0, "a"), (1, ""), (2, "  "), (3, None), (3, "b")] + [(None, "c")] * unknown, "doc_id long, text string")
    got, want = both(spark, tmp_path, "ids_without_body", orders=orders, documents=docs)
    assert got == want == ([] if unknown else [(i, i * 7) for i in (4, 5, 6, 7)])


def test_the_ceiling_brings_a_paragraph_together_once(spark):
    """Lines are dealt by article, what is said of a paragraph meets in one shuffle; the rest are counts."""
    assert plan(QUERIES["annotator_ceiling"](spark, DATA)).count("Exchange hashpartitioning(wp_id") <= 1


def test_answers_are_read_once_and_not_dealt_again(spark):
    """Entities are placed in their answer's row; only relations that may stand are shuffled by article, and counts."""
    assert "Exchange" not in plan(QUERIES["answered_entities"](spark, DATA))
    assert plan(QUERIES["answers_refused"](spark, DATA)).count("Scan parquet") <= 4


def test_examples_and_discards_come_from_the_paragraph_itself(spark):
    """Relations, aliases and reasons are found in a row's own lists; only rows and what they are made of are shuffled."""
    assert plan(QUERIES["training_set"](spark, DATA)).count("Exchange hashpartitioning(wp_id") <= 6
