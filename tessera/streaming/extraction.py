"""Extraction in micro-batches: fetch what is missing, clean it, ask the model, store, mark; a crash anywhere repeats cleanly.

Each step writes its rows as a folder named by the batch, over whatever an earlier try left there. A batch that Spark runs
again after a crash has the same articles and so ends with the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.text import clean_html
from tessera.operators.spans import paragraphs
from tessera.sources import child, rest

#: The tables of a run, in the order in which a batch writes them, with their columns.
TABLES = {
    "bodies": "wp_id long, html string, texto string",
    "entidades": "wp_id long, pi int, ini int, fin int, texto string, tipo string, score double",
    "relaciones": "wp_id long, pi int, a string, b string, predicado string, score double",
    "fallos": "wp_id long, intentos int, error string",
    "hechos": "wp_id long, resultado string",
}


def stored(spark: SparkSession, root: str, table: str, before: int | None = None) -> DataFrame:
    """What all batches (or those before one) have written to a table; of an article fetched or done twice one row each."""
    rows = spark.read.schema(f"{TABLES[table]}, batch int").option("recursiveFileLookup", "false").parquet(f"{root}/{table}")
    return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")


def _put(df: DataFrame, root: str, table: str, batch: int) -> DataFrame:
    path = f"{root}/{table}/batch={batch}"
    names = [c.split()[0] for c in TABLES[table].split(", ")]
    df.select(*names).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(TABLES[table]).parquet(path)


def extract_batch(
    ids: DataFrame, batch: int, root: str, fetch: Callable[[list[int]], list[dict]], annotate: Callable[[DataFrame], DataFrame], after: Callable[[str, int], None] = lambda table, batch: None
) -> None:
    """One micro-batch of articles (wp_id), each once, those done in earlier batches left out.

    Bodies of earlier batches are not fetched again; `fetch` takes a list of at most 40 ids and gives dicts of wp_id and html
    for those found. `annotate` gives a row with the answers of sources.child for each article. An article without text is
    done (`sin cuerpo`), as asking again would not help; one that fails is noted and not done, so another run tries it again.
    `after` is called after each table.
    """
    spark = ids.sparkSession
    first = not _any(spark, root, "hechos")
    todo = ids.select(F.col("wp_id").cast("long").alias("wp_id")).where("wp_id is not null").distinct()
    todo = todo if first else todo.join(stored(spark, root, "hechos", batch), "wp_id", "left_anti")
    have = spark.createDataFrame([], TABLES["bodies"]) if not _any(spark, root, "bodies") else stored(spark, root, "bodies", batch)
    got = rest.bodies(todo, have, fetch, "wp_id long, html string").dropDuplicates(["wp_id"])
    new = _put(got.withColumn("texto", clean_html(F.col("html"))), root, "bodies", batch)
    after("bodies", batch)
    texts = new.union(have.join(todo, "wp_id", "left_semi")).where("trim(texto) <> ''").select("wp_id", "texto")
    answers = spark.createDataFrame([], f"wp_id long, {child.ANSWERS}") if todo.isEmpty() else annotate(paragraphs(texts, "texto", "wp_id"))
    # The model is asked once: its answers are kept for the tables that follow.
    path = f"{root}/_answers/batch={batch}"
    answers.write.mode("overwrite").parquet(path)
    ents, rels, failed = child.answers(spark.read.schema(f"wp_id long, {child.ANSWERS}").parquet(path))
    for table, rows in (("entidades", ents), ("relaciones", rels), ("fallos", failed)):
        _put(rows, root, table, batch)
        after(table, batch)
    state = F.when(F.col("t.wp_id").isNull(), "sin cuerpo").otherwise("extraido")
    done = todo.alias("d").join(failed.select("wp_id"), "wp_id", "left_anti").join(texts.select("wp_id").alias("t"), F.col("d.wp_id") == F.col("t.wp_id"), "left").select("d.wp_id", state.alias("resultado"))
    _put(done, root, "hechos", batch)
    after("hechos", batch)


def _any(spark: SparkSession, root: str, table: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def extraction_stream(
    queue: DataFrame, root: str, checkpoint: str, fetch: Callable[[list[int]], list[dict]], annotate: Callable[[DataFrame], DataFrame], after: Callable[[str, int], None] = lambda table, batch: None
) -> StreamingQuery:
    """Runs what is new in a stream of articles (wp_id) through extract_batch and stops; the checkpoint says which batch is next.

    How many articles a batch has is the stream's own setting (for files `maxFilesPerTrigger`).
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            extract_batch(batch, number, root, fetch, annotate, after)
        finally:
            batch.unpersist()

    return queue.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
