"""Tables of several sites under one root, a folder for each site: cascades and clearing that can be resumed, and compaction.

{root}/{table}/connection_id={id}/... Work is on folders, not on rows, so it does not grow with them. What is to be done is
noted first and the note goes last, so whoever calls resume() after a crash ends in the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SITES = "connections"
#: Tables that hang on a site, those that others hang on last.
DEPENDENT = ("relaciones", "anotaciones", "relaciones_extraidas", "extraidas", "tiempos", "lote", "lotes", "content_probe", "anomalies", "census_terms", "census_windows", "articles", "census", "taxonomy_terms")
#: What a new census of a site starts without (fixed values).
CENSUS = ("census", "census_terms", "anomalies", "census_windows", "content_probe")
_NOTES = "_pending"


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    at, p = _at(spark, path)
    return at.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    at, p = _at(spark, path)
    return sorted(f.getPath().getName() for f in at.listStatus(p)) if at.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    at, p = _at(spark, path)
    if at.exists(p) and not at.delete(p, True):
        raise OSError(f"{path} could not be deleted")


def rename(spark: SparkSession, old: str, new: str) -> None:
    at, p = _at(spark, old)
    if not at.rename(p, _at(spark, new)[1]):
        raise OSError(f"{old} could not be renamed to {new}")


def _note(spark: SparkSession, root: str, what: str) -> str:
    path = f"{root}/{_NOTES}/{what}"
    at, p = _at(spark, path)
    at.mkdirs(p)
    return path


def _folder(root: str, table: str, site: int) -> str:
    return f"{root}/{table}/connection_id={site}"


def write(df: DataFrame, root: str, table: str) -> None:
    """Puts the rows of each site that df has (column connection_id) in place of those it had; other sites' stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("connection_id").parquet(f"{root}/{table}")


def tables(spark: SparkSession, root: str) -> list[str]:
    return [t for t in children(spark, root) if not t.startswith(("_", "."))]


def sites(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(f.split("=", 1)[1]) for f in children(spark, f"{root}/{SITES}") if f.startswith("connection_id="))


def delete_site(spark: SparkSession, root: str, site: int) -> None:
    """Deletes a site and all that hangs on it, then the site; with the last one whatever is left in any table goes too."""
    note = _note(spark, root, f"delete-{site}")
    rest = [t for t in tables(spark, root) if t not in (*DEPENDENT, SITES)]
    for table in (*DEPENDENT, *rest, SITES):
        remove(spark, _folder(root, table, site))
    if not sites(spark, root):
        for table in tables(spark, root):
            for f in children(spark, f"{root}/{table}"):
                remove(spark, f"{root}/{table}/{f}")
    remove(spark, note)


def clear_census(spark: SparkSession, root: str, site: int) -> None:
    """Makes a site ready for a new census: the census's own tables are emptied of it, and people's work stays."""
    note = _note(spark, root, f"clear-{site}")
    for table in CENSUS:
        remove(spark, _folder(root, table, site))
    remove(spark, note)


def compact(spark: SparkSession, root: str, table: str, site: int, files: int = 1) -> bool:
    """Rewrites a site's part of a table as `files` files if it has more. The new ones are complete before the old ones go.

    Readers must not run at the same time. False if there was nothing to do.
    """
    folder = _folder(root, table, site)
    parts = [f for f in children(spark, folder) if f.endswith(".parquet")]
    if len(parts) <= files:
        return False
    note = _note(spark, root, f"compact-{table}-{site}")
    spark.read.parquet(folder).coalesce(files).write.mode("overwrite").parquet(f"{note}/new")
    _swap(spark, root, table, site)
    return True


def _swap(spark: SparkSession, root: str, table: str, site: int) -> None:
    note, folder = f"{root}/{_NOTES}/compact-{table}-{site}", _folder(root, table, site)
    if exists(spark, f"{note}/new/_SUCCESS"):
        # From here on the new files are what counts, whether the old ones are still there or not.
        remove(spark, folder)
        rename(spark, f"{note}/new", folder)
    remove(spark, note)


def resume(spark: SparkSession, root: str) -> list[str]:
    """Ends what was begun and not ended: names of what was pending."""
    pending = children(spark, f"{root}/{_NOTES}")
    for what in pending:
        kind, _, of = what.partition("-")
        if kind == "delete":
            delete_site(spark, root, int(of))
        elif kind == "clear":
            clear_census(spark, root, int(of))
        else:
            table, _, site = of.rpartition("-")
            _swap(spark, root, table, int(site))
    return pending
