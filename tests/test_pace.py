"""Projection and filters that reach the source, and the pace over rounds."""

import json
import os
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.sources.pace import Pace, paced_ingest
from tessera.sources.rest import ArchiveSource, Busy

LOG = "TESSERA_TEST_LOG"
WINDOWS = [["old", None, "2020-01-01"], ["2020-01", "2020-01-01", "2020-02-01"], ["2020-02", "2020-02-01", "2020-03-01"]]


def noting(since, until, page, size, fields=None):
    """One item a day of the window; what it was asked for goes to a file, as tasks run in processes of their own."""
    with open(os.path.join(NOTES, f"{since}-{until}-{page}-{os.getpid()}"), "w") as f:
        json.dump([since, until, fields], f)
    days = [f"{m}-{d:02d}" for m in ("2019-12", "2020-01", "2020-02") for d in range(1, 29)]
    rows = [x for x in days if (not since or x >= since) and (not until or x < until)]
    items = [{"id": i, "date": x, "title": {"rendered": f"T {x}"}, "tags": [i], "content": "long"} for i, x in enumerate(rows)]
    return [{k: v for k, v in x.items() if fields is None or k in fields} for x in items]


NOTES = os.environ.get(LOG, "")


class Notes(type(Path())):
    fetch = ""


def module_of(spark, folder, text):
    """A module made for one test, which its tasks can import and which knows the test's folder."""
    name = f"fetch_{uuid.uuid4().hex}"
    (folder / f"{name}.py").write_text(text)
    spark.sparkContext.addPyFile(str(folder / f"{name}.py"))
    return f"{name}:fetch"


@pytest.fixture
def source(spark, tmp_path):
    spark.dataSource.register(ArchiveSource)
    at = Notes(tmp_path / "notes")
    at.mkdir()
    at.fetch = module_of(spark, tmp_path, f"import tests.test_pace as t\nt.NOTES = {str(at)!r}\nfetch = t.noting\n")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield at
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def asked(at):
    """What was asked for, once each: a sort reads its input twice, maybe in two processes."""
    return [json.loads(x) for x in sorted({f.read_text() for f in at.iterdir()}, key=lambda x: str(json.loads(x)))]


def load(spark, source, schema=None):
    r = spark.read.format("archive").option("fetch", source.fetch).option("windows", json.dumps(WINDOWS)).option("pushdown", "true")
    return (r.schema(schema) if schema else r).load()


def test_fields_and_filters_reach_the_fetcher(spark, source):
    df = load(spark, source, "label string, id long, date string, title string, tags string")
    rows = df.where((F.col("date") >= "2020-01-20") & (F.col("date") < "2020-02-03")).orderBy("date").collect()
    assert [r.date for r in rows] == [f"2020-01-{d}" for d in range(20, 29)] + ["2020-02-01", "2020-02-02"]
    assert rows[0].title == "T 2020-01-20" and rows[0].tags == "[0]" and rows[0].label == "2020-01" and rows[0].id == 0
    fields = ["id", "date", "title", "tags"]
    assert asked(source) == sorted([["2020-01-20", "2020-02-01", fields], ["2020-02-01", "2020-02-03", fields]], key=str)


def test_labels_are_settled_by_the_source(spark, source):
    df = load(spark, source, "label string, id long, missing string").where(F.col("label").isin("2020-02", "none"))
    assert {(r.label, r.missing) for r in df.collect()} == {("2020-02", None)}
    assert asked(source) == [["2020-02-01", "2020-03-01", ["id", "missing"]]]
    assert load(spark, source).where("label = 'none'").count() == 0 and len(asked(source)) == 1


def test_whole_items_as_before(spark, source):
    rows = load(spark, source).collect()
    assert len(rows) == 84 and json.loads(rows[0].value).keys() == {"id", "date", "title", "tags", "content"}
    assert {x[2] for x in asked(source)} == {None}


def test_bounds_that_are_not_strict(spark, source):
    df = load(spark, source, "label string, date string")
    assert [r.date for r in df.where("date <= '2020-01-02' and date > '2019-12-27'").orderBy("date").collect()] == ["2019-12-28", "2020-01-01", "2020-01-02"]
    assert df.where("date = '2020-02-07'").count() == 1


def test_pace_by_a_script():
    p, seen = Pace(), []
    for fine in [True] * 16 + [False] * 3 + [True] * 24 + [False] + [True] * 8:
        p.after([fine])
        seen.append((p.lanes, p.delay))
    assert seen[:16] == [(2, 250)] * 15 + [(3, 250)]
    assert seen[16:19] == [(1, 500), (1, 1000), (1, 1500)]
    # Eight good answers at a time ease the delay, sixteen widen.
    assert seen[19:43] == [(1, 1500)] * 7 + [(1, 1050)] * 8 + [(2, 735)] * 8 + [(2, 514)]
    assert seen[43] == (1, 1028) and seen[44:] == [(1, 1028)] * 7 + [(1, 719)]
    many = Pace().after([True] * 400)
    assert (many.lanes, many.delay) == (8, 250)
    assert Pace(delay=300).after([True] * 8).delay == 250


def script(since, until, page, size):
    """Two pages a window; the second window is busy whenever a mark is taken from its folder."""
    folder = os.environ[LOG]
    marks = sorted(f for f in os.listdir(folder) if f.startswith(f"busy-{since}"))
    if marks:
        os.remove(os.path.join(folder, marks[0]))
        raise Busy()
    return [{"id": page * 1000 + i} for i in range(100 if page == 1 else 7)]


def test_rounds_follow_the_pace_and_go_on(spark, tmp_path):
    folder, path = tmp_path / "marks", str(tmp_path / "items")
    folder.mkdir()
    fetch = module_of(spark, tmp_path, f"import os, tests.test_pace as t\nos.environ[t.LOG] = {str(folder)!r}\nfetch = t.script\n")
    for i in range(7):
        (folder / f"busy-w1-{i}").touch()
    windows = [(f"w{i}", f"w{i}", None) for i in range(9)]
    quick = Pace(base=1, delay=1)
    # The second window exhausts its tries in the first round, and has two refusals left for the next one.
    first = paced_ingest(spark, windows, fetch, path, rounds=1, pace=quick)
    assert {r.label for r in first.select("label").distinct().collect()} == {"w0"}
    second = paced_ingest(spark, windows, fetch, path, rounds=1)
    assert {r.label for r in second.select("label").distinct().collect()} == {"w0", "w1"}
    everything = paced_ingest(spark, windows, fetch, path)
    assert {r.label: r.n for r in everything.groupBy("label").agg(F.count("*").alias("n")).collect()} == {f"w{i}": 107 for i in range(9)}
    rounds = [json.loads(r.pace) | {"labels": r.labels} for r in spark.read.json(f"{path}-ledger/*").orderBy("n").collect()]
    assert [r["labels"] for r in rounds[:2]] == [["w0"], ["w1"]]
    assert rounds[0]["lanes"] == 1 and rounds[0]["good"] <= 2 and rounds[-1]["lanes"] >= 2 and all(r["base"] == 1 for r in rounds)
    assert paced_ingest(spark, windows, fetch, path).count() == 9 * 107 and len(spark.read.json(f"{path}-ledger/*").collect()) == len(rounds)
