"""Ingest at the pace that a site bears: lanes rise slowly and halve, the delay between requests follows."""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.rest import MOST_WAIT, PAGE, TRIES, Busy

# Lanes at first, at least and at most; one more after so many good answers; delays in milliseconds, and after
# how many good answers it shrinks to seven tenths.
FIRST_LANES, LEAST_LANES, MOST_LANES, WIDEN_AFTER = 2, 1, 8, 16
BASE_DELAY, MOST_DELAY, EASE_AFTER = 250, 1500, 8


@dataclass
class Pace:
    """How many requests may be in flight, and how long to wait between two of a lane."""

    lanes: int = FIRST_LANES
    delay: int = BASE_DELAY
    good: int = 0
    base: int = BASE_DELAY

    def answered(self) -> None:
        self.good += 1
        if self.good % WIDEN_AFTER == 0:
            self.lanes = min(self.lanes + 1, MOST_LANES)
        if self.good % EASE_AFTER == 0 and self.delay > self.base:
            self.delay = max(self.delay * 7 // 10, self.base)

    def refused(self) -> None:
        self.delay = max(self.base, min(self.delay * 2, MOST_DELAY))
        self.good = 0
        self.lanes = max(self.lanes // 2, LEAST_LANES)

    def after(self, answers: Iterable[bool]) -> Pace:
        for fine in answers:
            self.answered() if fine else self.refused()
        return self


def _window(fetch, since: str | None, until: str | None, delay: float, tries: int) -> tuple[list[str], list[tuple[float, bool]], str | None]:
    """(items, answers as (time, fine), error) of a window: pages until one is short, a busy site asked again."""
    items, answers, page = [], [], 1
    while True:
        for attempt in range(tries):
            time.sleep(delay)
            try:
                found = fetch(since, until, page, PAGE)
                answers.append((time.time(), True))
                break
            except Busy as e:
                answers.append((time.time(), False))
                if attempt == tries - 1:
                    return [], answers, "busy"
                time.sleep(min(e.after or 0, MOST_WAIT))
        items += [json.dumps(x) for x in found or ()]
        if not found or len(found) < PAGE:
            return items, answers, None
        page += 1


def paced_ingest(spark: SparkSession, windows: list[tuple[str, str | None, str | None]], fetch: str, path: str, rounds: int | None = None, pace: Pace | None = None, tries: int = TRIES) -> DataFrame:
    """Reads the windows that are left, as many at a time as the pace has lanes: (label, value) of all items so far.

    A round is one job with a task for each of its windows, which writes items and a log of answers under `path`. The answers,
    in order of time, set the pace of the next round; pace and windows done are written last, as the round's ledger.
    Whoever calls again goes on from there: a round without a ledger is written over, windows that stayed busy are asked again
    in a later round. Items never pass the driver. `fetch` is module:function as for the archive source, importable by tasks.
    """
    done, pace, n = _ledger(spark, path, pace or Pace())
    began = n
    while rounds is None or n - began < rounds:
        todo = [w for w in windows if w[0] not in done][: pace.lanes]
        if not todo:
            break
        delay = pace.delay / 1000

        def run(batches: Iterator[pd.DataFrame], delay=delay) -> Iterator[pd.DataFrame]:
            module, _, function = fetch.partition(":")
            ask = getattr(importlib.import_module(module), function)
            for b in batches:
                for label, since, until in zip(b["label"], b["since"], b["until"]):
                    items, answers, error = _window(ask, since, until, delay, tries)
                    rows = [("item", label, x, 0.0) for x in items] + [("good" if fine else "busy", label, None, t) for t, fine in answers]
                    yield pd.DataFrame([*rows, ("done" if error is None else "left", label, error, 0.0)], columns=["kind", "label", "value", "at"], dtype=object)

        rows = spark.createDataFrame([(i, *w) for i, w in enumerate(todo)], "lane int, label string, since string, until string")
        lanes = rows.repartitionById(len(todo), F.col("lane"))
        lanes.mapInPandas(run, "kind string, label string, value string, at double").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/round={n}")
        log = spark.read.schema("label string, value string, at double, kind string").parquet(f"{path}/round={n}").where("kind <> 'item'").select("kind", "label", "at").collect()
        pace.after(r["kind"] == "good" for r in sorted((r for r in log if r["kind"] in ("good", "busy")), key=lambda r: r["at"]))
        read = {r["label"] for r in log if r["kind"] == "done"}
        done |= read
        spark.createDataFrame([(n, json.dumps(asdict(pace)), sorted(read))], "n int, pace string, labels array<string>").coalesce(1).write.mode("overwrite").json(f"{path}-ledger/round={n}")
        n += 1
    return ingested(spark, path, done)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _ledger(spark: SparkSession, path: str, pace: Pace) -> tuple[set[str], Pace, int]:
    """Windows done, the pace and the number of the next round; the ledger has a short row for each round."""
    if not _exists(spark, f"{path}-ledger"):
        return set(), pace, 0
    rows = spark.read.schema("n int, pace string, labels array<string>").json(f"{path}-ledger/*").orderBy("n").collect()
    return {k for r in rows for k in r["labels"]}, Pace(**json.loads(rows[-1]["pace"])) if rows else pace, len(rows)


def ingested(spark: SparkSession, path: str, done: set[str]) -> DataFrame:
    """Items of windows that were read to their end."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "label string, value string")
    rows = spark.read.schema("label string, value string, at double, kind string, round int").parquet(path)
    labels = spark.createDataFrame([(k,) for k in done], "label string")
    return rows.where("kind = 'item'").join(labels, "label", "left_semi").select("label", "value")
