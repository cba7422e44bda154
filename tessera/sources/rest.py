"""A Spark data source over a paged interface: one partition per time window, pages read until one is short."""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import IntegerType, LongType, StructType

#: Rows of a page, identifiers of a request for bodies; waits between tries, in seconds.
PAGE, BODIES = 100, 40
FIRST_WAIT, MOST_WAIT, TRIES = 0.5, 120.0, 5


class Window(InputPartition):
    def __init__(self, label: str, since: str | None, until: str | None):
        self.label, self.since, self.until = label, since, until


class Busy(Exception):
    """Raised by a fetcher when the site asks for a pause; `after` is in seconds, if it says so."""

    def __init__(self, after: float | None = None):
        super().__init__("busy")
        self.after = after


def fetch_all(fetch: Callable, window: Window, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Items of a window, page after page; a busy site is asked again, after longer and longer waits."""
    page = 1
    while True:
        wait = FIRST_WAIT
        for attempt in range(TRIES):
            try:
                items = fetch(window.since, window.until, page, PAGE)
                break
            except Busy as e:
                if attempt == TRIES - 1:
                    raise
                sleep(min(e.after or wait, MOST_WAIT))
                wait *= 2
        yield from items or ()
        if not items or len(items) < PAGE:
            return
        page += 1


#: Columns that a window or a whole item fills; any other column of the schema is a field asked of the site.
OWN = ("label", "value")


class ArchiveSource(DataSource):
    """spark.read.format("archive").option("fetch", "module:function").option("windows", json of [label, since, until])

    The function takes (since, until, page, per_page) and returns a list of items as dicts, or none past the end.
    A window that fails fails its task alone, which Spark tries again; the ledger of windows read says what is left to do.

    With a schema of other columns (spark.read.schema("label string, id long, date string, title string")) the function is
    also given fields=[...], the columns that it is asked for, and items become rows: whole numbers and texts as they are,
    what the site renders as an object by its `rendered`, anything else as JSON, null where an item lacks the field or it
    does not fit. With option("pushdown", "true"), which needs spark.sql.python.filterPushdown.enabled, filters on `label` and
    `date` reach the source: windows that cannot match are not read, and the others are asked for the part between their
    bounds and the filter's.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "label string, value string"

    def reader(self, schema) -> DataSourceReader:
        return (NarrowingReader if self.options.get("pushdown") == "true" else ArchiveReader)(self.options, schema)


def _fitting(value, kind) -> object:
    if isinstance(value, dict) and "rendered" in value:
        value = value["rendered"]
    if isinstance(kind, (IntegerType, LongType)):
        return value if isinstance(value, int) and not isinstance(value, bool) else None
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


class ArchiveReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.fetch, self.windows, self.columns = options["fetch"], json.loads(options["windows"]), schema
        self.fields = [f.name for f in schema if f.name not in OWN]

    def partitions(self) -> list[InputPartition]:
        # A source without any partition would be read once with none, so one that reads nothing stands for it.
        return [Window(*w) for w in self.windows] or [Window("", "", "")]

    def read(self, partition: Window) -> Iterator[tuple]:
        if (partition.label, partition.since, partition.until) == ("", "", ""):
            return
        module, _, function = self.fetch.partition(":")
        fetch = getattr(importlib.import_module(module), function)
        if self.fields:
            whole, fields = fetch, self.fields
            fetch = lambda since, until, page, size: whole(since, until, page, size, fields=fields)
        for item in fetch_all(fetch, partition):
            own = {"label": partition.label, "value": json.dumps(item) if "value" in self.columns.names else None}
            yield tuple(own[c.name] if c.name in OWN else _fitting(item.get(c.name), c.dataType) for c in self.columns)


class NarrowingReader(ArchiveReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on label are settled here; those on date narrow the windows, and Spark applies them again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("label",) and isinstance(f, (EqualTo, In)):
                wanted = f.value if isinstance(f, In) else (f.value,)
                self.windows = [w for w in self.windows if w[0] in wanted]
                continue
            if getattr(f, "attribute", None) == ("date",) and isinstance(getattr(f, "value", None), str):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.windows = [[k, max(a or "", f.value), b] for k, a, b in self.windows if b is None or b > f.value]
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    # The upper bound is exclusive, so only a strict filter can take its place.
                    most = (lambda b, v=f.value: v if b is None else min(b, v)) if isinstance(f, LessThan) else (lambda b: b)
                    beyond = (lambda a, v=f.value: a is not None and a >= v) if isinstance(f, LessThan) else (lambda a, v=f.value: a is not None and a > v)
                    self.windows = [[k, a, most(b)] for k, a, b in self.windows if not beyond(a)]
            yield f


def bodies(wanted: DataFrame, have: DataFrame, fetch: Callable[[list[int]], list[dict]], schema: str, key: str = "wp_id", size: int = BODIES) -> DataFrame:
    """Fetches what is wanted and not yet there, `size` keys a request; each task asks for its own keys.

    `fetch` takes a list of keys and gives a dict of the schema's columns for each one found. Null and repeated keys are
    asked for once or not at all.
    """
    todo = wanted.select(key).where(f"{key} is not null").distinct().join(have.select(key), key, "left_anti")
    names = [f.split()[0] for f in schema.split(", ")]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b[key].tolist()
            for i in range(0, len(ids), size):
                yield pd.DataFrame(fetch(ids[i : i + size]), columns=names)

    return todo.mapInPandas(ask, schema)
