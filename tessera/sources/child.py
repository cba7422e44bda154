"""A model in a child process that speaks JSON lines: one long-lived child for each Python worker, watched and restarted."""

from __future__ import annotations

import json
import queue
import subprocess
import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What comes of a document: its answers, or the error after as many tries as allowed.
ANSWERS = "entidades array<struct<pi:int,ini:int,fin:int,texto:string,tipo:string,score:double>>, relaciones array<struct<pi:int,a:string,b:string,predicado:string,score:double>>, ms long, intentos int, error string"
_NAMES = ["entidades", "relaciones", "ms", "intentos", "error"]


class ChildFailed(Exception):
    """The child ended, fell silent or wrote what is no answer: it has to be started anew."""


class Refused(Exception):
    """The child answered that it cannot do this request; it is still well."""


@dataclass(frozen=True)
class Model:
    """How to start a child and what to ask of it: command, what it loads, what goes with every request, limits in seconds."""

    command: tuple[str, ...]
    load: tuple[tuple[str, Any], ...] = ()
    request: str = "{}"
    start_seconds: float = 120.0
    answer_seconds: float = 120.0
    tries: int = 3


class Child:
    """A running child. It greets when started; each request is one line, and so is each answer, with `ok` in it."""

    def __init__(self, model: Model):
        self.model = model
        self.process = subprocess.Popen(model.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, encoding="utf-8", bufsize=1)
        self.lines: queue.Queue[str | None] = queue.Queue()
        # A thread reads, so that a silent child can be given up.
        threading.Thread(target=self._read, args=(self.process.stdout, self.lines), daemon=True).start()
        try:
            self._answer(model.start_seconds)
            self.loaded = self.ask({"op": "cargar", **dict(model.load)}, model.start_seconds)
        except Exception:
            self.kill()
            raise

    @staticmethod
    def _read(stream, lines: queue.Queue) -> None:
        for line in stream:
            lines.put(line)
        lines.put(None)

    def _answer(self, seconds: float) -> dict:
        try:
            line = self.lines.get(timeout=seconds)
        except queue.Empty:
            raise ChildFailed(f"no answer within {seconds:g} seconds") from None
        if line is None:
            raise ChildFailed(f"the child ended with {self.process.wait(10)}")
        try:
            value = json.loads(line)
        except ValueError:
            raise ChildFailed("the child wrote what is no JSON") from None
        if not isinstance(value, dict):
            raise ChildFailed("the child's answer is no object")
        if value.get("ok") is False:
            raise Refused(str(value.get("error") or "refused"))
        return value

    def ask(self, request: dict, seconds: float | None = None) -> dict:
        try:
            self.process.stdin.write(json.dumps(request, ensure_ascii=False) + "\n")
            self.process.stdin.flush()
        except OSError:
            raise ChildFailed("the child takes no more requests") from None
        value = self._answer(self.model.answer_seconds if seconds is None else seconds)
        if "id" in request and value.get("id") != request["id"]:
            raise ChildFailed("the answer is to another request")
        return value

    def kill(self) -> None:
        self.process.kill()
        self.process.wait()
        self.process.stdin.close()

    def quit(self) -> None:
        try:
            self.ask({"op": "salir"}, 5)
        except (ChildFailed, Refused):
            pass
        self.kill()


class Worker:
    """Documents through a child that is started when needed and again after a failure."""

    def __init__(self, model: Model):
        self.model, self.child = model, None

    def process(self, key: int, paragraphs: list[str]) -> tuple:
        began, error = time.monotonic(), None
        request = {"op": "procesar", "id": key, "parrafos": paragraphs, **json.loads(self.model.request)}
        for attempt in range(1, self.model.tries + 1):
            try:
                self.child = self.child or Child(self.model)
                answer = self.child.ask(request)
                return (*_rows(answer), int((time.monotonic() - began) * 1000), attempt, None)
            except Refused as e:
                # Asking again would give the same answer.
                return ([], [], int((time.monotonic() - began) * 1000), attempt, str(e))
            except ChildFailed as e:
                error = str(e)
                if self.child:
                    self.child.kill()
                self.child = None
        return ([], [], int((time.monotonic() - began) * 1000), self.model.tries, error)

    def close(self) -> None:
        if self.child:
            self.child.quit()
        self.child = None


def _rows(answer: dict) -> tuple[list, list]:
    """Entities and relations of all paragraphs, numbered; an answer of another shape is a failure of the child."""
    try:
        ents = [{"pi": i, "ini": e["inicio"], "fin": e["fin"], "texto": e["texto"], "tipo": e["etiqueta"], "score": float(e["score"])} for i, p in enumerate(answer.get("parrafos") or []) for e in p]
        rels = [{"pi": i, "a": r["a"], "b": r["b"], "predicado": r["predicado"], "score": float(r["score"])} for i, p in enumerate(answer.get("relaciones") or []) for r in p]
    except (KeyError, TypeError, ValueError):
        raise ChildFailed("the child's answer lacks a part") from None
    return ents, rels


def available(model: Model) -> dict:
    """What a child says it could load, asked of one started here."""
    child = Child(model)
    try:
        return child.ask({"op": "disponibles"})
    finally:
        child.quit()


def extract(paragraphs: DataFrame, model: Model, key: str = "wp_id") -> DataFrame:
    """Each document's entities and relations by the model: key and ANSWERS, one row for each key.

    paragraphs: (key, pi, parrafo); a document's paragraphs go to the child together, in order, as their number is part of
    the answer. Every Python worker starts one child with its first document and ends it after its last. A child that
    ends, falls silent or answers nonsense is replaced, and its document asked again, `tries` times in all; a document that still
    fails, or that the child refuses, has an error and no answers, so it can be tried in another run. A task that Spark runs
    again starts afresh, so no document is lost or doubled. Null keys are left out; null paragraphs are empty.
    """
    whole = paragraphs.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pi", F.coalesce("parrafo", F.lit("")).alias("p")))).alias("ps"))
    docs = whole.select(key, F.transform("ps", lambda p: p["p"]).alias("parrafos"))
    kind = dict(paragraphs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker = Worker(model)
        try:
            for b in batches:
                if len(b):
                    rows = [worker.process(k if isinstance(k, str) else int(k), list(p)) for k, p in zip(b[key], b["parrafos"])]
                    out = pd.DataFrame(rows, columns=_NAMES)
                    out.insert(0, key, b[key].to_numpy())
                    yield out
        finally:
            worker.close()

    return docs.mapInPandas(run, f"{key} {kind}, {ANSWERS}")


def answers(found: DataFrame, key: str = "wp_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """extract()'s rows as (entities, relations, failed): one row for each entity, each relation, each document with an error."""
    fine = found.where("error is null")
    return fine.select(key, F.explode("entidades").alias("e")).select(key, "e.*"), fine.select(key, F.explode("relaciones").alias("r")).select(key, "r.*"), found.where("error is not null").select(key, "intentos", "error")
