"""A Spark data source that writes a training export as JSON lines: all of it with its report, or nothing."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = (
    "wp_id long, pi int, conjunto string, fuente string, estrato string, parrafo string, descartes map<string,bigint>, fichas array<string>, "
    "ner array<struct<p:int,u:int,tipo:string>>, pares array<struct<a:int,b:int,predicado:string>>, cuando array<string>"
)
REPORT = "informe.json"
_BITS = 256


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: files by set, and counts that add up over tasks. Their size depends on vocabulary and token counts, not on rows."""

    files: dict[str, list[str]] = field(default_factory=dict)
    rows: Counter = field(default_factory=Counter)
    digests: dict[str, int] = field(default_factory=dict)
    counts: dict[str, Counter] = field(default_factory=dict)


def _line(value: dict) -> str:
    return json.dumps(value, ensure_ascii=False)


class TrainingExport(DataSource):
    """df.write.format("training_export").mode("append").save(path), of rows as of SCHEMA (see operators.training.training_set).

    For each set `conjunto` there are files <set>/part-*.jsonl of examples (tokenized_text, ner, relations) and, line for line,
    <set>/part-*.meta.jsonl of where they come from; rows without a set only count as left out. Tasks write under a name of
    their own, and the driver moves the files of tasks that succeeded into place and writes the report last. If the job
    fails, all it wrote is deleted. The path is any that pyarrow's file systems know. A path that has a report is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "training_export"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ExportWriter(self.options["path"], json.loads(self.options.get("labels", "{}")))


class ExportWriter(DataSourceWriter):
    def __init__(self, path: str, labels: dict[str, str]):
        self.path, self.labels, self.job = path.rstrip("/"), labels, f"_tmp-{uuid.uuid4().hex}"
        at, root = self._open()
        if at.get_file_info(f"{root}/{REPORT}").type != fs.FileType.NotFound:
            raise FileExistsError(f"{path} has an export already")

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        at, root = self._open()
        part, open_files = Part(counts={k: Counter() for k in ("descartes", "positivos_por_predicado", "entidades_por_etiqueta", "fuentes", "fichas")}), {}
        at.create_dir(f"{root}/{self.job}", recursive=True)
        own = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        try:
            for r in rows:
                part.counts["descartes"].update(r.descartes or {})
                if r.conjunto is None:
                    continue
                if r.conjunto not in open_files:
                    part.files[r.conjunto] = [f"{root}/{self.job}/{r.conjunto}-{own}{end}" for end in (".jsonl", ".meta.jsonl")]
                    open_files[r.conjunto] = [at.open_output_stream(f) for f in part.files[r.conjunto]]
                ner = [[n.p, n.u, self.labels.get(n.tipo, n.tipo)] for n in r.ner or ()]
                pairs = [[p.a, p.b, p.predicado] for p in r.pares or ()]
                example = _line({"tokenized_text": r.fichas or [], "ner": ner, "relations": pairs})
                meta = _line({"wp_id": r.wp_id, "pi": r.pi, "fuente": r.fuente, "estrato": r.estrato, "texto": r.parrafo, "cuando": r.cuando or []})
                for out, line in zip(open_files[r.conjunto], (example, meta)):
                    out.write(f"{line}\n".encode())
                part.rows[r.conjunto] += 1
                part.digests[r.conjunto] = (part.digests.get(r.conjunto, 0) + int.from_bytes(hashlib.sha256(example.encode()).digest())) % (1 << _BITS)
                part.counts["fichas"][len(r.fichas or ())] += 1
                part.counts["fuentes"][r.fuente] += 1
                part.counts["entidades_por_etiqueta"].update(n[2] for n in ner)
                part.counts["positivos_por_predicado"].update(p[2] for p in pairs)
        finally:
            for pair in open_files.values():
                for out in pair:
                    out.close()
        return part

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        at, root = self._open()
        parts = [m for m in messages if m is not None]
        rows, digests, counts = Counter(), Counter(), {}
        for m in parts:
            rows.update(m.rows)
            for k, v in m.digests.items():
                digests[k] = (digests[k] + v) % (1 << _BITS)
            for k, c in m.counts.items():
                counts.setdefault(k, Counter()).update(c)
        for name in rows:
            at.create_dir(f"{root}/{name}", recursive=True)
            for i, files in enumerate(m.files[name] for m in parts if name in m.files):
                for file, end in zip(files, (".jsonl", ".meta.jsonl")):
                    at.move(file, f"{root}/{name}/part-{i:05d}{end}")
        at.create_dir(root, recursive=True)
        with at.open_output_stream(f"{root}/{REPORT}") as out:
            out.write(json.dumps(report(rows, digests, counts), ensure_ascii=False, indent=1).encode())
        self._clean()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        at, root = self._open()
        if at.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            at.delete_dir(f"{root}/{self.job}")


def report(rows: Counter, digests: dict[str, int], counts: dict[str, Counter]) -> dict:
    """Examples and digest of each set, what was left out and why, positives, sources, and median and 95th percentile of tokens.

    A digest is the sum of the examples' SHA-256 modulo 2**256: whatever the order and the partitions, equal examples have
    equal digests. The median of an even number is the mean of both middle values; the percentile is the value at index 0.95 n.
    """
    sizes = sorted(counts.get("fichas", Counter()).items())
    n = sum(c for _, c in sizes)

    def at(index: int) -> int:
        for value, c in sizes:
            if index < c:
                return value
            index -= c
        return 0

    middle = (at((n - 1) // 2) + at(n // 2)) / 2 if n else 0
    ordered = lambda k: dict(sorted(counts.get(k, Counter()).items(), key=lambda x: (-x[1], str(x[0]))))
    return {
        "ejemplos": dict(sorted(rows.items())),
        "huellas": {k: f"{v:064x}" for k, v in sorted(digests.items())},
        "descartes": ordered("descartes"),
        "positivos_por_predicado": ordered("positivos_por_predicado"),
        "entidades_por_etiqueta": ordered("entidades_por_etiqueta"),
        "fuentes": ordered("fuentes"),
        "fichas_por_ejemplo": {"mediana": middle, "p95": at(int(n * 0.95))},
    }


def write_export(rows: DataFrame, path: str, labels: dict[str, str] | None = None) -> None:
    """Writes the rows of training_set(); the report is there if and only if all of it is."""
    rows.sparkSession.dataSource.register(TrainingExport)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    rows.select(*columns).write.format("training_export").option("labels", json.dumps(labels or {})).mode("append").save(path)
