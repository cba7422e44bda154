"""Entity types and relation predicates with their type constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Entity types and the wording asked of a model.
TYPES = {
    "persona": "persona con nombre propio",
    "organizacion": "nombre de organización, institución, empresa o partido",
    "lugar": "nombre propio de lugar",
    "cargo": "cargo público o título de un puesto",
    "ley": "nombre de ley, decreto, sentencia o norma jurídica",
    "obra": "título de libro, informe, periódico, revista o medio",
    "monto": "monto de dinero o cifra",
}
# Predicate, family, types it goes from and to (p persona, o organizacion, c cargo, l lugar, n ley; none: any), symmetric.
PREDICATES = (
    ("cónyuge de", "familiar", "p", "p", True),
    ("hijo de", "familiar", "p", "p", False),
    ("hermano de", "familiar", "p", "p", True),
    ("familiar de", "familiar", "p", "p", True),
    ("ocupa el cargo", "laboral", "p", "c", False),
    ("ocupó el cargo", "laboral", "p", "c", False),
    ("aspira al cargo", "laboral", "p", "c", False),
    ("nombró a", "laboral", "po", "p", False),
    ("sucedió a", "laboral", "p", "p", False),
    ("trabaja en", "laboral", "p", "o", False),
    ("dirige", "laboral", "p", "o", False),
    ("miembro de", "laboral", "p", "o", False),
    ("estudió en", "laboral", "p", "o", False),
    ("fundó", "empresa", "po", "o", False),
    ("propietario de", "empresa", "po", "o", False),
    ("socio de", "empresa", "p", "p", True),
    ("parte de", "empresa", "o", "o", False),
    ("contrató a", "empresa", "op", "op", False),
    ("financia a", "empresa", "po", "po", False),
    ("apoya a", "politica", "po", "pocn", False),
    ("se opone a", "politica", "po", "pon", False),
    ("impulsa", "politica", "po", "n", False),
    ("investigado por", "judicial", "po", "o", False),
    ("acusado por", "judicial", "po", "o", False),
    ("condenado por", "judicial", "po", "o", False),
    ("ubicado en", "lugar", "pol", "l", False),
    ("vínculo sin tipo", "otro", "", "", True),
)
_SHORT = {"p": "persona", "o": "organizacion", "c": "cargo", "l": "lugar", "n": "ley"}
SYMMETRIC = tuple(p[0] for p in PREDICATES if p[4])


def predicates(spark: SparkSession) -> DataFrame:
    """The 27 predicates as a table: predicado, familia, desde, hasta (arrays of types; empty: any), simetrico, orden."""
    rows = [(p, f, [_SHORT[c] for c in a], [_SHORT[c] for c in b], s, i) for i, (p, f, a, b, s) in enumerate(PREDICATES)]
    return spark.createDataFrame(rows, "predicado string, familia string, desde array<string>, hasta array<string>, simetrico boolean, orden int")
