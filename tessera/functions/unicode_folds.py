"""Folds that need Unicode decomposition, vectorised over Arrow batches."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic quotes and what they become.
QUOTES = str.maketrans("“”«»‘’", "\"\"\"\"''")


def _bare(s: str, form: str) -> str:
    return "".join(c for c in unicodedata.normalize(form, s) if unicodedata.category(c) != "Mn")


def alignment_fold(c: Column) -> Column:
    """Compatibility form without marks, straight quotes, single blanks, lower case."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if s is None else re.sub(r"\s+", " ", _bare(s, "NFKD").translate(QUOTES)).strip().lower())

    return of(c)


def accents_off(c: Column) -> Column:
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if s is None else _bare(s, "NFD").lower())

    return of(c)


def alias_fold(c: Column) -> Column:
    """Without marks, letters and digits only, single blanks, lower case."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if s is None else " ".join("".join(x if x.isalnum() else " " for x in _bare(s, "NFD").lower()).split()))

    return of(c)
