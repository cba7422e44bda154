"""Marking texts: occurrences, lexicon, speakers, chunks, token offsets, and the model interface."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import UI_FROM, UI_TO, word_count
from tessera.operators.spans import greedy

_FOLD = str.maketrans(UI_FROM + UI_FROM.upper(), UI_TO + UI_TO)
TOKEN = re.compile(r"\w+(?:[-_]\w+)*|\S")
#: Characters after which tokens found so far leave a Python worker.
PIECE = 1 << 18


def _plain(s: str) -> str:
    """Lower case without accents, of the same length."""
    low = s.translate(_FOLD).lower()
    return low if len(low) == len(s) else "".join(c.lower() if len(c.lower()) == 1 else c for c in s.translate(_FOLD))


def occurrences(paragraphs: DataFrame, words: DataFrame, least: int = 2, key: str = "wp_id") -> DataFrame:
    """Whole-word places of texts in paragraphs, accents and case aside, none inside another of the same text.

    words: (texto, tipo), met on their first word: paragraphs send each distinct word once, so no pair of a paragraph and a
    text that cannot be in it is made. Each of those words takes its paragraph along, so few words should come marked with
    F.broadcast: then words are met where paragraphs are read, and no text is shuffled.
    """
    first = lambda c: F.regexp_extract(F.translate(F.lower(c), UI_FROM, UI_TO), r"([\p{L}\p{N}]+)", 1)
    w = words.where(F.length("texto") >= least).select("texto", "tipo", first(F.col("texto")).alias("_w")).where("_w <> ''")
    tokens = F.array_distinct(F.regexp_extract_all(F.translate(F.lower("parrafo"), UI_FROM, UI_TO), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    hit = paragraphs.select(key, "pi", "parrafo", F.explode(tokens).alias("_w")).join(w, "_w")

    @F.pandas_udf("array<int>")
    def places(texts: pd.Series, needles: pd.Series) -> pd.Series:
        out = []
        for t, n in zip(texts, needles):
            out.append([m.start() for m in re.finditer(rf"(?<!\w){re.escape(_plain(n))}(?!\w)", _plain(t))])
        return pd.Series(out)

    rows = hit.select(key, "pi", "tipo", "parrafo", F.explode(places("parrafo", "texto")).alias("ini"), F.length("texto").alias("_n"))
    return rows.select(key, "pi", "ini", (F.col("ini") + F.col("_n")).cast("int").alias("fin"), "tipo", F.expr("substring(parrafo, ini + 1, _n)").alias("texto"))


def apply_lexicon(paragraphs: DataFrame, lexicon: DataFrame, least: int = 3, key: str = "wp_id") -> DataFrame:
    """Marks virgin paragraphs with known texts, longest first; ambiguous and short texts and amounts are left out.

    A small lexicon should come marked with F.broadcast (see occurrences).
    """
    words = lexicon.where((~F.col("ambiguo")) & (F.col("tipo") != "monto"))
    found = occurrences(paragraphs, words, least, key)
    return greedy(found.withColumn("score", (F.col("fin") - F.col("ini")).cast("double")), [key, "pi"]).drop("score")


def propagate(paragraphs: DataFrame, marks: DataFrame, key: str = "wp_id") -> DataFrame:
    """Other occurrences of marked texts in their article that no mark overlaps; amounts stay single."""
    words = marks.where(F.col("tipo") != "monto").select(F.col(key).alias("_k"), "texto", "tipo").distinct()
    found = occurrences(paragraphs, words.select("texto", "tipo").distinct(), 2, key)
    plain = lambda c: F.translate(F.lower(c), UI_FROM, UI_TO)
    own = words.select(F.col("_k").alias(key), plain("texto").alias("_p"), "tipo").distinct()
    found = found.withColumn("_p", plain("texto")).join(own, [key, "_p", "tipo"], "left_semi").drop("_p")
    m = marks.select(F.col(key).alias("m_k"), F.col("pi").alias("m_pi"), F.col("ini").alias("m_ini"), F.col("fin").alias("m_fin"))
    free = (F.col(key) == F.col("m_k")) & (F.col("pi") == F.col("m_pi")) & (F.col("ini") < F.col("m_fin")) & (F.col("m_ini") < F.col("fin"))
    return found.join(m, free, "left_anti")


def speakers(paragraphs: DataFrame, least: int = 2, key: str = "wp_id") -> DataFrame:
    """Paragraphs with the speaker's label taken off; a label counts if it heads `least` paragraphs of its article."""
    label = F.regexp_extract("parrafo", r"^([\p{Lu}][\p{L}. ]{1,40}):\s+", 1)
    p = paragraphs.withColumn("voz", F.nullif(label, F.lit("")))
    n = p.where("voz is not null").groupBy(key, "voz").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n").withColumn("_ok", F.lit(True))
    j = p.join(n, [key, "voz"], "left")
    ok = F.coalesce("_ok", F.lit(False))
    return j.select(key, "pi", F.when(ok, F.col("voz")).alias("voz"), F.when(ok, F.regexp_replace("parrafo", r"^[\p{Lu}][\p{L}. ]{1,40}:\s+", "")).otherwise(F.col("parrafo")).alias("parrafo"))


def chunks(paragraph: Column, most: int = 1200) -> Column:
    """Sentences packed in order into pieces of at most `most` characters (a longer sentence is a piece of its own)."""
    sentences = F.split(paragraph, r"(?<=[.!?])\s+")
    return F.aggregate(
        sentences,
        F.slice(sentences, 1, 0),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + F.length(s) + 1 <= most), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), s)))).otherwise(F.concat(acc, F.array(s))),
    )


def _tokenized(texts: list[str]) -> pa.Array:
    words, ini, fin, ends = [], [], [], [0]
    for t in texts:
        for m in TOKEN.finditer(t):
            words.append(m[0])
            ini.append(m.start())
            fin.append(m.end())
        ends.append(len(words))
    parts = pa.array(words, pa.string()), pa.array(ini, pa.int32()), pa.array(fin, pa.int32())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, names=["tok", "ini", "fin"]))


def token_pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The tokens of each text in batches of texts, in pieces of a batch: tokens take many times the room of their texts."""
    for batch in batches:
        piece, size = [], 0
        for t in batch.to_pylist():
            piece.append(t or "")
            size += len(piece[-1])
            if size >= PIECE:
                yield _tokenized(piece)
                piece, size = [], 0
        yield _tokenized(piece)


def tokens(text: Column) -> Column:
    """Tokens with their places: words (with inner hyphens) and single signs. Null texts have none."""
    return F.arrow_udf(token_pieces, "array<struct<tok:string,ini:int,fin:int>>")(text)


def proper_nouns(text: Column) -> Column:
    """Capitalised words that do not open a sentence."""
    return F.regexp_count(text, F.lit(r"(?<=[\p{Ll}\p{N},;] )\p{Lu}\p{Ll}+")).cast("long")


def usable_paragraph(paragraph: Column, least: int = 40, most: int = 200) -> Column:
    """Neither too short nor too long, and not a speaker's line."""
    return word_count(paragraph).between(least, most) & ~paragraph.rlike(r"^[\p{Lu}][\p{L}. ]{1,40}:\s")


def annotate(paragraphs: DataFrame, model: Callable[[], Callable[[list[str]], list[list[tuple]]]], key: str = "wp_id") -> DataFrame:
    """Runs a model over paragraphs: `model()` loads it once per task and gives a function from texts to spans.

    A span is (ini, fin, tipo, score). Scores are kept as they come; cuts are applied when reading.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = model()
        for b in batches:
            rows = [(k, pi, a, z, p[a:z], tipo, float(s)) for k, pi, p, spans in zip(b[key], b["pi"], b["parrafo"], find(b["parrafo"].tolist())) for a, z, tipo, s in spans]
            yield pd.DataFrame(rows, columns=[key, "pi", "ini", "fin", "texto", "tipo", "score"])

    return paragraphs.select(key, "pi", "parrafo").mapInPandas(run, f"{key} long, pi int, ini int, fin int, texto string, tipo string, score double")


def capitalised_names() -> Callable[[list[str]], list[list[tuple]]]:
    """A rule in place of a model: runs of capitalised words are persons, longer runs being surer."""
    name = re.compile(r"\b[A-ZÁÉÍÓÚÑ][\wáéíóúñ]+(?: [A-ZÁÉÍÓÚÑ][\wáéíóúñ]+)*")
    return lambda texts: [[(m.start(), m.end(), "persona", min(0.99, 0.4 + 0.2 * m[0].count(" "))) for m in name.finditer(t)] for t in texts]
