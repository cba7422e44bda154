"""Toxicity: a convolutional text classifier over hashed word embeddings, in numpy."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import materialize, one_of_a_kind
from tessera.llm.labelled import held_out, training_rows

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MOST_CACHED = 150_000


@dataclass
class Settings:
    buckets: int = 1 << 17
    dim: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 6
    epochs: int = 6
    batch: int = 64
    rate: float = 0.02
    #: Labelled documents learned from at most, bytes of their texts together, and words of each that a training step reads at a
    #: time (texts are read whole, in parts).
    most_rows: int = 4000
    most_bytes: int = 64_000_000
    window: int = 512
    seed: int = 7


#: Leading bytes of a word that count besides the word itself, so that inflected forms of a stem share a part.
STEMS = (4, 5)


def parts(word: bytes, buckets: int) -> list[int]:
    """Bucket numbers of a word and of its stems; several hashes make a clash of one of them harmless."""
    return [xxhash.xxh64_intdigest(word, 1) % buckets, *(xxhash.xxh64_intdigest(word[:n], 1 + n) % buckets for n in STEMS)]


def tokens(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").lower().encode("utf-8", "replace"))


class Hasher:
    """Texts as arrays of bucket numbers, a row for each part of a word."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words, known = tokens(text), self.known
        if len(known) > MOST_CACHED:
            known = self.known = {}
        for w in set(words).difference(known):
            known[w] = parts(w, self.buckets)
        return np.array([known[w] for w in words], np.int64).reshape(-1, 1 + len(STEMS)).T


@dataclass
class Network:
    """score = sigmoid(out . [max over places of relu(conv)] + bias), convolutions of several widths over word embeddings."""

    s: Settings
    embed: np.ndarray = None
    convs: list = field(default_factory=list)
    biases: list = field(default_factory=list)
    out: np.ndarray = None
    bias: float = 0.0
    #: Keys of the documents trained on.
    seen: set = field(default_factory=set)
    #: Names the network in Python workers.
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


class Scorer:
    """Scores texts with a trained network.

    A convolution is a sum over the filter's places, so each distinct word gets its share of every filter place once, as a
    row of a table; a text then costs one gather of rows and a few additions. The table is emptied when full.
    """

    def __init__(self, net: Network):
        self.net, s = net, net.s
        d = s.dim
        self.bank = np.concatenate([c[j * d : (j + 1) * d] for w, c in zip(s.widths, net.convs) for j in range(w)], axis=1)
        self.rows = np.zeros((MOST_CACHED, self.bank.shape[1]), np.float32)
        self.known: dict[bytes, int] = {}

    def learn(self, words: list[bytes]) -> None:
        missing = list(set(words).difference(self.known))
        if len(self.known) + len(missing) > len(self.rows):
            self.known, missing = {}, list(set(words))
            if len(missing) > len(self.rows):
                self.rows = np.zeros((2 * len(missing), self.rows.shape[1]), np.float32)
        for at in range(0, len(missing), 8192):
            some = missing[at : at + 8192]
            first = len(self.known)
            self.known.update(zip(some, range(first, first + len(some))))
            buckets = np.array([parts(w, self.net.s.buckets) for w in some])
            # Not a matrix product: its last bits would depend on what else is in the batch.
            self.rows[first : first + len(some)] = np.einsum("ij,jk->ik", self.net.embed[buckets].sum(axis=1), self.bank)

    def __call__(self, text: str | None) -> float:
        net, s = self.net, self.net.s
        words = tokens(text)
        self.learn(words)
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        best, reach = np.zeros((len(s.widths), s.filters), np.float32), max(s.widths)
        for at in range(0, len(ids), 32768):
            rows, col = self.rows[ids[at : at + 32768 + reach - 1]], 0
            for q, w in enumerate(s.widths):
                m = len(rows) - w + 1
                if m > 0:
                    z = rows[:m, col : col + s.filters]
                    for j in range(1, w):
                        z = z + rows[j : j + m, col + j * s.filters : col + (j + 1) * s.filters]
                    np.maximum(best[q], z.max(axis=0) + net.biases[q], out=best[q])
                col += w * s.filters
        z = float(best.ravel() @ net.out + net.bias)
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def train(texts: list[str | None], y: np.ndarray, s: Settings, weight: np.ndarray | None = None) -> Network:
    """Adam on the cross-entropy of whole texts: of each text the gradient flows to the places that gave its maxima.

    A text counts by its weight, in the first bias too, so a sample with dealt classes gives the odds of the rows it stands for.
    """
    weight = np.ones(len(y)) if weight is None else weight / weight.mean()
    share = float(np.average(y, weights=weight))
    rng, hasher = np.random.default_rng(s.seed), Hasher(s.buckets)
    docs = [hasher(t).astype(np.int32) for t in texts]
    hasher.known = {}
    net = Network(s, np.zeros((s.buckets, s.dim), np.float32))
    net.convs = [rng.normal(0, 1 / np.sqrt(w * s.dim), (w * s.dim, s.filters)).astype(np.float32) for w in s.widths]
    net.biases = [np.full(s.filters, 0.05, np.float32) for _ in s.widths]
    net.out = np.abs(rng.normal(0.5, 0.1, s.filters * len(s.widths))).astype(np.float32) * np.where(np.arange(s.filters * len(s.widths)) % 3 == 2, -1, 1)
    net.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    dense = [*net.convs, *net.biases, net.out]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in dense]
    square = np.zeros(s.buckets, np.float32)
    mb = vb = 0.0
    step = 0
    for _ in range(s.epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), s.batch):
            step += 1
            some = order[lo : lo + s.batch]
            n = len(some)
            grads, gb, rows, back = _gradients(net, [docs[i] for i in some], y[some], weight[some])
            for p, g, m in zip(dense, grads, moments):
                g /= n
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.001 * (g * g - m[1])
                p -= s.rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-7)
            mb, vb = mb + 0.1 * (gb / n - mb), vb + 0.001 * ((gb / n) ** 2 - vb)
            net.bias -= s.rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-7)
            if len(rows):
                uniq, inv = np.unique(rows, return_inverse=True)
                g = np.stack([np.bincount(inv, back[:, d], len(uniq)) for d in range(s.dim)], axis=1).astype(np.float32) / n
                square[uniq] += (g * g).mean(axis=1)
                net.embed[uniq] -= 2 * s.rate * g / (np.sqrt(square[uniq]) + 1e-8)[:, None]
    return net


def _maxima(net: Network, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each text and filter the largest activation (0 at least) and its place in the text (-1: none over 0).

    Texts are laid end to end and read in stretches of about `window` words each: one gather, one product for each filter
    place, and a maximum over each text's part of the stretch. Places whose words belong to two texts are left out.
    """
    s = net.s
    k, reach = len(s.widths) * s.filters, max(s.widths)
    best, spot = np.zeros((len(docs), k), np.float32), np.full((len(docs), k), -1)
    length = np.array([d.shape[1] for d in docs])
    for at in range(0, int(length.max(initial=0)), s.window):
        live = np.flatnonzero(length > at)
        parts = [docs[i][:, at : at + s.window + reach - 1] for i in live]
        have = np.array([p.shape[1] for p in parts])
        e = net.embed[np.concatenate(parts, axis=1)].sum(axis=0)
        first = np.cumsum(have) - have
        # Places left in the text from each word on, and each word's place in the stretch.
        inside = np.arange(len(e)) - np.repeat(first, have)
        left = np.repeat(have, have) - inside
        for q, w in enumerate(s.widths):
            z = np.full((len(e), s.filters), -1.0, np.float32)
            m = len(e) - w + 1
            if m > 0:
                z[:m] = sum(e[j : j + m] @ net.convs[q][j * s.dim : (j + 1) * s.dim] for j in range(w)) + net.biases[q]
            z[(left < w) | (inside >= s.window)] = -1.0
            top = np.maximum.reduceat(z, first, axis=0)
            for f in range(s.filters):
                c = q * s.filters + f
                better = top[:, f] > best[live, c]
                if better.any():
                    hits = np.flatnonzero(z[:, f] == np.repeat(top[:, f], have))
                    owner, seen = np.unique(np.searchsorted(first, hits, side="right") - 1, return_index=True)
                    use = better[owner]
                    spot[live[owner[use]], c] = at + inside[hits[seen[use]]]
                    best[live[owner[use]], c] = top[owner[use], f]
    return best, spot


def _gradients(net: Network, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], float, np.ndarray, np.ndarray]:
    """Sums over a minibatch: of the dense parameters, of the bias, and of embeddings as (rows, gradients)."""
    s = net.s
    k = len(s.widths)
    best, spot = _maxima(net, docs)
    g = (weight * (1 / (1 + np.exp(-np.clip(best @ net.out + net.bias, -30, 30))) - y)).astype(np.float32)
    grads: list[np.ndarray] = [np.zeros_like(p) for p in (*net.convs, *net.biases)] + [(g @ best).astype(np.float32)]
    rows, back = [], []
    for q, w in enumerate(s.widths):
        doc, f = np.nonzero(spot[:, q * s.filters : (q + 1) * s.filters] >= 0)
        if not len(doc):
            continue
        words = np.stack([docs[i][:, a : a + w] for i, a in zip(doc, spot[doc, q * s.filters + f])])
        gz = g[doc] * net.out[q * s.filters + f]
        x = net.embed[words].sum(axis=1).reshape(len(doc), w * s.dim)
        for j in range(s.filters):
            mine = f == j
            grads[q][:, j] = gz[mine] @ x[mine]
            grads[k + q][j] = gz[mine].sum()
        each = (gz[:, None] * net.convs[q][:, f].T).reshape(len(doc), 1, w, s.dim)
        rows.append(words.ravel())
        back.append(np.broadcast_to(each, (*words.shape, s.dim)).reshape(-1, s.dim))
    if not rows:
        return grads, float(g.sum()), np.zeros(0, np.int64), np.zeros((0, s.dim), np.float32)
    return grads, float(g.sum()), np.concatenate(rows), np.concatenate(back)


#: Steps of log-odds in which labelled rows are counted for the cut-offs.
STEP = 0.05


def calibrate(steps: np.ndarray, y: np.ndarray, lang: np.ndarray, rows: np.ndarray, weight: np.ndarray, least: int = 50) -> dict:
    """For each language the cut-off with the best F1 (key None: all languages together).

    The labelled rows come as counts: `rows` of language `lang` and label `y` have log-odds from steps * STEP to (steps + 1) * STEP
    and count `weight` each. The cut-off is the middle of the gap between neighbouring steps that hold rows; languages of
    fewer than `least` rows, or without toxic ones, use the common one.
    """

    def chance(z: float) -> float:
        return float(1 / (1 + np.exp(-z)))

    def best(at: np.ndarray) -> float:
        # Steps from the highest, each once.
        b, inv = np.unique(-steps[at], return_inverse=True)
        n = np.bincount(inv, rows[at] * weight[at])
        tp = np.cumsum(np.bincount(inv, rows[at] * weight[at] * y[at]))
        f1 = 2 * tp / (np.cumsum(n) + tp[-1])
        i = int(np.argmax(f1))
        return (chance(-b[i] * STEP) + (chance((1 - b[i + 1]) * STEP) if i + 1 < len(b) else 0.0)) / 2

    found = {None: best(np.ones(len(y), bool)) if y.sum() else 0.5}
    for x in {v for v in lang if v is not None}:
        mine = lang == x
        if rows[mine].sum() >= least and y[mine].sum():
            found[x] = best(mine)
    return found


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Settings | None = None, key: str = "doc_id", text: str = "text") -> Network:
    """Trains on a bounded sample of labelled rows (Settings.most_rows, most_bytes) outside the held-out fold; texts are read whole.

    A fifth of that sample is left to calibrated(). No language is read.
    """
    s = settings or Settings()
    rows = training_rows(docs, labels, label, s.most_rows, key, text, s.most_bytes).where(~_apart(F.col("k")))
    rows = rows.orderBy(F.xxhash64("k"), "k").toPandas()
    if not len(rows):
        return train([""], np.zeros(1, np.float32), s)
    net = train(rows["text"].tolist(), rows["y"].to_numpy(np.float32), s, rows["w"].to_numpy(float))
    net.seen = set(rows["k"].tolist())
    return net


def _apart(key: Column) -> Column:
    """A fifth of all keys, on which nothing is trained."""
    return F.pmod(F.xxhash64(F.lit(9), key), F.lit(5)) == 0


def calibrated(scored: DataFrame, labels: DataFrame, net: Network, label: str, key: str, lang: str) -> dict:
    """Cut-offs from all labelled rows outside the held-out fold and not trained on; `scored` has key, language and _score.

    A class of which training took a larger part counts by as much more. Only counts by language and step of score are collected.
    """
    s = scored.sparkSession
    truth = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)").where(~held_out("k"))
    truth = truth.groupBy("k").agg(F.max("y").alias("y"))
    seen = s.createDataFrame([(k,) for k in net.seen], truth.select("k").schema).withColumn("seen", F.lit(True))
    step = F.floor(F.ln(F.col("_score") / (1 - F.col("_score"))) / STEP)
    rows = scored.select(F.col(key).alias("k"), F.col(lang).alias("lang"), step.alias("step")).join(truth, "k").join(F.broadcast(seen), "k", "left")
    n = rows.groupBy("lang", "step", "y", F.col("seen").isNotNull().alias("seen")).agg(F.count("*").alias("n")).toPandas()
    free = n[~n["seen"].astype(bool)]
    if not len(free):
        return {None: 0.5}
    of = {y: n.loc[n["y"] == y, "n"].sum() / max(free.loc[free["y"] == y, "n"].sum(), 1) for y in (0, 1)}
    y = free["y"].to_numpy(int)
    return calibrate(free["step"].to_numpy(float), y, free["lang"].to_numpy(object), free["n"].to_numpy(float), np.where(y == 1, of[1], of[0]))


def score(docs: DataFrame, net: Network, text: str | Column = "text") -> Column:
    """A column with the score (0 to 1) of every whole text; null and empty texts get the score of no words."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = one_of_a_kind((Scorer, held.value.name), lambda: Scorer(held.value))
        for texts in batches:
            yield pd.Series([scorer(t) for t in texts], dtype="float64")

    return of(F.col(text) if isinstance(text, str) else text)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", cut: float = 0.5, settings: Settings | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Scores all documents: key, held_out, score, predicted (score >= cut) and rejected (score at or over its language's cut-off).

    One row per input row. Null and empty texts score like any text without known words; a null or unknown language uses the
    common cut-off; without usable labels all scores are equal. Other columns are ignored.
    """
    net = fit(docs, labels, label, settings, key, text)
    scored = materialize(docs.select(F.col(key).alias(key), F.col(lang).alias("_lang"), score(docs, net, text).alias("_score")))
    cuts = _cuts(calibrated(scored, labels, net, label, key, "_lang"), F.col("_lang"))
    return scored.select(key, held_out(key).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= cut).cast("int").alias("predicted"), (F.col("_score") >= cuts).alias("rejected"))


def _cuts(thresholds: dict, lang: Column) -> Column:
    cuts = F.lit(thresholds[None])
    for x, c in sorted((k, v) for k, v in thresholds.items() if k is not None):
        cuts = F.when(lang == x, F.lit(c)).otherwise(cuts)
    return cuts


def accepted(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Settings | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents, all columns, whose score stays under the cut-off of their language.

    Null and empty texts score like any text without known words and are judged like others; a null or unknown language
    uses the common cut-off; repeated rows stay or go together; without usable labels all rows stay unless 0.5 is reached
    by all; an empty table gives no rows; columns of any other name pass through.
    """
    net = fit(docs, labels, label, settings, key, text)
    row = F.col("row")
    named = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    scored = materialize(named.select("row", score(named, net, row[text]).alias("score")))
    judged = scored.select(row[key].alias(key), row[lang].alias("_lang"), F.col("score").alias("_score"))
    return scored.where(F.col("score") < _cuts(calibrated(judged, labels, net, label, key, "_lang"), row[lang])).select("row.*")
