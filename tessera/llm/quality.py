"""Quality: a generalised additive model with pairwise interactions, learned by cyclic boosting of shallow trees."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tessera.llm.labelled import held_out, training_rows

#: Inputs of the model, all computed from the whole text.
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper_share", "digit_share", "stop_share", "symbol_share", "exclaim_share", "newline_share",
    "non_ascii_share", "distinct_words", "commonest_word", "byte_entropy", "log_line_bytes", "distinct_lines", "short_words", "long_words", "symbol_words",
)
_UPPER = np.arange(65, 91)
_DIGIT = np.arange(48, 58)
_STOP = np.array([ord(c) for c in ".,;:?"])
_SYMBOL = np.array([ord(c) for c in "#$%&*@=<>|{}[]\\^_~+/"])
_TAIL = frozenset(b"#$%&*@=<>|{}[]\\^_~+/")


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = raw.split(b"\n")
    m = max(len(words), 1)
    seen = Counter(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    p = count[count > 0] / n
    letters = max(n - int(count[:65].sum()), 1)
    return [
        np.log1p(n), np.log1p(len(words)), length.sum() / m, count[_UPPER].sum() / letters, count[_DIGIT].sum() / n, count[_STOP].sum() / n,
        count[_SYMBOL].sum() / n, count[33] / n, count[10] / n, count[128:].sum() / n, len(seen) / m, max(seen.values(), default=0) / m,
        float(-(p * np.log2(p)).sum()), np.log1p(n / len(lines)), len(set(lines)) / len(lines), (length <= 3).sum() / m, (length >= 12).sum() / m,
        sum(c for w, c in seen.items() if w[-1] in _TAIL) / m,
    ]


@dataclass
class Settings:
    bins: int = 32
    pair_bins: int = 8
    rounds: int = 150
    pairs: int = 6
    pair_rounds: int = 50
    leaves: int = 3
    rate: float = 0.1
    #: Regularisation of leaf values, in rows.
    ridge: float = 5.0
    #: Labelled documents learned from at most.
    most_rows: int = 6000


@dataclass
class Model:
    """score = sigmoid(bias + sum of tables[f][bin of f] + sum of pair tables)."""

    edges: list = field(default_factory=list)
    pair_edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)
    bias: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for f, (e, t) in enumerate(zip(self.edges, self.tables)):
            z += t[np.searchsorted(e, x[:, f], side="right")]
        for i, j, t in self.pairs:
            z += t[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cut points between neighbouring values near the quantiles."""
    q = np.unique(np.quantile(x, np.arange(1, bins) / bins))
    below = np.sort(np.unique(x))
    at = np.searchsorted(below, q, side="left")
    at = np.unique(at[(at > 0) & (at < len(below))])
    return (below[at - 1] + below[at]) / 2


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Leaf value of each bin of a shallow regression tree on one binned feature, grown best split first."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None)
        for a, b in parts:
            if b - a > 1:
                c = np.arange(a + 1, b)
                gain = value(a, c) + value(c, b) - value(a, b)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), (a, int(c[k]), b)), key=lambda x: x[0])
        if best[1] is None:
            break
        a, c, b = best[1]
        parts.remove((a, b))
        parts += [(a, c), (c, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """A tree of depth two on a pair of binned features (a cut of one, then a cut of the other on each side), and its gain."""
    best, out = 0.0, np.zeros_like(g)
    for turn in (0, 1):
        a, b = (g, h) if not turn else (g.T, h.T)
        cg, ch = np.cumsum(np.cumsum(a, 0), 1), np.cumsum(np.cumsum(b, 0), 1)
        for c in range(a.shape[0] - 1):
            gain, value = 0.0, np.zeros_like(a)
            for rows, sg, sh in ((slice(0, c + 1), cg[c], ch[c]), (slice(c + 1, None), cg[-1] - cg[c], ch[-1] - ch[c])):
                left = sg**2 / (sh + ridge) + (sg[-1] - sg) ** 2 / (sh[-1] - sh + ridge)
                k = int(left.argmax())
                gain += left[k]
                value[rows, : k + 1] = sg[k] / (sh[k] + ridge)
                value[rows, k + 1 :] = (sg[-1] - sg[k]) / (sh[-1] - sh[k] + ridge)
            if gain > best:
                best, out = gain, value.T if turn else value
    return out, best


def train(x: np.ndarray, y: np.ndarray, w: np.ndarray, s: Settings) -> Model:
    """Cyclic boosting: each round adds a small tree of one feature after the other, then the best pairs get theirs."""
    m = Model(bias=float(np.log(((w * y).sum() + 1) / ((w * (1 - y)).sum() + 1))))
    m.edges = [_edges(x[:, f], s.bins) for f in range(x.shape[1])]
    m.pair_edges = [_edges(x[:, f], s.pair_bins) for f in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(m.edges)]
    wide = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(m.pair_edges)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    w = w / w.mean() if len(w) else w
    z = np.full(len(x), m.bias)
    slope = lambda: (w * (y - (p := 1 / (1 + np.exp(-z)))), w * p * (1 - p))
    for _ in range(s.rounds):
        for f, b in enumerate(bins):
            if len(m.tables[f]) > 1:
                g, h = slope()
                t = s.rate * _tree(np.bincount(b, g, len(m.tables[f])), np.bincount(b, h, len(m.tables[f])), s.leaves, s.ridge)
                m.tables[f] += t
                z += t[b]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        a, b = len(m.pair_edges[i]) + 1, len(m.pair_edges[j]) + 1
        return np.bincount(wide[i] * b + wide[j], v, a * b).reshape(a, b)

    g, h = slope()
    split = [f for f in range(x.shape[1]) if len(m.pair_edges[f])]
    found = sorted(((_pair_tree(grid(i, j, g), grid(i, j, h), s.ridge)[1], i, j) for i, j in combinations(split, 2)), reverse=True)[: s.pairs]
    tables = {(i, j): np.zeros((len(m.pair_edges[i]) + 1, len(m.pair_edges[j]) + 1)) for _, i, j in found}
    for _ in range(s.pair_rounds):
        for (i, j), table in tables.items():
            g, h = slope()
            t = s.rate * _pair_tree(grid(i, j, g), grid(i, j, h), s.ridge)[0]
            table += t
            z += t[wide[i], wide[j]]
    m.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return m


@F.pandas_udf(ArrayType(DoubleType()))
def text_features(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings | None = None, key: str = "doc_id", text: str = "text") -> Model:
    """Learns from a bounded sample of labelled rows (Settings.most_rows) outside the held-out fold; only features travel."""
    s = settings or Settings()
    rows = training_rows(docs, labels, label, s.most_rows, key, text).select("k", "y", "w", text_features("text").alias("x")).toPandas()
    rows = rows.assign(h=pd.util.hash_pandas_object(rows["k"], index=False)).sort_values(["h", "k"]) if len(rows) else rows
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    if not len(x):
        x, y, w = np.zeros((1, len(FEATURES))), np.array([0.5]), np.ones(1)
    else:
        y, w = rows["y"].to_numpy(float), rows["w"].to_numpy(float)
    return train(x, y, w, s)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.3, settings: Settings | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores all documents: key, held_out, score (0 to 1), predicted (score >= cut), one row per input row.

    A null text counts as an empty one; both get the score of a text whose features are all zero. Without usable labels all
    scores are equal. Other columns are ignored, so neither language nor source nor key can be an input.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, settings, key, text))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))
        return pd.Series(held.value.score(x), dtype="float64")

    rows = docs.select(F.col(key).alias(key), held_out(key).alias("held_out"), score(F.col(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= cut).cast("int"))
