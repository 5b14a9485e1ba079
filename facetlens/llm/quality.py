"""Operator 2: quality classifier, a generalised additive model with pairs.

Each feature of a text is cut into bins; cyclic boosting visits the features in
turn and adds a shrunken shallow tree (at most four leaves) of that feature
alone to its lookup table. Afterwards the feature pairs that reduce the
remaining loss most get small two-dimensional tables in the same way. A score
is the logistic of the sum of the looked-up values.

Defined results: a null or empty text has the features of the empty text and
is scored like any other; a null ``doc_id`` is kept and not held out; rows are
scored one by one, so repeated rows, ties and further columns change nothing.
Without labelled rows of both classes the score is the known share of label 1
(0.5 with no labels at all).
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, python_ready
from .training import labelled_sample

FEATURES = (
    "log_chars", "log_words", "word_length", "long_words", "short_words", "letters", "upper", "digits", "spaces",
    "stops", "symbols", "marks", "bars", "beyond_ascii", "distinct_words", "top_word", "adjacent_repeats",
    "distinct_pairs", "log_lines", "words_per_line", "repeated_lines", "symbol_ends", "capitalised", "line_length_spread")

_KIND = np.zeros(0x250, np.uint8)   # 1 letter, 2 upper letter, 3 digit, 4 space, 5 stop, 6 symbol, 7 ! or ?, 8 bar
for _c in range(0x250):
    _s = chr(_c)
    _KIND[_c] = (2 if _s.isupper() else 1 if _s.isalpha() else 3 if _s.isdigit() else 4 if _s.isspace()
                 else 5 if _s in ".,;:" else 7 if _s in "!?" else 8 if _s in "|<>{}" else 6)


def features(text: str | None) -> list[float]:
    text = text or ""
    n = len(text)
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kind = np.bincount(_KIND[np.minimum(code, 0x24F)], minlength=9) / max(1, n)
    words = text.split()
    m = max(1, len(words))
    counts = Counter(words)
    repeats = sum(map(eq, words, words[1:]))
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 1
    lines = [x for x in text.split("\n") if x]
    k = max(1, len(lines))
    lengths = np.array([len(x) for x in lines] or [0])
    word_lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    tails = Counter([w[-1] for w in words])
    odd = sum(c for t, c in tails.items() if not t.isalnum() and t not in ".,;:")
    caps = sum(c for w, c in counts.items() if w[0].isupper())
    return [
        math.log1p(n), math.log1p(len(words)), float(word_lengths.mean()), float((word_lengths > 12).mean()),
        float((word_lengths <= 3).mean()), float(kind[1] + kind[2]), float(kind[2]), float(kind[3]), float(kind[4]),
        float(kind[5]), float(kind[6]), float(kind[7]), float(kind[8]), float((code > 127).sum()) / max(1, n),
        len(counts) / m * math.log(1 + m), max(counts.values(), default=0) / m, repeats / m,
        pairs / max(1, len(words) - 1), math.log1p(k), len(words) / k, 1 - len(set(lines)) / k,
        odd / m, caps / m, float(lengths.std() / max(1.0, lengths.mean()))]


def matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


def _leaves(g: np.ndarray, h: np.ndarray, most: int, reg: float) -> np.ndarray:
    """Values per bin of a greedy shallow tree over ordered bins (gradients g, hessians h)."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def gain(a, b):
        return (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + reg)

    while len(cuts) <= most:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                mid = np.arange(a + 1, b)
                won = gain(a, mid) + gain(mid, b) - gain(a, b)
                j = int(np.argmax(won))
                if won[j] > best[0]:
                    best = (float(won[j]), int(mid[j]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + reg)
    return out


class AdditiveModel:
    """Lookup tables per feature and per chosen pair of features."""

    def __init__(self, bins=32, coarse=8, rounds=120, pair_rounds=40, pairs=8, rate=0.15, reg=2.0):
        self.bins, self.coarse, self.rounds, self.pair_rounds = bins, coarse, rounds, pair_rounds
        self.n_pairs, self.rate, self.reg = pairs, rate, reg
        self.bias, self.edges, self.tables, self.pairs, self.pair_tables = 0.0, [], [], [], []

    def _binned(self, x):
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def _grid(self, binned, j, k):
        step = -(-self.bins // self.coarse)
        return (binned[j] // step) * self.coarse + binned[k] // step

    def fit(self, x: np.ndarray, y: np.ndarray) -> "AdditiveModel":
        share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
        self.bias = math.log(share / (1 - share))
        if not len(y) or y.min() == y.max():
            return self
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self._binned(x)
        self.tables = [np.zeros(self.bins) for _ in self.edges]
        z = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            for j, b in enumerate(binned):
                p = 1 / (1 + np.exp(-z))
                step = self.rate * _leaves(np.bincount(b, y - p, self.bins), np.bincount(b, p * (1 - p), self.bins),
                                           4, self.reg)
                self.tables[j] += step
                z += step[b]
        p = 1 / (1 + np.exp(-z))
        cells = self.coarse ** 2
        gains = []
        for j in range(len(binned)):
            for k in range(j):
                c = self._grid(binned, j, k)
                g, h = np.bincount(c, y - p, cells), np.bincount(c, p * (1 - p), cells)
                gains.append((float((g * g / (h + self.reg)).sum()), j, k))
        self.pairs = [(j, k) for _, j, k in sorted(gains, reverse=True)[:self.n_pairs]]
        self.pair_tables = [np.zeros(cells) for _ in self.pairs]
        for _ in range(self.pair_rounds):
            for t, (j, k) in zip(self.pair_tables, self.pairs):
                c = self._grid(binned, j, k)
                p = 1 / (1 + np.exp(-z))
                g = np.bincount(c, y - p, cells).reshape(self.coarse, self.coarse)
                h = np.bincount(c, p * (1 - p), cells).reshape(self.coarse, self.coarse)
                # a depth-two tree: one cut of the first feature, one cut of the second in each part
                rows = _leaves(g.sum(1), h.sum(1), 2, self.reg)
                step = np.empty_like(g)
                for v in np.unique(rows):
                    part = rows == v
                    step[part] = _leaves(g[part].sum(0), h[part].sum(0), 2, self.reg)
                step = self.rate * step.reshape(-1)
                t += step
                z += step[c]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        if self.tables and len(x):
            binned = self._binned(x)
            for t, b in zip(self.tables, binned):
                z += t[b]
            for t, (j, k) in zip(self.pair_tables, self.pairs):
                z += t[self._grid(binned, j, k)]
        return 1 / (1 + np.exp(-z))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 4000, mod: int = 4, rest: int = 2) -> AdditiveModel:
    """Fit on at most ``per_class`` rows of each class that are not held out."""
    python_ready(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", per_class, lambda c: held_out(c, mod, rest))

    @F.pandas_udf("array<double>")
    def measured(text: pd.Series) -> pd.Series:
        return pd.Series(list(matrix(text)))

    rows = sample.select("doc_id", measured("text").alias("x"), "label").toPandas().sort_values(
        ["doc_id", "label"], kind="stable")
    # each class was drawn up to its own bound; rows weigh alike
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return AdditiveModel().fit(x, rows["label"].to_numpy(np.float64))


def quality_score(model: AdditiveModel, text: Column) -> Column:
    """Column expression with the score (0 to 1) of a text column."""
    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        return pd.Series(model.score(matrix(t)))

    return score(text.cast("string"))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit_quality(docs, labels)
    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out("doc_id", 4, 2).alias("held_out"),
                         quality_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
