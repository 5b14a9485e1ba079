"""Operator 10: language identification by hierarchical discrimination.

A text is a bag of hashed character 1- to 3-grams of its letters (lower case,
everything else one separator), normalised by its number of n-grams. Linear
support vector machines first choose the language family (one against the
rest), then one-against-one machines separate the languages of that family by
votes, ties going to the larger summed margin. Languages come from the training
rows; the table of families only says which of them are close relatives, and a
language outside it is a family of its own.

Defined results: null texts and texts without a letter get ``und`` and score 0;
a null ``doc_id`` is kept and not held out; rows with a null ``lang`` are never
learned from; with no training rows every text gets ``und``; rows are
classified one by one, so repeated rows and further columns change nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, python_ready

DIM = 1 << 13
GROUP_CHARS = 1_000_000
#: ISO 639-1 codes by language family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "baltic": "lt lv".split(), "uralic": "fi et hu".split(), "turkic": "tr az kk uz tk".split(),
    "semitic": "ar he mt am".split(), "indic": "hi ur bn pa mr gu ne".split(),
    "chinese": "zh yue wuu".split(),
}
_FAMILY = {code: f for f, codes in FAMILIES.items() for code in codes}
_LETTER = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in range(0x250)], np.uint32)


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], f"only:{lang}")


def gram_cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash cells of all n-grams, document after document, and n-grams per document."""
    joined = "\0".join([t.replace("\0", " ") for t in texts]) + "\0"
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    low = np.where(code < 0x250, _LETTER[np.minimum(code, 0x24F)], code)
    # one separator between words: drop the second and later of a run (the joints stay)
    gap = low == 32
    keep = ~(gap & np.concatenate([[False], gap[:-1]])) | (code == 0)
    low, joint = low[keep], code[keep] == 0
    low = np.where(joint, np.uint32(32), low).astype(np.uint32)
    doc = np.concatenate([[0], np.cumsum(joint)[:-1]])
    per_doc = np.bincount(doc, minlength=len(texts))
    b = np.concatenate([low[1:], np.array([32], np.uint32)])
    c = np.concatenate([low[2:], np.array([32, 32], np.uint32)])
    b[joint] = 32
    c[joint] = 32
    ends_next = np.concatenate([joint[1:], [True]])
    c[ends_next] = 32
    one = low * np.uint32(2654435761)
    two = (one ^ b) * np.uint32(2246822519)
    three = (two ^ c) * np.uint32(3266489917)
    grams = np.stack([one ^ (one >> np.uint32(15)), two ^ (two >> np.uint32(15)), three ^ (three >> np.uint32(15))], 1)
    return (grams & np.uint32(DIM - 1)).reshape(-1), per_doc * 3


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float, epochs: int, seed: int):
    """L2-regularised hinge loss by dual coordinate descent; returns weights and bias."""
    w, bias = np.zeros(DIM), 0.0
    square = np.array([float(v @ v) + 1.0 for _, v in rows])
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            grad = y[i] * (float(w[at] @ v) + bias) - 1
            new = min(max(alpha[i] - grad / square[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                bias += step
                alpha[i] = new
    return w, bias


class LanguageModel:
    """Family machines and one-against-one machines; one weight column each."""

    def __init__(self, scale: float = 100.0, cost: float = 4.0, epochs: int = 12):
        self.scale, self.cost, self.epochs = scale, cost, epochs
        self.families: list[str] = []
        self.members: dict[str, list[str]] = {}
        self.machines: list[tuple] = []
        self.weights, self.bias = np.zeros((DIM, 0), np.float32), np.zeros(0)

    def fit(self, rows, langs: list[str]) -> "LanguageModel":
        rows = [(at, v.astype(np.float64) * self.scale) for at, v in rows]
        lang = np.array(langs)
        family = np.array([family_of(x) for x in langs])
        self.families = sorted(set(family))
        self.members = {f: sorted(set(lang[family == f])) for f in self.families}
        found = []

        def learn(name, use, y):
            picked = [rows[i] for i in np.flatnonzero(use)]
            self.machines.append(name)
            found.append(_svm(picked, y, self.cost, self.epochs, len(self.machines)))

        if len(self.families) > 1:
            for f in self.families:
                learn(("family", f), np.ones(len(lang), bool), np.where(family == f, 1.0, -1.0))
        for f in self.families:
            for i, a in enumerate(self.members[f]):
                for b in self.members[f][i + 1:]:
                    use = (lang == a) | (lang == b)
                    learn(("pair", f, a, b), use, np.where(lang[use] == a, 1.0, -1.0))
        if found:
            self.weights = np.stack([w for w, _ in found], 1).astype(np.float32) * np.float32(self.scale)
            self.bias = np.array([b for _, b in found])
        return self

    def margins(self, texts: list[str]) -> np.ndarray:
        cells, per = gram_cells(texts)
        start = np.cumsum(per) - per
        # a document has at least the three n-grams of its closing separator
        sums = np.stack([np.add.reduceat(self.weights[:, m][cells], start, dtype=np.float64)
                         for m in range(self.weights.shape[1])], 1)
        return sums / per[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        good = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not self.families:
            return langs, scores
        at = 0
        while at < len(good):
            end, size = at, 0
            while end < len(good) and (end == at or size < GROUP_CHARS):
                size += len(texts[good[end]])
                end += 1
            part, at = good[at:end], end
            margin = self.margins([texts[i] for i in part]) if self.machines else np.zeros((len(part), 0))
            for i, lang, score in zip(part, *self._decide(margin)):
                langs[i], scores[i] = lang, score
        return langs, scores

    def _decide(self, margin: np.ndarray):
        sure = 1 / (1 + np.exp(-2 * margin))
        n = len(margin)
        fam = [m for m, name in enumerate(self.machines) if name[0] == "family"]
        if fam:
            first = np.argmax(margin[:, fam], 1)
            p = sure[:, fam][np.arange(n), first]
        else:
            first, p = np.zeros(n, int), np.ones(n)
        out = np.empty(n, object)
        score = np.empty(n)
        for k, f in enumerate(self.families):
            names = self.members[f]
            rows = np.flatnonzero(first == k)
            if not len(rows):
                continue
            votes, sums = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            chance = np.ones((len(rows), len(names)))
            for m, name in enumerate(self.machines):
                if name[0] == "pair" and name[1] == f:
                    i, j = names.index(name[2]), names.index(name[3])
                    v, s = margin[rows, m], sure[rows, m]
                    votes[:, i] += v >= 0
                    votes[:, j] += v < 0
                    sums[:, i] += v
                    sums[:, j] -= v
                    chance[:, i] = np.minimum(chance[:, i], s)
                    chance[:, j] = np.minimum(chance[:, j], 1 - s)
            best = np.lexsort((-np.arange(len(names))[None, :].repeat(len(rows), 0), sums, votes), axis=1)[:, -1]
            out[rows] = np.array(names, object)[best]
            score[rows] = p[rows] * chance[np.arange(len(rows)), best]
        return out.tolist(), score.tolist()


def fit_language(docs: DataFrame, per_language: int = 1000, languages: int = 200, mod: int = 4,
                 rest: int = 2) -> LanguageModel:
    """Fit on about ``per_language`` documents of each of the ``languages`` most frequent languages.

    A language's documents are thinned by a hash of ``doc_id`` to that expected
    number; a language with fewer is used whole. The driver gets the sample as
    Arrow columns, since rows of Python numbers take ten times their memory.
    """
    python_ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"))
    usable = F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", mod, rest)
    rates = (rows.where(usable).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), "lang").limit(languages)
             .select("lang", (F.lit(float(per_language)) / F.col("n") * 1_000_000).alias("rate")))
    sample = (rows.where(usable).join(F.broadcast(rates), "lang")
              .where((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("rate")) & F.col("text").rlike(r"\p{L}")))

    @F.pandas_udf("struct<cells:array<int>, share:array<float>>")
    def grams(text: pd.Series) -> pd.DataFrame:
        cells, share = [], []
        for t in text:
            c, _ = gram_cells([t])
            at, n = np.unique(c, return_counts=True)
            cells.append(at.astype(np.int32))
            share.append((n / n.sum()).astype(np.float32))
        return pd.DataFrame({"cells": cells, "share": share})

    got = sample.select("doc_id", "lang", grams("text").alias("g")).select("doc_id", "lang", "g.*").toArrow()
    ids, langs, rows = got["doc_id"].to_pylist(), got["lang"].to_pylist(), []
    for part in got.select(["cells", "share"]).to_batches():
        cells, share = part.column(0), part.column(1)
        cuts = cells.offsets.to_numpy()[1:-1] - cells.offsets[0].as_py()
        rows += zip(np.split(cells.flatten().to_numpy(), cuts), np.split(share.flatten().to_numpy(), cuts))
    order = sorted(range(len(ids)), key=lambda i: (ids[i], langs[i]))
    return LanguageModel().fit([rows[i] for i in order], [langs[i] for i in order])


def language_of(model: LanguageModel, text: Column) -> Column:
    """Struct column (lang_pred, score) of a text column."""
    @F.pandas_udf("struct<lang_pred:string, score:double>")
    def predict(t: pd.Series) -> pd.DataFrame:
        langs, scores = model.predict(t.tolist())
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict(text.cast("string"))


def identify_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    model = fit_language(docs)
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out("doc_id", 4, 2).alias("held_out"),
                        language_of(model, F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
