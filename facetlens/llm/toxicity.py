"""Operator 4: toxicity by a lexicon that tolerates misspelling, weighed by context.

The lexicon is learned from training rows: terms whose documents are almost
always toxic, in more independent texts than chance explains (near copies of one
document do not make a term). It is kept as a trie; the words of a text are matched by
running the Levenshtein automaton of the word over the trie, so misspelled
terms within one edit (two for long terms) are caught. Each hit is weighed by a
window of words around it: further hits and second-person address raise the
weight, open quotation marks and reporting verbs lower it. A logistic
regression over a few sums of those weights gives the score.

Defined results: null and empty texts have no hits and get the score of a text
without hits; a null ``doc_id`` is kept and not held out; texts are scored one
by one, so repeated rows, ties and further columns change nothing. Without
toxic or without clean training rows the score is the known share of label 1
(0 with no labels at all).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, kept_table, python_ready
from .training import labelled_sample

STRIP = ".,;:!?\"'()[]{}<>*#$%&|_-~`«»„“”‚‘’…¡¿"
QUOTES = frozenset("\"«»„“”")
#: Words that report speech, and second-person address.
REPORTING = frozenset("said says say wrote writes called calls quoted quote quotes reported reports according stated "
                      "sagte sagt schrieb nannte zitierte dit disait écrit cité appelé dijo dice escribió citó llamó"
                      .split())
ADDRESS = frozenset("you your you're youre u ur du dich dein deine ihr euch tu te toi ton vous votre tú usted tus"
                    .split())
WINDOW = 8


def word_of(raw: str) -> str:
    return raw.strip(STRIP).lower()


def edits_allowed(n: int) -> int:
    return 0 if n < 4 else 1 if n < 10 else 2


def letter_mask(word: str) -> int:
    m = 0
    for c in word:
        m |= 1 << (ord(c) & 63)
    return m


class Trie:
    """Lexicon trie; ``near`` intersects it with the Levenshtein automaton of a word.

    An index of term parts that survive the edits names the few terms a word can
    be close to, and only the branches that lead to those are walked.
    """

    def __init__(self, terms: list[str]):
        self.terms = list(terms)
        self.exact = {t: k for k, t in enumerate(self.terms)}
        # a node: children, term that ends here or -1, terms below as a range of alphabetical places
        by_name = sorted(range(len(self.terms)), key=lambda k: self.terms[k])
        self.place = [0] * len(by_name)
        self.root: list = [{}, -1, 0, len(by_name)]
        for at, k in enumerate(by_name):
            self.place[k] = at
            node = self.root
            for c in self.terms[k]:
                node = node[0].setdefault(c, [{}, -1, at, at])
                node[3] = at + 1
            node[1] = k
        # word length -> [(head letters, tail start, {key: terms})], see candidates
        index: dict[int, dict[tuple[int, int], dict[str, list]]] = {}
        self.inner: dict[int, dict[int, dict[str, list]]] = {}
        for k, t in enumerate(self.terms):
            e = edits_allowed(len(t))
            if not e:
                continue
            cuts = [len(t) * i // 3 for i in range(4)]
            one, two, three = (t[a:b] for a, b in zip(cuts, cuts[1:]))
            # one edit leaves two of three parts intact, two edits leave one
            keys = [(one + two, ""), ("", two + three), (one, three)] if e == 1 else [(one, ""), ("", three)]
            entry = (self.place[k], letter_mask(t), e)
            for n in range(len(t) - e, len(t) + e + 1):
                for head, tail in keys:
                    (index.setdefault(n, {}).setdefault((len(head), len(tail)), {})
                     .setdefault(head + tail, []).append(entry))
                if e == 2:
                    self.inner.setdefault(n, {}).setdefault(len(two), {}).setdefault(two, []).append(entry)
        self.shapes = {n: [(h, n - t, found) for (h, t), found in x.items()] for n, x in index.items()}

    def candidates(self, word: str) -> set[int]:
        """Places of all terms that can be within their edits of ``word``.

        A term within ``e`` edits shares an intact part with the word, differs
        in length by at most ``e`` and in its set of letters by at most ``e``
        letters either way.
        """
        n = len(word)
        lists: list = []
        for head, tail, found in self.shapes.get(n, ()):
            got = found.get(word[:head] + word[tail:])
            if got:
                lists += got
        for k, found in self.inner.get(n, {}).items():
            for i in range(n - k + 1):
                got = found.get(word[i:i + k])
                if got:
                    lists += got
        if not lists:
            return set()
        mine = letter_mask(word)
        return {p for p, mask, e in lists
                if (mask & ~mine).bit_count() <= e and (mine & ~mask).bit_count() <= e}

    def near(self, word: str) -> tuple[int, int] | None:
        """(term, distance) of the closest term within its edits; ties to the first term."""
        got = self.exact.get(word)
        if got is not None:
            return got, 0
        wanted = self.candidates(word)
        if not wanted:
            return None
        n, best = len(word), None
        # automaton state: bit i of level d means i letters of the word read with d edits
        every = (1 << (n + 1)) - 1
        letters: dict[str, int] = {}
        for i, c in enumerate(word):
            letters[c] = letters.get(c, 0) | 1 << i
        todo = [(self.root, 1, 3 & every, 7 & every, 0)]
        while todo:
            (children, k, _, _), s0, s1, s2, depth = todo.pop()
            if k >= 0:
                most = edits_allowed(depth)
                for d, s in ((0, s0), (1, s1), (2, s2)):
                    if d <= most and s >> n & 1:
                        if best is None or (d, k) < best:
                            best = (d, k)
                        break
            for c, child in children.items():
                if not any(child[2] <= p < child[3] for p in wanted):
                    continue
                eq = letters.get(c, 0)
                t0 = (s0 & eq) << 1
                # same letter | term letter too many | substitution | word letter too many
                t1 = ((s1 & eq) << 1 | s0 | s0 << 1 | t0 << 1 | t0) & every
                t2 = ((s2 & eq) << 1 | s1 | s1 << 1 | t1 << 1 | t1) & every
                if t0 | t1 | t2:
                    todo.append((child, t0, t1, t2, depth + 1))
        return (best[1], best[0]) if best else None


class _Seen(dict):
    """Raw word -> (term, distance) or None, cached up to a bound."""

    def __init__(self, trie: Trie, most: int = 500_000):
        super().__init__()
        self.trie, self.most = trie, most

    def __missing__(self, raw: str):
        if len(self) >= self.most:
            self.clear()
        word = word_of(raw)   # looked up once for all its spellings with marks or capitals
        got = self[raw] = self[word] if word != raw and word in self else self.trie.near(word)
        self[word] = got
        return got


def quoted_words(words: list[str]) -> list[bool]:
    """For every word whether a quotation is open at its start (or opens there).

    Marks open and close in turn over the whole text; a last mark without a
    partner opens nothing.
    """
    per = [sum(c in QUOTES for c in w) for w in words]
    total, before, out = sum(per), 0, []
    pairs = total - total % 2
    for w, n in zip(words, per):
        at = before + (n > 0 and w[0] in QUOTES)
        out.append(at % 2 == 1 and at <= pairs)
        before += n
    return out


def hits(text: str | None, seen: _Seen, weight: np.ndarray) -> tuple[list[tuple], int]:
    """Hits (word position, term, distance, weight in context, quoted) and the number of words."""
    words = (text or "").split()
    look = seen.__getitem__
    raw = [(i, m) for i, m in enumerate(map(look, words)) if m is not None]
    if not raw:
        return [], len(words)
    inside = quoted_words(words) if any(c in text for c in QUOTES) else [False] * len(words)
    out = []
    for j, (i, (term, distance)) in enumerate(raw):
        a, b = max(0, i - WINDOW), i + WINDOW + 1
        around = [word_of(w) for w in words[a:b]]
        near = sum(1 for p, _ in raw[max(0, j - WINDOW):j + WINDOW + 1] if a <= p < b) - 1
        quoted = inside[i]
        factor = 1.0 + 0.15 * min(near, 4) + 0.3 * any(w in ADDRESS for w in around)
        factor *= (0.3 if quoted else 1.0) * (0.6 if any(w in REPORTING for w in around) else 1.0)
        out.append((i, term, distance, float(weight[term]) * factor, quoted))
    return out, len(words)


def summary(found: list[tuple], n_words: int) -> list[float]:
    exact = sum(w for _, _, d, w, _ in found if d == 0)
    near = sum(w for _, _, d, w, _ in found if d > 0)
    n_exact = sum(1 for f in found if f[2] == 0)
    return [math.log1p(max(exact, 0)), math.log1p(max(near, 0)), max([f[3] for f in found if f[2] == 0], default=0.0),
            float(min(n_exact, 3)), math.log1p(len({f[1] for f in found if f[2] == 0})),
            math.log1p(100 * n_exact / max(1, n_words)), math.log1p(100 * (len(found) - n_exact) / max(1, n_words))]


N_SUMS = 7


class ToxicModel:
    def __init__(self, terms: list[str], weight: list[float], coef: np.ndarray, mean, scale):
        self.terms, self.weight = list(terms), np.array(weight, np.float64)
        self.coef, self.mean, self.scale = coef, mean, scale
        self._seen = None

    def __getstate__(self):
        return {**self.__dict__, "_seen": None}

    @property
    def seen(self) -> _Seen:
        if self._seen is None:
            self._seen = _Seen(Trie(self.terms))
        return self._seen

    def sums(self, texts) -> np.ndarray:
        return np.array([summary(*hits(t, self.seen, self.weight)) for t in texts], np.float64).reshape(-1, N_SUMS)

    def score(self, texts) -> np.ndarray:
        z = self.coef[0] + ((self.sums(texts) - self.mean) / self.scale) @ self.coef[1:]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


SIGNATURES = 8


def signatures(words: list[str]) -> list[int]:
    """Least hashes of a text's 5-word shingles under ``SIGNATURES`` hash functions; near copies share most of them."""
    codes = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    codes = np.concatenate([codes, np.zeros(max(0, 5 - len(codes)), np.uint64)])
    n, shingles = len(codes) - 4, np.zeros(len(codes) - 4, np.uint64)
    for k in range(5):
        shingles = shingles * np.uint64(0x9E3779B97F4A7C15) + codes[k:n + k]
    out = []
    for k in range(SIGNATURES):
        x = (shingles ^ np.uint64(k + 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        out.append(int((x ^ (x >> np.uint64(29))).min().astype(np.int64)))
    return out


def independent_texts(sample: DataFrame) -> DataFrame:
    """(label, text): distinct texts, and of a class's near copies (equal in any signature, in turn) one."""
    signed = F.udf(lambda t: signatures(list(map(word_of, (t or "").split()))), "array<bigint>", useArrow=True)
    texts = kept_table(sample.select("label", "text").distinct().withColumn("h", F.sha2(F.coalesce("text", F.lit("")), 256)))
    left = kept_table(texts.select("label", "h", signed("text").alias("s")))
    for k in range(SIGNATURES):
        left = (left.groupBy("label", F.col("s")[k].alias("one")).agg(F.min(F.struct("h", "s")).alias("x"))
                .select("label", "x.h", "x.s"))
    return texts.join(F.broadcast(kept_table(left.select("label", "h"))), ["label", "h"]).select("label", "text")


def learn_lexicon(sample: DataFrame, least_texts: int = 3, odds: float = 8.0, chance: float = 0.05) -> list[tuple]:
    """Terms (term, log odds) whose toxic share no chance explains, the strongest first.

    Support is counted in independent texts: of near copies in one class one counts.
    A term needs ``least_texts`` toxic ones, four times its clean ones and ``odds``.
    If words fell on texts regardless of label, a word in n texts would meet a toxic or
    more extreme share f with a probability of at most exp(-n * KL(f, p)), p the toxic
    share of the texts. Of all words in ``least_texts`` texts or more those are taken,
    from the least probable on, of which at most a share ``chance`` is expected to be
    false (Benjamini and Hochberg's step), however large the sample.
    """
    @F.udf("array<string>", useArrow=True)
    def terms(text):
        return list({w for w in map(word_of, (text or "").split()) if 3 <= len(w) <= 40})

    texts = kept_table(independent_texts(sample))
    size = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return []
    each = texts.select("label", F.explode(terms("text")).alias("w"))
    n = kept_table(each.groupBy("w").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
                   .where(F.col("a") + F.col("b") >= least_texts).withColumn("n", F.col("a") + F.col("b")))
    share = size[1] / (size[0] + size[1])
    f = F.col("a") / F.col("n")
    kl = F.col("a") * F.log(f / share) + F.when(F.col("b") > 0, F.col("b") * F.log((1 - f) / (1 - share))).otherwise(0.0)
    n = n.withColumn("odds", F.log((F.col("a") + 0.5) / (size[1] + 1.0)) - F.log((F.col("b") + 0.5) / (size[0] + 1.0)))
    tested = n.count()
    n = kept_table(n.where((F.col("a") >= least_texts) & (F.col("odds") >= math.log(odds)) & (F.col("a") >= 4 * F.col("b"))
                           & (f > share)).withColumn("tenths", F.floor(kl * 10)))
    # from the surest words down: the last step at which chance explains few enough of the words so far
    so_far, cut = 0, None
    for r in n.groupBy("tenths").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("tenths")).collect():
        so_far += r["words"]
        if tested * math.exp(-r["tenths"] / 10) <= chance * so_far:
            cut = r["tenths"]
    if cut is None:
        return []
    got = n.where(F.col("tenths") >= cut)
    # each term holds a share of the sample's texts: bounded by the sample, not by a rank
    got = got.orderBy(F.desc(F.col("odds") * F.log1p("a")), "w")
    return [(r["w"], float(r["odds"])) for r in got.collect()]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    one = np.hstack([np.ones((len(x), 1)), x])
    w, keep = np.zeros(one.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(one @ w, -30, 30)))
        hess = one.T @ (one * (p * (1 - p) + 1e-9)[:, None]) + keep
        step = np.linalg.solve(hess, one.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = (30_000, 6_000), mod: int = 3,
                 rest: int = 1) -> ToxicModel:
    """Fit on at most ``per_class`` clean and toxic rows that are not held out."""
    python_ready(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", per_class, lambda c: held_out(c, mod, rest))
    lexicon = learn_lexicon(sample)
    draft = ToxicModel([t for t, _ in lexicon], [w for _, w in lexicon], np.zeros(N_SUMS + 1),
                       np.zeros(N_SUMS), np.ones(N_SUMS))

    @F.pandas_udf("array<double>")
    def sums(text: pd.Series) -> pd.Series:
        return pd.Series(list(draft.sums(text)))

    rows = sample.select("doc_id", sums("text").alias("x"), "label").toPandas().sort_values(
        ["doc_id", "label"], kind="stable")
    y = rows["label"].to_numpy(np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        draft.coef[0] = -60.0 if share == 0 else 60.0
        return draft
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, N_SUMS)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return ToxicModel(draft.terms, draft.weight, _logistic((x - mean) / scale, y), mean, scale)


def toxicity_score(model: ToxicModel, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        return pd.Series(model.score(t))

    return score(text.cast("string"))


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit_toxicity(docs, labels)
    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out("doc_id", 3, 1).alias("held_out"),
                         toxicity_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
