"""Prediction-vs-gold evaluation.

Label metrics all start from one confusion aggregate ``groupBy(gold, pred)``
(partial aggregation map-side; the result has at most labels² rows), so the
only shuffle over the pair data is that one aggregate. Text metrics are single
``agg`` passes. Scores are rounded to 6 places for stable comparison.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlens.functions.stem import porter_stem
from facetlens.functions.text import normalize, strip_ws
from facetlens.session import cut_lineage

NDIGITS = 6


def _r(c: Column) -> Column:
    return F.round(c.cast("double"), NDIGITS)


def pair_eval(pred: DataFrame, gold: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """Pair predictions with gold rows on a key (never on row position)."""
    return gold.join(pred, on=key, how=how)


def text_key(col, null_as: str = "nan") -> Column:
    """str() then normalize: a missing value becomes 'nan' before comparison."""
    c = F.col(col) if isinstance(col, str) else col
    return normalize(F.coalesce(c.cast("string"), F.lit(null_as)))


# ---------------------------------------------------------------- text metrics

def exact_match_f1_col(g: Column, p: Column) -> Column:
    """tp = equal rows, fp = fn = unequal rows, so P = R = F1 = tp / n (0 when empty)."""
    return F.coalesce(F.try_divide(F.count_if(g == p).cast("double"), F.count(F.lit(1)).cast("double")),
                      F.lit(0.0))


def token_f1_col(g: Column, p: Column) -> Column:
    """A row is a hit when the whitespace token sets overlap at all; F1 = hits / n."""
    gt = F.filter(F.split(g, r"\s+"), lambda x: x != "")
    pt = F.filter(F.split(p, r"\s+"), lambda x: x != "")
    hit = F.coalesce(F.arrays_overlap(gt, pt), F.lit(False))
    return F.coalesce(F.try_divide(F.count_if(hit).cast("double"), F.count(F.lit(1)).cast("double")),
                      F.lit(0.0))


def rouge_tokens(col) -> Column:
    """Lower-cased alphanumeric runs (the ROUGE tokenizer without stemming)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda x: x != "")


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence length by dynamic programming in array
    higher-order functions: one DP row per token of ``a``. O(|a|·|b|²) array
    copies, so meant for short texts (answers, terms, clauses)."""
    m = F.size(b)
    zero_row = F.array_repeat(F.lit(0), m + 1)

    def next_row(prev, x):
        init = F.array(F.lit(0))

        def cell(acc, j):
            val = F.when(F.element_at(b, j) == x, F.element_at(prev, j) + 1) \
                .otherwise(F.greatest(F.element_at(prev, j + 1), F.element_at(acc, j)))
            return F.concat(acc, F.array(val))

        return F.when(m == 0, init).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), init, cell))

    last = F.aggregate(a, zero_row, next_row)
    return F.when((F.size(a) == 0) | (m == 0), F.lit(0)).otherwise(F.element_at(last, -1))


def rouge_l_f(g_tokens: Column, p_tokens: Column) -> Column:
    lcs = lcs_length(g_tokens, p_tokens).cast("double")
    prec = F.try_divide(lcs, F.size(p_tokens).cast("double"))
    rec = F.try_divide(lcs, F.size(g_tokens).cast("double"))
    return F.when((lcs == 0) | prec.isNull() | rec.isNull(), F.lit(0.0)).otherwise(
        2 * prec * rec / (prec + rec))


def rouge_l_col(g_tokens: Column, p_tokens: Column) -> Column:
    """Mean ROUGE-L F over rows. Pass references to projected token columns:
    the DP lambdas read them once per cell."""
    return F.coalesce(F.avg(rouge_l_f(g_tokens, p_tokens)), F.lit(0.0))


def rouge_l(df: DataFrame, g: str, p: str) -> DataFrame:
    """(n, rouge_l): tokens are projected first, then one aggregate."""
    t = df.select(rouge_tokens(g).alias("_g"), rouge_tokens(p).alias("_p"))
    return t.agg(F.count(F.lit(1)).alias("n"), _r(rouge_l_col(F.col("_g"), F.col("_p"))).alias("rouge_l"))


def lcs_bits(a: list[str], b: list[str], block: int = 4096) -> int:
    """LCS length by bit-parallel rows: one bit per token of ``b``, in blocks whose
    carries go from one to the next, so memory is linear in the texts."""
    carry, total = bytearray(len(a)), 0
    for start in range(0, len(b), block):
        part = b[start:start + block]
        at: dict[str, int] = {}
        for i, x in enumerate(part):
            at[x] = at.get(x, 0) | 1 << i
        mask = (1 << len(part)) - 1
        v = mask
        for j, x in enumerate(a):
            m = at.get(x, 0)
            s = v + (v & m) + carry[j]
            carry[j] = s >> len(part)
            v = s & mask | v & ~m
        total += len(part) - v.bit_count()
    return total


def stemmed_tokens(rows: DataFrame, key: str | list[str], cols: list[str], broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(key, cols): the token arrays ``cols`` with words of over three letters replaced by their Porter stems.

    Tokens never leave their row. Distinct words are stemmed, and stems that differ from their word are sent
    to every task up to ``broadcast_bytes`` of them. Beyond that, the words found in most rows are sent with their
    stems, about as many bytes, and each row's other distinct words are stemmed in the row.
    """
    keys = [key] if isinstance(key, str) else key
    spark = rows.sparkSession
    long = F.array_distinct(F.filter(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in cols]), lambda x: F.length(x) > 3))
    counts = rows.select(F.explode(long).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    stems = cut_lineage(counts.select("n", "word", porter_stem("word").alias("stem")))
    bytes_ = F.sum(F.length("word") + F.length("stem") + 64)
    size = stems.where("stem <> word").agg(bytes_).first()[0] or 0
    if size <= broadcast_bytes:
        kept = stems.where("stem <> word")
    else:
        share = broadcast_bytes / stems.agg(bytes_).first()[0]
        kept = stems.where(F.col("n") > stems.agg(F.percentile_approx("n", F.lit(1 - share))).first()[0]) if share else stems.limit(0)
    t = kept.select("word", "stem").toArrow()
    sent = spark.sparkContext.broadcast(dict(zip(t.column("word").to_pylist(), t.column("stem").to_pylist())))

    @F.pandas_udf("array<string>")
    def replaced(tokens: pd.Series) -> pd.Series:
        known = sent.value
        return pd.Series([None if t is None else [known.get(x, x) for x in t] for t in tokens], dtype=object)

    if size <= broadcast_bytes:
        return rows.select(*keys, *[replaced(c).alias(c) for c in cols])

    @F.pandas_udf("array<string>")
    def others(words: pd.Series) -> pd.Series:
        known = sent.value
        return pd.Series([[x for x in w if x not in known] for w in words], dtype=object)

    @F.pandas_udf("array<string>")
    def looked_up(tokens: pd.Series, words: pd.Series, stems: pd.Series) -> pd.Series:
        known, out = sent.value, []
        for t, w, s in zip(tokens, words, stems):
            own = dict(zip(w, s))
            out.append(None if t is None else [own[x] if x in own else known.get(x, x) for x in t])
        return pd.Series(out, dtype=object)

    own = rows.select(*keys, *cols, others(long).alias("_w"))
    own = own.select("*", F.transform("_w", porter_stem).alias("_s"))
    return own.select(*keys, *[looked_up(c, "_w", "_s").alias(c) for c in cols])


def lcs_lengths():
    """Arrow batch function: LCS length of two columns of token arrays."""
    @F.pandas_udf("bigint")
    def lengths(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lcs_bits(list(x), list(y)) for x, y in zip(a, b)], dtype="int64")

    return lengths


def rouge_pairs(df: DataFrame, g: str, p: str) -> DataFrame:
    """(g, p, n, rouge_l): stemmed ROUGE-L F of every distinct pair of texts and how often it occurs; null is an empty text."""
    from facetlens.session import ship_package

    ship_package(df.sparkSession)
    pairs = cut_lineage(df.groupBy(F.coalesce(g, F.lit("")).alias("_g"), F.coalesce(p, F.lit("")).alias("_p")).agg(F.count(F.lit(1)).alias("n")))
    toks = stemmed_tokens(pairs.select("*", rouge_tokens("_g").alias("_gt"), rouge_tokens("_p").alias("_pt")), ["_g", "_p", "n"], ["_gt", "_pt"])
    # 2 PR / (P + R) = 2 L / (|g| + |p|); a pair without any token scores 0
    f = F.try_divide(2 * lcs_lengths()("_gt", "_pt"), (F.size("_gt") + F.size("_pt")).cast("double"))
    return toks.select(F.col("_g").alias(g), F.col("_p").alias(p), "n", F.coalesce(f, F.lit(0.0)).alias("rouge_l"))


def rouge_l_stemmed(df: DataFrame, g: str, p: str) -> DataFrame:
    """(n, rouge_l): mean ROUGE-L F of stemmed tokens over all rows, scored once a distinct pair."""
    return rouge_pairs(df, g, p).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"),
        _r(F.coalesce(F.try_divide(F.sum(F.col("rouge_l") * F.col("n")), F.sum("n").cast("double")), F.lit(0.0))).alias("rouge_l"))


def rouge_l_tokens(df: DataFrame, g: str, p: str) -> DataFrame:
    """(n, rouge_l) of token columns of any length, unstemmed: the LCS runs in Python workers by Arrow batches."""
    from facetlens.session import ship_package

    ship_package(df.sparkSession)
    none = F.array().cast("array<string>")
    t = df.select(F.coalesce(F.col(g), none).alias("_g"), F.coalesce(F.col(p), none).alias("_p"))
    t = t.select((F.size("_g") + F.size("_p")).cast("double").alias("_n"), lcs_lengths()("_g", "_p").alias("_l"))
    return t.agg(F.count(F.lit(1)).alias("n"), _r(F.coalesce(F.avg(
        F.coalesce(F.try_divide(2 * F.col("_l"), F.col("_n")), F.lit(0.0))), F.lit(0.0))).alias("rouge_l"))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                      F.lit(0.0), lambda s, v: s + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.try_divide(dot, na * nb)


def embedding_similarity(df: DataFrame, g_vec: str, p_vec: str) -> DataFrame:
    """Mean cosine of paired vectors (vectors are an input column)."""
    return df.agg(F.count(F.lit(1)).alias("n_pairs"),
                  _r(F.coalesce(F.avg(cosine(F.col(g_vec), F.col(p_vec))), F.lit(0.0))).alias("mean_cosine"))


def paired_similarity(texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """(score): mean cosine of the vectors (text, vec) of paired texts (g, p), computed once a distinct pair."""
    pairs = texts.groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"))
    for side in ("g", "p"):
        pairs = pairs.join(vectors.select(F.col("text").alias(side), F.col("vec").alias(f"{side}_vec")), side)
    pairs = pairs.select("n", cosine(F.col("g_vec"), F.col("p_vec")).alias("cos")).where("cos is not null")
    return pairs.agg(F.coalesce(F.try_divide(F.sum(F.col("cos") * F.col("n")), F.sum("n").cast("double")), F.lit(0.0)).alias("score"))


def text_scores(df: DataFrame, g: str, p: str) -> DataFrame:
    gk, pk = text_key(g), text_key(p)
    return df.agg(F.count(F.lit(1)).alias("n"),
                  _r(exact_match_f1_col(gk, pk)).alias("exact_match_f1"),
                  _r(token_f1_col(gk, pk)).alias("token_f1"))


# ---------------------------------------------------------------- label metrics

def confusion(df: DataFrame, g: str, p: str) -> DataFrame:
    """(gold, pred, n): the one shuffle over the pair data."""
    return df.groupBy(F.col(g).alias("gold"), F.col(p).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def label_stats(conf: DataFrame) -> DataFrame:
    """Per label of the union of gold and predicted labels: tp, support
    (gold count), predicted count, precision, recall, f1 (0 on 0/0)."""
    gold_side = conf.groupBy(F.col("gold").alias("label")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("gold").eqNullSafe(F.col("pred")), F.col("n")).otherwise(0)).alias("tp"))
    pred_side = conf.groupBy(F.col("pred").alias("pred_label")).agg(F.sum("n").alias("pred_n"))
    # a missing label is one label, whichever side misses it
    s = gold_side.join(pred_side, F.col("label").eqNullSafe(F.col("pred_label")), "full_outer").select(
        F.coalesce("label", "pred_label").alias("label"), F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("pred_n", F.lit(0)).alias("pred_n"))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("pred_n").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    s = s.withColumns({"precision": prec, "recall": rec})
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return s.withColumn("f1", f1)


def accuracy(df: DataFrame, g: str, p: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"),
                  _r(F.coalesce(F.avg(F.coalesce(F.col(g) == F.col(p), F.lit(False)).cast("double")),
                                F.lit(0.0))).alias("accuracy"))


def macro_prf(df: DataFrame, g: str, p: str) -> DataFrame:
    s = label_stats(confusion(df, g, p))
    return s.agg(F.count(F.lit(1)).alias("n_labels"), _r(F.avg("precision")).alias("macro_precision"),
                 _r(F.avg("recall")).alias("macro_recall"), _r(F.avg("f1")).alias("macro_f1"))


def weighted_prf(df: DataFrame, g: str, p: str) -> DataFrame:
    s = label_stats(confusion(df, g, p))
    tot = F.sum("support").cast("double")
    w = lambda c: _r(F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), tot), F.lit(0.0)))
    return s.agg(w("precision").alias("weighted_precision"), w("recall").alias("weighted_recall"),
                 w("f1").alias("weighted_f1"), F.sum("support").alias("support"))


def classification_report(df: DataFrame, g: str, p: str) -> DataFrame:
    """Per-label rows plus 'accuracy', 'macro avg' and 'weighted avg' rows:
    (row_label, precision, recall, f1, support)."""
    s = label_stats(confusion(df, g, p)).cache()
    per = s.select(F.col("label").alias("row_label"), _r(F.col("precision")).alias("precision"),
                   _r(F.col("recall")).alias("recall"), _r(F.col("f1")).alias("f1"),
                   F.col("support").cast("long").alias("support"))
    tot = F.sum("support")
    acc = s.agg(F.lit("accuracy").alias("row_label"), F.lit(None).cast("double").alias("precision"),
                F.lit(None).cast("double").alias("recall"),
                _r(F.try_divide(F.sum("tp").cast("double"), tot.cast("double"))).alias("f1"),
                tot.cast("long").alias("support"))
    mac = s.agg(F.lit("macro avg").alias("row_label"), _r(F.avg("precision")).alias("precision"),
                _r(F.avg("recall")).alias("recall"), _r(F.avg("f1")).alias("f1"),
                tot.cast("long").alias("support"))
    wt = lambda c: _r(F.try_divide(F.sum(F.col(c) * F.col("support")), tot.cast("double")))
    wtd = s.agg(F.lit("weighted avg").alias("row_label"), wt("precision").alias("precision"),
                wt("recall").alias("recall"), wt("f1").alias("f1"), tot.cast("long").alias("support"))
    return per.unionByName(acc).unionByName(mac).unionByName(wtd)


def evaluate(df: DataFrame, pred_prefix: str = "pred_",
             text_fields=("term", "opinion"), label_fields=("category", "polarity"),
             rouge: bool = True, vectors: DataFrame | None = None) -> DataFrame:
    """All metrics as a long frame (metric, score): per text field exact-match F1,
    token F1, stemmed ROUGE-L and embedding similarity; per label field accuracy,
    macro F1, macro precision, macro recall. Every string column is lower-cased first.

    ``vectors`` (text, vec) holds one vector per normalised text; ROUGE-L and the
    similarity are computed once a distinct pair and weighted by its count, pairs
    with a text that has no vector are left out of the similarity. Without it,
    ``<field>_vec`` columns are compared where they exist.
    """
    low = df.withColumns({f.name: F.lower(F.col(f.name)) for f in df.schema.fields
                          if isinstance(f.dataType, T.StringType)})
    aggs, parts = [], []
    for k in text_fields:
        gk, pk = text_key(k), text_key(pred_prefix + k)
        aggs += [exact_match_f1_col(gk, pk).alias(f"{k}_exact_match_f1"),
                 token_f1_col(gk, pk).alias(f"{k}_token_f1")]
        if vectors is None and f"{k}_vec" in df.columns and f"{pred_prefix}{k}_vec" in df.columns:
            aggs.append(F.coalesce(F.avg(cosine(F.col(f"{k}_vec"), F.col(f"{pred_prefix}{k}_vec"))),
                                   F.lit(0.0)).alias(f"{k}_embedding_sim"))
        texts = low.select(gk.alias("g"), pk.alias("p"))
        if rouge:
            parts.append(rouge_l_stemmed(texts, "g", "p").select(F.lit(f"{k}_rouge_l").alias("metric"), F.col("rouge_l").alias("score")))
        if vectors is not None:
            parts.append(paired_similarity(texts, vectors).select(F.lit(f"{k}_embedding_sim").alias("metric"), "score"))
    text_row = low.agg(*aggs)
    parts.append(text_row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("score"))
                                                     for c in text_row.columns])).alias("m")).select("m.*"))
    for k in label_fields:
        s = label_stats(confusion(low, k, pred_prefix + k))
        tp_n = s.agg(F.try_divide(F.sum("tp").cast("double"), F.sum("support").cast("double")).alias("acc"),
                     F.avg("f1").alias("f1"), F.avg("precision").alias("p"), F.avg("recall").alias("r"))
        parts.append(tp_n.select(F.explode(F.array(
            F.struct(F.lit(f"{k}_accuracy").alias("metric"), F.col("acc").alias("score")),
            F.struct(F.lit(f"{k}_macro_f1").alias("metric"), F.col("f1").alias("score")),
            F.struct(F.lit(f"{k}_precision").alias("metric"), F.col("p").alias("score")),
            F.struct(F.lit(f"{k}_recall").alias("metric"), F.col("r").alias("score")))).alias("m")).select("m.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("metric", _r(F.col("score")).alias("score"))


def metric_tables(long: DataFrame) -> DataFrame:
    """Split metrics into a text table (names with term/opinion) and a label
    table; display names in title case, scores to 4 places."""
    name = F.col("metric")
    is_text = name.contains("term") | name.contains("opinion")
    return long.select(F.when(is_text, F.lit("text")).otherwise(F.lit("label")).alias("table_name"),
                       F.initcap(F.replace(name, F.lit("_"), F.lit(" "))).alias("display_metric"),
                       F.round(F.col("score"), 4).alias("score"))


def not_equal(g: Column, p: Column) -> Column:
    """Null compares unequal to everything, itself included."""
    return F.coalesce(g != p, F.lit(True))


def wrong_rows(df: DataFrame, g: str, p: str, key: str, n: int | None = 10,
               cols: list[str] | None = None) -> DataFrame:
    out = df.where(not_equal(F.col(g), F.col(p))).select(key, *(cols or [g, p]))
    return out.orderBy(key).limit(n) if n is not None else out


def error_summary(df: DataFrame, g: str, p: str) -> DataFrame:
    """wrong, total, accuracy % (null on an empty frame) — on the raw frame,
    so case differences count as errors."""
    wrong = F.count_if(not_equal(F.col(g), F.col(p)))
    total = F.count(F.lit(1))
    return df.agg(wrong.alias("wrong_count"), total.alias("total_count"),
                  _r(F.lit(100.0) - F.try_divide(wrong.cast("double"), total.cast("double")) * 100).alias("accuracy_pct"))


def class_error_rates(df: DataFrame, g: str, p: str) -> DataFrame:
    wrong = F.count_if(not_equal(F.col(g), F.col(p)))
    total = F.count(F.lit(1))
    return df.groupBy(F.col(g).alias("gold")).agg(
        wrong.alias("wrong_count"), total.alias("total_count"),
        _r(wrong.cast("double") / total * 100).alias("error_pct"),
        _r(F.lit(100.0) - wrong.cast("double") / total * 100).alias("accuracy_pct"))


def value_counts(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """Counts per value, descending, ties by value; top ``k`` when given."""
    out = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), F.asc(col)).limit(k) if k else out


def with_rank(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rank rows of an already-small result (top-k output)."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


__all__ = [n for n in dir() if not n.startswith("_")] + ["strip_ws"]
