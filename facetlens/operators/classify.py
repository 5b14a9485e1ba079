"""Classification as DataFrame jobs.

* count-based multinomial naive Bayes (language identification on character
  trigrams, category prediction on word tokens): training is one
  ``groupBy(label, feature).count()``; scoring explodes features, joins the
  per-feature log-probability row (broadcast only behind a size check) and
  sums per document with map-side partial aggregation. Trigrams, one for every
  character, are counted and summed inside the tasks by Arrow batches;
* the texts of an array (the clauses of a review) are scored inside their row: no row a text is shuffled;
* exact stratified split without a per-class global sort;
* label index, polarity decoding, lexicon polarity, nearest centroid.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlens.functions.text import capitalize, strip_ws
from facetlens.operators.clauses import INTENSIFIERS, NEGATIONS
from facetlens.session import cut_lineage, ship_package, sized_broadcast

# Polarity ids of the sentiment model, in id order.
POLARITY_LABELS = {0: "Negative", 1: "Neutral", 2: "Positive"}
# Category ids of the category model, in id order (alphabetical).
CATEGORY_LABELS = {0: "Amenity", 1: "Branding", 2: "Experience", 3: "Facility", 4: "Loyalty",
                   5: "Service"}
UNKNOWN_CATEGORY = "Unknown"
NEUTRAL = "Neutral"


# ---------------------------------------------------------------- features

def char_trigrams(text) -> Column:
    """Overlapping character trigrams of the lower-cased whole text.

    One regex pass: a zero-width lookahead captures the three code points at
    every position, so the cost is linear in the text length.
    """
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.regexp_extract_all(t, F.lit("(?s)(?=(.{3}))"), 1)


def word_tokens(text) -> Column:
    """Lower-cased runs of letters/digits."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}]+"), 0)    # its pattern is compiled once, that of a split for every text


# ---------------------------------------------------------------- naive Bayes

@dataclass
class NBModel:
    labels: list[str]
    priors: dict[str, float]
    defaults: dict[str, float]
    table: DataFrame          # feature, lp_0 .. lp_{k-1} (log P(feature | label_i))
    class_stats: DataFrame    # label, n_docs, n_features, n_distinct

    def col(self, i: int) -> str:
        return f"lp_{i}"


def fit_nb(df: DataFrame, label_col: str, feats: Column, alpha: float = 1.0) -> NBModel:
    """Multinomial naive Bayes with add-``alpha`` smoothing.

    Only per-class scalars (document count, feature total) and the label list
    reach the driver: their size is the number of classes.
    """
    ex = df.select(F.col(label_col).alias("label"), F.explode(feats).alias("feature"))
    return nb_of_counts(df, label_col, ex.groupBy("label", "feature").agg(F.count(F.lit(1)).alias("c")), alpha)


def nb_of_counts(df: DataFrame, label_col: str, counts: DataFrame, alpha: float = 1.0) -> NBModel:
    """The model of ``counts`` (label, feature, c), the features counted in the rows of ``df``."""
    counts = counts.cache()
    docs = df.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n_docs"))
    per_class = counts.groupBy("label").agg(F.sum("c").alias("n_features"),
                                            F.count(F.lit(1)).alias("n_distinct"))
    stats = docs.join(per_class, "label", "left").fillna(0, ["n_features", "n_distinct"]).cache()
    rows = stats.collect()
    vocab = counts.select("feature").distinct().count()
    labels = sorted(r["label"] for r in rows)
    n_total = sum(r["n_docs"] for r in rows)
    tot = {r["label"]: r["n_features"] for r in rows}
    priors = {r["label"]: math.log(r["n_docs"] / n_total) for r in rows}
    denom = {l: tot[l] + alpha * vocab for l in labels}
    defaults = {l: math.log(alpha / denom[l]) for l in labels}
    wide = counts.groupBy("feature").pivot("label", labels).agg(F.first("c"))
    table = wide.select("feature", *[
        F.coalesce(F.log((F.col(f"`{l}`") + alpha) / F.lit(denom[l])), F.lit(defaults[l])).alias(f"lp_{i}")
        for i, l in enumerate(labels)]).cache()
    return NBModel(labels, priors, defaults, table, stats)


def predict_nb(model: NBModel, df: DataFrame, key: str, feats: Column,
               max_broadcast_rows: int = 5_000_000) -> DataFrame:
    """(key, pred, score, n_known): argmax class (ties -> alphabetically first)
    and its softmax probability. Features unseen in training are skipped; a
    row without known features gets the prior argmax."""
    ex = df.select(key, F.explode_outer(feats).alias("feature"))
    table = sized_broadcast(model.table, max_broadcast_rows)
    j = ex.join(table, "feature", "left")
    k = len(model.labels)
    return nb_argmax(model, key, j.groupBy(key).agg(
        F.count("lp_0").alias("n_known"), *[F.coalesce(F.sum(f"lp_{i}"), F.lit(0.0)).alias(f"s_{i}") for i in range(k)]))


def nb_argmax(model: NBModel, key: str, sums: DataFrame) -> DataFrame:
    """(key, pred, score, n_known) of the summed log-probabilities ``sums`` (key, n_known, s_0 .. s_{k-1})."""
    k = len(model.labels)
    scores = [F.col(f"s_{i}") + F.lit(model.priors[l]) for i, l in enumerate(model.labels)]
    sc = sums.select(key, "n_known", *[s.alias(f"t_{i}") for i, s in enumerate(scores)])
    mx = F.greatest(*[F.col(f"t_{i}") for i in range(k)]) if k > 1 else F.col("t_0")
    sc = sc.withColumn("mx", mx)
    pred = F.coalesce(*[F.when(F.col(f"t_{i}") == F.col("mx"), F.lit(l)) for i, l in enumerate(model.labels)])
    denom = sum((F.exp(F.col(f"t_{i}") - F.col("mx")) for i in range(k)), F.lit(0.0))
    return sc.select(key, pred.alias("pred"), (F.lit(1.0) / denom).alias("score"), "n_known")


# ---------------------------------------------------------------- texts of an array

#: So many words of a model or lexicon are sent to every task.
MAX_SENT_WORDS = 500_000


def word_slices(rows, size: int = 1 << 20):
    """Rows of an Arrow array<array<string>> in slices of whole rows of about ``size`` words."""
    if not len(rows):
        return
    words = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(rows.flatten()), 0).to_numpy(zero_copy_only=False))])
    ends = words[np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))]
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, rows.slice(at, end - at)
        at = end


def text_words(rows):
    """Of an Arrow array<array<string>>: number of the first text of every row (and the number of texts), the texts,
    the text of every word, and the words as a dictionary with indices."""
    first = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))])
    texts = rows.flatten()
    of = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False))
    d = texts.flatten().dictionary_encode()
    return first, texts, of, d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False)


def listed(rows, first, fields: dict):
    """Arrow array<struct<fields>> with as many elements a row as ``first`` tells, null where ``rows`` is."""
    values = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), values, mask=rows.is_null() if rows.null_count else None)


def categories_inside(model: NBModel, df: DataFrame, key: str, texts_col: str, max_words: int = MAX_SENT_WORDS) -> DataFrame:
    """``df`` with ``categories``: (category, category_score) of every text of the array ``texts_col``.

    The words that weigh most are sent to every task. Of a larger model the other words are looked up by a join with
    their few occurrences, and what they add comes back once a row: ``key`` must be unique and not null.
    """
    spark, k = df.sparkSession, len(model.labels)
    ship_package(spark)
    lps = [model.col(i) for i in range(k)]
    weight = F.greatest(*lps) if k > 1 else F.col(lps[0])
    n = model.table.count()
    bound = None
    if n > max_words:
        bound = model.table.select(weight.alias("w")).approxQuantile("w", [1 - max_words / n], 0.001)[0]
    t = (model.table if bound is None else model.table.where(weight > bound)).toArrow()
    sent = spark.sparkContext.broadcast(({w: i for i, w in enumerate(t.column("feature").to_pylist())},
                                         [t.column(c).to_numpy() for c in lps]))
    labels, priors = [str(x) for x in model.labels] + [UNKNOWN_CATEGORY], [model.priors[x] for x in model.labels]

    @F.arrow_udf("array<struct<pos:int,feature:string>>")
    def rare(tokens: pa.Array) -> pa.Array:
        index, found = sent.value[0], [pa.array([], pa.list_(pa.struct([("pos", pa.int32()), ("feature", pa.string())])))]
        for _, rows in word_slices(tokens):
            first, texts, of, words, codes = text_words(rows)
            row = np.repeat(np.arange(len(rows)), np.diff(first))
            here = np.array([w not in index for w in words], bool)[codes]
            text, codes = of[here], codes[here]
            ends = np.cumsum(np.bincount(row[text], minlength=len(rows)))
            found.append(listed(rows, np.concatenate([[0], ends]), {
                "pos": pa.array(text - first[row[text]], pa.int32()), "feature": pa.array(words, pa.string()).take(pa.array(codes))}))
        return pa.concat_arrays(found)

    @F.arrow_udf("array<struct<category:string,category_score:double>>")
    def scored(tokens: pa.Array, others: pa.Array) -> pa.Array:
        index, table = sent.value
        found = [pa.array([], pa.list_(pa.struct([("category", pa.string()), ("category_score", pa.float64())])))]
        for at, rows in word_slices(tokens):
            first, texts, of, words, codes = text_words(rows)
            at_word = np.array([index.get(w, -1) for w in words], np.int64)[codes]
            of, at_word = of[at_word >= 0], at_word[at_word >= 0]
            sums = np.stack([np.bincount(of, lp[at_word], len(texts)) for lp in table]).astype(float)   # of no words: whole numbers
            far = others.slice(at, len(rows))
            if far.null_count < len(far):
                row = np.repeat(np.arange(len(rows)), pc.fill_null(pc.list_value_length(far), 0).to_numpy(zero_copy_only=False))
                pos, *more = far.flatten().flatten()
                text = first[row] + pos.to_numpy()
                sums += np.stack([np.bincount(text, lp.to_numpy(), len(texts)) for lp in more])
            sums += np.array(priors)[:, None]
            most = sums.max(axis=0)
            blank = texts.is_null().to_numpy(zero_copy_only=False)
            found.append(listed(rows, first, {
                "category": pa.array(labels).take(pa.array(np.where(blank, k, sums.argmax(axis=0)))),
                "category_score": pa.array(np.where(blank, 0.0, 1.0 / np.exp(sums - most).sum(axis=0)))}))
        return pa.concat_arrays(found)

    tokens = F.transform(texts_col, lambda x: F.when(has_text(x), word_tokens(x)))
    if bound is None:
        none = F.lit(None).cast(f"array<struct<pos:int,{','.join(f'{c}:double' for c in lps)}>>")
        return df.withColumn("categories", scored(tokens, none))
    hits = (df.select(key, F.explode(rare(tokens)).alias("r")).select(key, "r.pos", "r.feature")
            .join(model.table.where(weight <= bound), "feature"))
    others = hits.groupBy(key).agg(F.collect_list(F.struct("pos", *lps)).alias("_others"))
    return df.join(others, key, "left").withColumn("categories", scored(tokens, F.col("_others"))).drop("_others")


def polarities_inside(df: DataFrame, lexicon: DataFrame, key: str, texts_col: str, max_entries: int = MAX_SENT_WORDS) -> DataFrame:
    """``df`` with ``polarities``: (score, polarity) of every text of the array ``texts_col``. The lexicon is sent to
    every task; one of over ``max_entries`` entries is joined with the exploded texts (``key`` unique and not null)."""
    spark = df.sparkSession
    ship_package(spark)
    t = lexicon.groupBy("entry").agg(F.sum(F.col("sign").cast("double")).alias("sign")).limit(max_entries + 1).toArrow()
    if t.num_rows > max_entries:
        ck = F.struct(key, "pos").alias("_ck")
        each = df.select(key, F.posexplode(texts_col).alias("pos", "text")).select(ck, "text")
        found = lexicon_polarity(each, lexicon, "_ck", "text").groupBy(F.col(f"_ck.{key}").alias(key)).agg(
            F.sort_array(F.collect_list(F.struct("_ck.pos", "score", "polarity"))).alias("_all"))
        some = F.transform("_all", lambda x: F.struct(x["score"].alias("score"), x["polarity"].alias("polarity")))
        return df.join(found, key, "left").withColumn("polarities", F.when(F.size(texts_col) == 0, F.array().cast(
            "array<struct<score:bigint,polarity:string>>")).otherwise(some)).drop("_all")
    sent = spark.sparkContext.broadcast({w: x or 0.0 for w, x in zip(t.column("entry").to_pylist(), t.column("sign").to_pylist())})

    @F.arrow_udf("array<struct<score:bigint,polarity:string>>")
    def scored(tokens: pa.Array) -> pa.Array:
        signs, found = sent.value, [pa.array([], pa.list_(pa.struct([("score", pa.int64()), ("polarity", pa.string())])))]
        for _, rows in word_slices(tokens):
            first, texts, of, words, codes = text_words(rows)
            near = np.arange(len(of)) - np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))])[of]    # words before it
            doubled = np.roll(np.array([w in INTENSIFIERS for w in words], bool)[codes], 1) & (near > 0)
            no = np.array([w in NEGATIONS for w in words], bool)[codes]
            negated = np.roll(no, 1) & (near > 0) | np.roll(no, 2) & (near > 1)
            w = np.array([signs.get(w, 0.0) for w in words], float)[codes] * np.where(doubled, 2, 1) * np.where(negated, -1, 1)
            score = np.trunc(np.bincount(of, w, len(texts))).astype(np.int64)
            found.append(listed(rows, first, {
                "score": pa.array(score), "polarity": pa.array(["Negative", "Neutral", "Positive"]).take(pa.array(np.sign(score) + 1))}))
        return pa.concat_arrays(found)

    return df.withColumn("polarities", scored(F.transform(texts_col, polarity_tokens)))


# ---------------------------------------------------------------- language gate

def has_text(col) -> Column:
    """True when anything but whitespace is in the text (null: null)."""
    return (F.col(col) if isinstance(col, str) else col).rlike(r"\S")


def trigram_slices(texts, size: int = 1 << 20):
    """Trigrams of an Arrow array of lower-cased texts, in slices of whole texts of about ``size`` characters:
    (first row, rows, row within the slice and packed code points of every trigram)."""
    rows = [t or "" for t in texts.to_pylist()]
    at = 0
    while at < len(rows):
        end, chars = at, 0
        while end < len(rows) and (end == at or chars + len(rows[end]) <= size):
            chars += len(rows[end])
            end += 1
        of = np.repeat(np.arange(end - at, dtype=np.int32), [len(t) for t in rows[at:end]])
        c = np.frombuffer("".join(rows[at:end]).encode("utf-32-le"), "<u4").astype(np.int64)
        whole = of[:-2] == of[2:]
        yield at, end - at, of[:-2][whole], (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[whole]
        at = end


def trigram_text(keys: np.ndarray) -> list[str]:
    """The trigrams of packed code points."""
    c = np.stack([keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF], axis=1).astype("<u4")
    text = c.tobytes().decode("utf-32-le")
    return [text[i:i + 3] for i in range(0, len(text), 3)]


def trigram_keys(features: list[str]) -> np.ndarray:
    """Packed code points of trigrams."""
    c = np.frombuffer("".join(features).encode("utf-32-le"), "<u4").astype(np.int64).reshape(-1, 3)
    return c[:, 0] << 42 | c[:, 1] << 21 | c[:, 2]


def trigram_counts(df: DataFrame, label_col: str, text_col: str) -> DataFrame:
    """(label, feature, c): trigrams counted by Arrow batches in the tasks, one row per batch slice,
    label and distinct trigram is shuffled."""
    ship_package(df.sparkSession)

    def run(batches):
        for b in batches:
            labels = b.column(0).dictionary_encode()
            codes = labels.indices.fill_null(len(labels.dictionary)).to_numpy(zero_copy_only=False)
            for first, n, of, keys in trigram_slices(b.column(1)):
                code = codes[first:first + n]
                for x in np.unique(code):
                    found, c = np.unique(keys[(code == x)[of]], return_counts=True)
                    label = pa.nulls(len(found), labels.type.value_type) if x == len(labels.dictionary) else \
                        labels.dictionary.take(pa.array(np.full(len(found), x, np.int32)))
                    yield pa.RecordBatch.from_arrays([label, pa.array(trigram_text(found), pa.string()), pa.array(c, pa.int64())],
                                                     names=["label", "feature", "c"])

    schema = T.StructType([T.StructField("label", df.schema[label_col].dataType), T.StructField("feature", T.StringType()),
                           T.StructField("c", T.LongType())])
    part = df.select(F.col(label_col).alias("label"), F.lower(text_col)).mapInArrow(run, schema)
    return part.groupBy("label", "feature").agg(F.sum("c").alias("c"))


def predict_trigrams(model: NBModel, df: DataFrame, key: str, text_col: str, max_table_bytes: int = 64 << 20) -> DataFrame:
    """``predict_nb`` over the trigrams of ``text_col``: summed inside each row by Arrow batches, with the table
    sent to every task. A table of over ``max_table_bytes`` is joined with the exploded trigrams instead."""
    k = len(model.labels)
    if 8 * (k + 1) * model.table.count() > max_table_bytes:
        return predict_nb(model, df, key, char_trigrams(text_col))
    spark = df.sparkSession
    ship_package(spark)
    t = model.table.toArrow()
    sent = spark.sparkContext.broadcast((trigram_keys(t.column("feature").to_pylist()),
                                         [t.column(model.col(i)).to_numpy() for i in range(k)]))

    def run(batches):
        keys, lps = sent.value
        index = pd.Index(keys)
        for b in batches:
            for first, n, of, found in trigram_slices(b.column(1)):
                at = index.get_indexer(found)
                of, at = of[at >= 0], at[at >= 0]
                sums = [np.bincount(of, weights=lp[at], minlength=n) for lp in lps]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, n), pa.array(np.bincount(of, minlength=n), pa.int64()), *[pa.array(x, pa.float64()) for x in sums]],
                    names=[key, "n_known", *[f"s_{i}" for i in range(k)]])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_known", T.LongType()),
                           *[T.StructField(f"s_{i}", T.DoubleType()) for i in range(k)]])
    rows = df.select(key, F.lower(text_col)).mapInArrow(run, schema)
    return nb_argmax(model, key, rows.groupBy(key).agg(
        F.sum("n_known").alias("n_known"), *[F.sum(f"s_{i}").alias(f"s_{i}") for i in range(k)]))


def fit_language_model(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> NBModel:
    return nb_of_counts(df, lang_col, trigram_counts(df, lang_col, text_col))


def detect_language(model: NBModel, df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, pred_lang): blank text -> '' (the detector has nothing to read)."""
    p = predict_trigrams(model, df.where(has_text(text_col)), key, text_col)
    blanks = df.where(~F.coalesce(has_text(text_col), F.lit(False))).select(
        key, F.lit("").alias("pred_lang"))
    return p.select(key, F.col("pred").alias("pred_lang")).unionByName(blanks)


def language_gate(model: NBModel, df: DataFrame, key: str, text_col: str = "text",
                  target: str = "en", written: bool = False) -> DataFrame:
    """Adds ``is_target``: detected language equals ``target`` (failure/blank = False). ``written``: the languages are
    written once, for callers that read the result several times, and texts stay where they are if these rows are few."""
    det = detect_language(model, df, key, text_col)
    if written:
        det = sized_broadcast(cut_lineage(det))
    return df.join(det, key, "left").withColumn(
        "is_target", F.coalesce(F.col("pred_lang") == target, F.lit(False)))


def route_translation(gated: DataFrame, text_col: str = "text") -> DataFrame:
    """English and blank rows pass through; the rest are routed to the translator.
    Adds ``route`` ('pass' / 'translate') and ``to_translate`` (text or null),
    so only non-English distinct texts reach the model stage."""
    passes = F.col("is_target") | (strip_ws(F.coalesce(F.col(text_col), F.lit(""))) == "")
    return gated.withColumns({
        "route": F.when(passes, F.lit("pass")).otherwise(F.lit("translate")),
        "to_translate": F.when(~passes, F.col(text_col)),
    })


# ---------------------------------------------------------------- splits and indexes

def label_index(df: DataFrame, col: str) -> DataFrame:
    """(label, label_id): alphabetical, 0-based. The distinct label set is one
    row per class, so ranking it in a single task is cheap."""
    d = df.select(F.col(col).alias("label")).where(F.col("label").isNotNull()).distinct()
    return d.withColumn("label_id", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("int"))


def stable_hash(id_col, seed: int) -> Column:
    """Deterministic 32-bit mix of a non-negative integer id (same in SQL)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.pmod(c, F.lit(2147483647)) * F.lit(2654435761) + F.lit(seed), F.lit(4294967296))


def stratified_split(df: DataFrame, label: str, id_col: str, test_frac: float = 0.1,
                     seed: int = 42, n_buckets_bits: int = 20) -> DataFrame:
    """Exact stratified split: per class the ``ceil(frac * n)`` rows with the
    smallest (hash, id) form the test set.

    Skew-safe: rows are bucketed on the high bits of the hash, bucket counts
    per class (a small table) locate each class's boundary bucket, and only
    rows inside that one bucket are ranked exactly. No task ever sorts a whole
    class. Adds ``split`` ('test' / 'train').
    """
    shift = 32 - n_buckets_bits
    h = stable_hash(id_col, seed)
    rows = df.withColumns({"_h": h, "_b": F.shiftright(h, shift)})
    counts = rows.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    per_label = Window.partitionBy(label)
    cum = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"_tot": F.sum("_n").over(per_label), "_cum": F.sum("_n").over(cum)})
    counts = counts.withColumn("_k", F.ceil(F.col("_tot") * F.lit(test_frac)).cast("long"))
    bound = counts.where((F.col("_cum") - F.col("_n") < F.col("_k")) & (F.col("_cum") >= F.col("_k"))) \
        .select(label, F.col("_b").alias("_bb"), (F.col("_k") - (F.col("_cum") - F.col("_n"))).alias("_need"))
    # one boundary row per class: bounded by the class count
    j = rows.join(sized_broadcast(bound, 1_000_000), label, "left")
    inside = j.where(F.col("_b") == F.col("_bb"))
    rk = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", id_col))
    inside = inside.withColumn("split", F.when(rk <= F.col("_need"), "test").otherwise("train"))
    outside = j.where(F.col("_bb").isNull() | (F.col("_b") != F.col("_bb"))).withColumn(
        "split", F.when(F.col("_bb").isNotNull() & (F.col("_b") < F.col("_bb")), "test").otherwise("train"))
    return inside.unionByName(outside).drop("_h", "_b", "_bb", "_need")


# ---------------------------------------------------------------- prediction decoding

def predict_category(model: NBModel, df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, category, category_score): NB argmax over word tokens with its
    softmax probability; blank text -> 'Unknown', 0.0. For an array of texts:
    ``df`` with their ``categories`` (``categories_inside``)."""
    if isinstance(df.schema[text_col].dataType, T.ArrayType):
        return categories_inside(model, df, key, text_col)
    blank = strip_ws(F.coalesce(F.col(text_col), F.lit(""))) == ""
    p = predict_nb(model, df.where(~blank), key, word_tokens(text_col))
    out = p.select(key, F.col("pred").alias("category"), F.col("score").alias("category_score"))
    b = df.where(blank).select(key, F.lit(UNKNOWN_CATEGORY).alias("category"),
                               F.lit(0.0).alias("category_score"))
    return out.unionByName(b)


def decode_polarity(preds, clause) -> Column:
    """struct(polarity, polarity_score) from array<struct(label, score)>:
    the first highest-scoring entry; LABEL_n via the id map, other labels
    capitalised; score rounded to 4; blank clause or no prediction -> Neutral, 0.0."""
    arr = F.col(preds) if isinstance(preds, str) else preds
    init = F.try_element_at(arr, F.lit(1))
    top = F.aggregate(arr, init, lambda acc, x: F.when(x["score"] > acc["score"], x).otherwise(acc))
    raw = F.coalesce(top["label"], F.lit(NEUTRAL))
    lab_id = F.regexp_extract(raw, r"^LABEL_(\d+)$", 1)
    id_map = F.create_map(*[v for k, lab in POLARITY_LABELS.items() for v in (F.lit(k), F.lit(lab))])
    mapped = F.when(raw.startswith("LABEL_"),
                    F.coalesce(F.try_element_at(id_map, lab_id.try_cast("int")), F.lit(NEUTRAL))) \
        .otherwise(capitalize(raw))
    mapped = F.when(mapped == "", F.lit(NEUTRAL)).otherwise(mapped)
    c = F.col(clause) if isinstance(clause, str) else clause
    blank = strip_ws(F.coalesce(c.cast("string"), F.lit(""))) == ""
    failed = top.isNull()
    return F.struct(
        F.when(blank | failed, F.lit(NEUTRAL)).otherwise(mapped).alias("polarity"),
        F.when(blank | failed, F.lit(0.0)).otherwise(F.round(top["score"].cast("double"), 4)).alias("polarity_score"))


#: The end of wasn't, don't and the like, with the character behind it.
CONTRACTED = "n['\u2019]t([^a-z]|$)"


def polarity_tokens(text: Column) -> Column:
    """Lower-cased runs of a-z, contracted negations spelt out."""
    spelt = F.regexp_replace(F.lower(text), CONTRACTED, " not$1")
    return F.regexp_extract_all(spelt, F.lit("[a-z]+"), 0)


def lexicon_polarity(df: DataFrame, lexicon: DataFrame, key: str, text_col: str,
                     max_broadcast_rows: int = 5_000_000) -> DataFrame:
    """Signed lexicon score with intensifier and negation context.

    Each token carries its two predecessors (taken inside the row, no window),
    hits are found by an equi-join with the (size-checked broadcast) lexicon
    (entry, sign), and summed per review with partial aggregation.
    Token weight = sign * 2 if the previous token is an intensifier, negated
    when one of the two previous tokens is a negation; a contracted one
    (``wasn't``) counts as its verb and ``not``. Output: (key, score, polarity);
    for an array of texts: ``df`` with their ``polarities`` (``polarities_inside``).
    """
    if isinstance(df.schema[text_col].dataType, T.ArrayType):
        return polarities_inside(df, lexicon, key, text_col)
    toks = polarity_tokens(F.col(text_col))
    nul = F.lit(None).cast("string")
    # each token zipped with its two predecessors (shifted copies of the array)
    ctx = F.arrays_zip(toks.alias("entry"), F.concat(F.array(nul), toks).alias("p1"),
                       F.concat(F.array(nul, nul), toks).alias("p2"))
    ctx = F.filter(ctx, lambda s: s["entry"].isNotNull())
    ex = df.select(key, F.explode_outer(ctx).alias("t")).select(key, "t.entry", "t.p1", "t.p2")
    lex = sized_broadcast(lexicon.select("entry", "sign"), max_broadcast_rows)
    j = ex.join(lex, "entry", "left")
    neg = F.col("p1").isin(NEGATIONS) | F.col("p2").isin(NEGATIONS)
    w = F.col("sign") * F.when(F.col("p1").isin(INTENSIFIERS), 2).otherwise(1) * F.when(neg, -1).otherwise(1)
    s = j.groupBy(key).agg(F.coalesce(F.sum(w), F.lit(0)).cast("long").alias("score"))
    return s.withColumn("polarity", F.when(F.col("score") > 0, "Positive")
                        .when(F.col("score") < 0, "Negative").otherwise("Neutral"))


def frequent_token_lexicon(df: DataFrame, text_col: str, k: int = 40) -> DataFrame:
    """(entry, sign): the ``k`` most frequent lower-case tokens (ties by token),
    sign +1 on odd rank and -1 on even rank. Size is bounded by ``k``."""
    toks = df.select(F.explode(F.filter(F.split(F.lower(F.col(text_col)), r"[^a-z]+"),
                                        lambda x: x != "")).alias("entry"))
    top = toks.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entry").limit(k)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "entry")))
    return ranked.select("entry", F.when(F.col("rank") % 2 == 1, 1).otherwise(-1).alias("sign"))


# ---------------------------------------------------------------- nearest centroid

def centroids(df: DataFrame, label: str, vec: str) -> DataFrame:
    """(label, dim, mean): per-class mean vector in long form."""
    ex = df.select(label, F.posexplode(vec).alias("dim", "x"))
    return ex.groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def nearest_centroid(df: DataFrame, label: str, vec: str, key: str, block_bytes: int = 8 << 20) -> DataFrame:
    """Predict the class whose centroid has the highest cosine (ties -> lowest label).

    Centroids lie in blocks of about ``block_bytes``. A single block is
    broadcast and vectors are scored where they are. Of several, each is dealt
    over as many tasks as a shuffle has, distinct vectors meet every block, and
    only the best class of each block is shuffled for the last comparison.
    A vector that no centroid can be compared with gets the lowest label.
    """
    cells = cut_lineage(centroids(df.where(F.col(label).isNotNull()), label, vec))
    n = max(1, math.ceil(8 * cells.count() / block_bytes))
    by_dim = F.transform(F.sort_array(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"])
    classes = cells.groupBy(F.col(label).alias("_label")).agg(by_dim.alias("c"))
    blocks = classes.groupBy(F.pmod(F.xxhash64("_label"), F.lit(n)).cast("int").alias("_block")).agg(
        F.collect_list(F.struct(F.col("_label").alias("label"), "c")).alias("_classes"))
    v = F.col(vec)

    def cos(c):
        dot = F.aggregate(F.zip_with(v, c, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, t: s + t)
        nv = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        nc = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
        return F.try_divide(dot, nv * nc)

    # the least of (negative cosine, label)
    best = F.array_min(F.transform("_classes", lambda e: F.struct(
        (-F.coalesce(cos(e["c"]), F.lit(-2.0))).alias("loss"), e["label"].alias("label")))).alias("_best")
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_block")
    if n == 1:
        return df.select(key, label, vec, every).join(F.broadcast(blocks), "_block", "left").select(
            key, label, best).select(key, label, F.col("_best.label").alias("pred_label"))
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.groupBy(key, label, vec).agg(F.count(F.lit(1)).alias("_n")).select(
        "*", every, F.pmod(F.xxhash64(key, vec), F.lit(salts)).cast("int").alias("_salt"))
    dealt = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = rows.join(dealt, ["_block", "_salt"], "left").select(key, label, F.xxhash64(vec).alias("_vec"), "_n", best)
    return (found.groupBy(key, label, "_vec", "_n").agg(F.min("_best").alias("_best"))
            .select(key, label, F.col("_best.label").alias("pred_label"), F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int"))).alias("_i"))
            .drop("_i"))


# ---------------------------------------------------------------- logistic regression

def fit_text_lr(df: DataFrame, text_col: str, label_col: str, num_features: int = 1 << 18,
                max_iter: int = 30, reg: float = 0.01):
    """Text classifier as a Spark ML pipeline: tokens -> hashed term counts ->
    IDF -> multinomial logistic regression. Labels are indexed alphabetically.
    Hashing keeps the feature space fixed, so nothing grows with the vocabulary. Returns the fitted pipeline."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer

    rows = df.where(F.col(label_col).isNotNull())
    indexer = StringIndexer(inputCol=label_col, outputCol="_label", stringOrderType="alphabetAsc",
                            handleInvalid="skip").fit(rows)
    tokens = RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=r"[^\p{L}\p{N}]+", toLowercase=True)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features)
    # texts are read once; every pass of the optimizer reads the counts, and each of their partitions sends a dense
    # gradient: a few partitions a core, more only for tables of many partitions
    counted = cut_lineage(tf.transform(tokens.transform(indexer.transform(rows))).select("_label", "_tf"))
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, counted.rdd.getNumPartitions() // 8)
    counted = counted.coalesce(parts)
    idf = IDF(inputCol="_tf", outputCol="_features").fit(counted)
    lr = LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=max_iter, regParam=reg,
                            family="multinomial").fit(idf.transform(counted))
    return PipelineModel(stages=[indexer, tokens, tf, idf, lr])


def predict_text_lr(model, df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, category, category_score): predicted label and its probability;
    blank text -> 'Unknown', 0.0."""
    from pyspark.ml.functions import vector_to_array

    from pyspark.ml import PipelineModel

    labels = model.stages[0].labels
    blank = strip_ws(F.coalesce(F.col(text_col), F.lit(""))) == ""
    # scoring needs no label column: skip the label indexer stage
    scorer = PipelineModel(stages=model.stages[1:])
    scored = scorer.transform(df.where(~blank).select(key, text_col))
    lab = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1)
    out = scored.select(key, lab.alias("category"),
                        F.array_max(vector_to_array("probability")).alias("category_score"))
    b = df.where(blank).select(key, F.lit(UNKNOWN_CATEGORY).alias("category"), F.lit(0.0).alias("category_score"))
    return out.unionByName(b)
