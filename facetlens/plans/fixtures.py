"""Pair frames (gold vs prediction / rater a vs rater b) derived from the
driver tables. Every frame is computed from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetlens.sources.readers import load_table

# The nine function words used for the text pair frame P4.
FUNCTION_WORDS = ["the", "and", "that", "for", "was", "with", "this", "are", "from"]


def previous_in_group(df: DataFrame, group: str, order: list[str], value: str,
                      bucket: F.Column, out: str = "prev") -> DataFrame:
    """Value of the previous row of the same group in ``order`` (null for the first).

    Skew-safe form of ``lag`` over ``partitionBy(group)``: rows are windowed
    per (group, time bucket), so a hot group is spread over many tasks. The
    first row of each bucket takes the last value of the group's nearest
    earlier bucket, found on a small (group, bucket) summary.
    """
    d = df.withColumn("_bk", bucket)
    w = Window.partitionBy(group, "_bk").orderBy(*order)
    d = d.withColumn(out, F.lag(value).over(w))
    last = d.groupBy(group, "_bk").agg(
        F.max_by(F.col(value), F.struct(*[F.col(c) for c in order])).alias("_last"))
    last = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(group).orderBy("_bk")))
    d = d.join(last.select(group, "_bk", "_carry"), [group, "_bk"], "left")
    first = F.row_number().over(w) == 1
    return d.withColumn(out, F.when(first, F.col("_carry")).otherwise(F.col(out))).drop("_bk", "_carry")


def p1_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1: gold = event_type, pred = previous event type of the same user
    (by ts, event_id); each user's first event is dropped."""
    ev = load_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    out = previous_in_group(ev, "user_id", ["ts", "event_id"], "event_type",
                            F.date_trunc("day", F.col("ts")), out="pred")
    return out.where(F.col("pred").isNotNull()).select(
        "event_id", "user_id", "ts", "value", F.col("event_type").alias("gold"), "pred")


def p2_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2: rater a = quality, rater b = 1 - toxic, per doc."""
    lb = load_table(spark, sf_dir, "labels")
    return lb.select("doc_id", F.col("quality").cast("string").alias("a"),
                     (F.lit(1) - F.col("toxic")).cast("string").alias("b"))


def p3_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3: text of turn t (gold) vs turn t+1 (pred) of the same conversation,
    paired by an equi-join on (conv_id, turn + 1)."""
    cv = load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = cv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred"))
    return cv.withColumnRenamed("text", "gold").join(nxt, ["conv_id", "turn"], "inner")


def p4_function_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4: all documents; gold = first function word in the first half of
    the token list, pred = same in the second half ('' when none)."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    toks = F.filter(F.split(F.lower(F.col("text")), "[^a-z]+"), lambda x: x != "")
    d = docs.select("doc_id", toks.alias("t")).withColumn("h", (F.size("t") / 2).cast("int"))
    fw = F.array(*[F.lit(w) for w in FUNCTION_WORDS])
    first_in = lambda arr: F.coalesce(
        F.try_element_at(F.filter(arr, lambda x: F.array_contains(fw, x)), F.lit(1)), F.lit(""))
    return d.select("doc_id",
                    first_in(F.slice("t", 1, F.col("h"))).alias("gold"),
                    first_in(F.slice("t", F.col("h") + 1, F.size("t"))).alias("pred"))


def p7_absa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation frame with term / opinion / category / polarity and their
    predictions, built on P1: the previous event plays the prediction."""
    ev = load_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    st = F.struct("event_type", "value", "props")
    out = previous_in_group(ev.withColumn("s", st), "user_id", ["ts", "event_id"], "s",
                            F.date_trunc("day", F.col("ts")), out="p")
    out = out.where(F.col("p").isNotNull())
    from facetlens.operators.reporting import bucket_polarity
    return out.select(
        "event_id",
        F.concat_ws(" ", F.col("event_type"), F.col("user_id").cast("string")).alias("term"),
        F.col("props").alias("opinion"),
        F.initcap("event_type").alias("category"),
        bucket_polarity("value").alias("polarity"),
        F.concat_ws(" ", F.col("p.event_type"), F.col("user_id").cast("string")).alias("pred_term"),
        F.col("p.props").alias("pred_opinion"),
        F.col("p.event_type").alias("pred_category"),
        bucket_polarity(F.col("p.value")).alias("pred_polarity"),
        F.col("event_type").alias("clause"))
