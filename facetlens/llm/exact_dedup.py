"""Operator 8: exact dedup by content sort, in DataFrame operations only.

Normalised texts are range-partitioned by sampled splitters and sorted inside
each partition, which puts equal texts next to each other; a window over the
sorted rows compares neighbours in full and keeps the smallest identifier.
Texts with so many copies that one task should not hold them (found by exact
counts of all rows) are spread over several ranges by a salt, and their few
per-salt results are merged afterwards.

Defined results: null text equals the empty text; a null ``doc_id`` sorts after
all others; of rows with equal text and equal ``doc_id`` exactly one stays;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, kept_table, partitions


def normalised(text: str):
    """White-space runs become one space; a single plain space needs no rewrite."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")),
                            r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    parts = partitions(spark)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normalised("text").alias("body"))
    base = base.withColumn("h", F.xxhash64("body"))
    counts = kept_table(base.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = docs.count()
    hot = hot_keys(counts, "h", total, parts)
    salted = (base.join(F.broadcast(hot), "h", "left")
              .withColumn("salt", F.when(F.col("n_salts").isNull(), F.lit(0))
                          .otherwise(F.pmod(F.xxhash64("doc_id"), F.col("n_salts")).cast("int") + 1))
              .withColumn("head", F.substring("body", 1, 48)).drop("n_salts"))
    # splitters are sampled from the leading characters (a hash splits texts that share
    # them), so that the sample the driver draws stays small; full texts are compared below
    equal = ["head", "h", "salt", "body"]
    ordered = (salted.repartitionByRange(parts, "head", "h", "salt")
               .sortWithinPartitions(*equal, F.asc_nulls_last("doc_id")))
    run = Window.partitionBy(*equal).orderBy(F.asc_nulls_last("doc_id"))
    whole = Window.partitionBy(*equal)
    found = kept_table(ordered.select(
        "doc_id", "salt", F.sha2("body", 256).alias("text_sha256"),
        F.row_number().over(run).alias("nth"),
        F.first("doc_id").over(run).alias("low"),
        F.count(F.lit(1)).over(whole).alias("copies")))
    # one row per salt of a hot text: at most 16 * parts rows
    merged = (found.where("salt > 0 and nth = 1").groupBy("text_sha256")
              .agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "salt")).alias("best"),
                   F.sum("copies").alias("all_copies")))
    out = found.join(F.broadcast(merged), "text_sha256", "left")
    return out.select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("low")).otherwise(F.col("best.low")).alias("keep_id"),
        F.coalesce("all_copies", "copies").alias("group_size"),
        ((F.col("nth") == 1) & (F.col("best").isNull() | (F.col("best.salt") == F.col("salt")))).alias("kept"),
        "text_sha256")


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(body) AS text_sha256
FROM n
"""
