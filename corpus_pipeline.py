"""Training-corpus pipeline: five stages, each written as Parquet and read again by the next.

quality classifier -> language identification -> exact dedup -> near-duplicate
join -> packing. The first four return the columns of ``documents``; the last
returns one row per packed piece. Every stage works on all rows its predecessor
kept. Extra columns are passed on unchanged; a null ``doc_id`` is never joined,
so such rows are judged by their text alone and pass the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlens.llm.common import free_name, kept_table, read, shared_path, small_batches
from facetlens.llm.exact_dedup import exact_dedup, normalised
from facetlens.llm.language import fit_language, language_of
from facetlens.llm.packing import pack
from facetlens.llm.quality import fit_quality, quality_score
from facetlens.llm.shingle_join import jaccard_components

QUALITY = 0.7        # documents that score lower are rejected
LANGUAGE = 0.2       # as are documents whose language is und or less certain than this
BROADCAST_ROWS = 1_000_000


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier scores below ``QUALITY``."""
    model = fit_quality(docs, read(spark, sf_dir, "labels"))
    return docs.where(quality_score(model, F.col("text")) >= QUALITY)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language (``und``) or with a very uncertain one."""
    found, name = language_of(fit_language(docs), F.col("text")), free_name(docs, "found_language")
    return (docs.withColumn(name, found).where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= LANGUAGE))
            .select(*docs.columns))


def without_rows(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """Rows whose (doc_id, ``key``) is not in ``gone`` (doc_id, key): an id may name several texts.

    A list of bounded size is broadcast, a larger one joined.
    """
    name, text = free_name(docs, "gone_id"), free_name(docs, "gone_text")
    gone = kept_table(gone.select(F.col("doc_id").alias(name), F.col("key").alias(text)).distinct())
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    same = (docs["doc_id"].cast("bigint") == F.col(name)) & (key == F.col(text))
    return docs.join(side, same, "left_anti").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest doc_id of every normalised text."""
    decided = kept_table(exact_dedup(docs))
    out = without_rows(docs, decided.where("not kept and doc_id <> keep_id")
                       .select("doc_id", F.xxhash64("text_sha256").alias("key")),
                       F.xxhash64(F.sha2(normalised("text"), 256)))
    # rows that repeat the very id that stays, and copies without an id, are told apart by their text only
    rest = decided.where("not kept and (doc_id is null or doc_id <=> keep_id)")
    if not rest.head(1):
        return out
    return _first_of_repeats(out, free_name(docs, "text_key"))


def _first_of_repeats(docs: DataFrame, h: str) -> DataFrame:
    """One row per id and text, and per text without an id; repeats are dropped before rows move, so no key is hot."""
    keyed = docs.withColumn(h, F.sha2(normalised("text"), 256))
    with_id = keyed.where("doc_id is not null").dropDuplicates(["doc_id", h])
    known = keyed.where("doc_id is not null").select(F.col(h).alias(h + "_")).distinct()
    without = keyed.where("doc_id is null").dropDuplicates([h]).join(known, F.col(h) == F.col(h + "_"), "left_anti")
    return with_id.unionByName(without).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of every group of near duplicates.

    If that id names several texts of the group, the one with the least hash stays.
    """
    found = kept_table(jaccard_components(docs, by_text=True).where("n_shingles > 0 and doc_id is not null")
                       .withColumnRenamed("text_key", "key"))
    first = found.where("doc_id = component_id").groupBy("component", "doc_id").agg(F.min("key").alias("least"),
                                                                                   F.max("key").alias("most"))
    tied = found.join(first.where("least < most"), ["component", "doc_id"]).where("key > least")
    gone = found.where("doc_id <> component_id").select("doc_id", "key").union(tied.select("doc_id", "key"))
    return without_rows(docs, gone, F.xxhash64(F.col("text").cast("string")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens; small caches and batches, since earlier stages left memory in use."""
    small_batches(spark)
    return pack(docs, max_words=200_000, chars=1_000_000)


STAGES = [("quality", keep_good_quality), ("language", keep_known_language), ("exact_dedup", drop_exact_copies),
          ("near_duplicates", drop_near_copies), ("packing", pack_sequences)]

#: Trained classifiers and byte-pair encoding are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; every result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
