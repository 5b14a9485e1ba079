"""Shared helpers of the training-data operators."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlens.session import cut_lineage, ensure_checkpoint_dir, ship_package

#: Runs of these characters separate words everywhere in this subpackage.
SPACES = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: Column | str, mod: int, rest: int) -> Column:
    """True when crc32(doc_id as text) mod ``mod`` is ``rest``; a null id is never held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % mod == rest, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept_table(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    return cut_lineage(df)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def hot_keys(counts: DataFrame, key: str, total: int, parts: int, least: int = 64) -> DataFrame:
    """Keys so frequent that one task should not hold them, with a number of salts each.

    ``counts`` has (key, n). A key is hot above ``max(least, total / (8 * parts))``
    rows, so at most ``8 * parts`` keys are hot however large the input is: the
    result may be broadcast.
    """
    bound = max(least, math.ceil(total / (8 * parts)))
    return (counts.where(F.col("n") > bound)
            .select(key, F.ceil(F.col("n") / bound).cast("int").alias("n_salts")))


def small_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Let no Arrow batch to a Python worker exceed about ``size`` bytes (and one row), unless the cluster sets its own bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, str(size))


def python_ready(spark: SparkSession) -> None:
    """Ship the library to the executors before Python stages use it."""
    ship_package(spark)
