"""Bounded labelled samples for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int | tuple[int, int], held_out) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` training rows of each class (a pair: of class 0 and of class 1).

    Rows are chosen by a hash of ``doc_id`` among the rows that are not held
    out; the chosen ids are few by that bound, so they are broadcast to the
    documents instead of shuffling texts. An id gives one row a class, with the
    least of its texts, however often documents or labels repeat it.
    """
    most = per_class if isinstance(per_class, tuple) else (per_class, per_class)
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("label")]
    chosen = None
    for value in (0, 1):
        one = known.where(F.col("label") == value).orderBy(*order).limit(most[value])
        chosen = one if chosen is None else chosen.unionAll(one)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
            .select("doc_id", "text", "label"))
