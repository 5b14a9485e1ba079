"""Reporting aggregates over scored results: category x polarity cube and
rollup, term weights for a word cloud, result filters, score summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetlens.functions.text import clean_text

# Score buckets used to derive a polarity from a numeric score.
POLARITY_BUCKETS = [(20.0, "Negative"), (60.0, "Neutral")]
TOP_BUCKET = "Positive"


def bucket_polarity(col):
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for bound, name in POLARITY_BUCKETS:
        expr = F.when(c < bound, F.lit(name)) if expr is None else expr.when(c < bound, F.lit(name))
    return expr.otherwise(F.lit(TOP_BUCKET))


def summary_cube(df: DataFrame, dims=("category", "polarity"), score: str | None = "score",
                 rollup: bool = False) -> DataFrame:
    """Counts (and mean score) for every combination of ``dims`` plus subtotals;
    ``grouping_id`` tells a subtotal row from a real null."""
    g = df.rollup(*dims) if rollup else df.cube(*dims)
    aggs = [F.grouping_id().alias("grouping_id"), F.count(F.lit(1)).alias("n")]
    if score:
        aggs.append(F.round(F.avg(score), 6).alias("mean_score"))
    return g.agg(*aggs)


def term_weights(df: DataFrame, text_col: str, k: int = 50) -> DataFrame:
    """Top-k cleaned tokens with count and weight = count / top count.

    The count is a partial+final hash aggregate; the top-k is a distributed
    take-ordered (ties by token). The weight needs only the top count, which
    is inside the k rows, so no global window runs over the token table.
    """
    toks = df.select(F.explode(F.split(clean_text(F.col(text_col)), " ")).alias("token")) \
        .where(F.col("token") != "")
    counts = toks.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc("token")).limit(k)
    # the window runs over the k result rows only
    mx = F.max("n").over(Window.partitionBy())
    return top.select("token", "n", F.round(F.col("n") / mx, 6).alias("weight"))


def filter_results(df: DataFrame, categories: list[str] | None = None, polarity: str | None = None) -> DataFrame:
    cond = F.lit(True)
    if categories:
        cond = cond & F.col("category").isin(categories)
    if polarity:
        cond = cond & (F.col("polarity") == polarity)
    return df.where(cond)


def score_summary(df: DataFrame, cls: str, score: str) -> DataFrame:
    """Per class: rows, mean score, share of all rows. The share's total is a
    window over the aggregated class rows (one row per class), not over the data."""
    per = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("mean_score"))
    total = F.sum("n").over(Window.partitionBy())
    return per.select(cls, "n", "mean_score", F.round(F.col("n") / total, 6).alias("share"))
