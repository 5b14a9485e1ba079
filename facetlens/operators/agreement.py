"""Inter-annotator agreement between two label columns joined on an item key.

One confusion aggregate feeds agreement, Cohen's kappa and the weighted
kappas. Expected agreement is computed from the two marginals with moment
and prefix-sum identities, so no label-pair table is ever enumerated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetlens.operators.metrics import NDIGITS, confusion
from facetlens.sources.readers import read_reviews

# Interpretation bands (upper bounds, exclusive) and names.
KAPPA_BANDS = [(0.0, "Poor agreement (worse than chance)"), (0.20, "Slight agreement"),
               (0.40, "Fair agreement"), (0.60, "Moderate agreement"),
               (0.80, "Substantial agreement")]
KAPPA_TOP_BAND = "Almost perfect agreement"


def _r(c: Column) -> Column:
    return F.round(c.cast("double"), NDIGITS)


def as_label(col, null_label: str | None = "nan") -> Column:
    """String label, lower-cased; a missing label becomes ``null_label``."""
    c = F.lower((F.col(col) if isinstance(col, str) else col).cast("string"))
    return F.coalesce(c, F.lit(null_label)) if null_label is not None else c


def load_labels(spark: SparkSession, path: str, column: str, out: str = "human_category",
                fmt: str = "csv") -> DataFrame:
    """One label column, renamed and lower-cased (null kept as null)."""
    if fmt not in ("csv", "parquet", "json"):
        raise ValueError(f"Unsupported file format: {path}")
    df = read_reviews(spark, path, fmt)
    return df.select(F.lower(F.col(column)).alias(out))


def stack_annotators(frames: dict[str, DataFrame], label_col: str = "human_category") -> DataFrame:
    """Vertical union of annotator frames with an ``annotator`` tag."""
    out = None
    for name, f in frames.items():
        t = f.select(F.lit(name).alias("annotator"), label_col)
        out = t if out is None else out.unionByName(t)
    return out


def rater_pairs(df: DataFrame, a: str, b: str, key: str, null_label: str | None = "nan") -> DataFrame:
    """(key, a, b) with labels normalized; rows with a missing label are
    dropped only when ``null_label`` is None."""
    out = df.select(key, as_label(a, null_label).alias("a"), as_label(b, null_label).alias("b"))
    return out if null_label is not None else out.where(F.col("a").isNotNull() & F.col("b").isNotNull())


def agreement(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("n"),
                     _r(F.avg((F.col("a") == F.col("b")).cast("double"))).alias("agreement"))


def _marginals(conf: DataFrame) -> DataFrame:
    """Per label of the union: row total r, column total c, diagonal d and the
    alphabetical label index."""
    rows = conf.groupBy(F.col("gold").alias("label")).agg(
        F.sum("n").alias("r"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("d"))
    cols = conf.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("c"))
    m = rows.join(cols, "label", "full_outer").select(
        "label", *[F.coalesce(x, F.lit(0)).cast("double").alias(x) for x in ("r", "c", "d")])
    # label sets are small (one row per class); ranking them needs no partitioning
    return m.withColumn("idx", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("double"))


def kappa_table(pairs: DataFrame) -> DataFrame:
    """One row: n, observed agreement, kappa, linear and quadratic weighted kappa.

    With N rows, row totals r_i and column totals c_j over label index i:
      unweighted  sum w*E = N - sum r_i c_i / N
      quadratic   sum w*E = (N sum r i^2 + N sum c j^2 - 2 sum r i * sum c j) / N
      linear      sum w*E = sum_i r_i (i C_<i - S_<i + S_>i - i C_>i) / N
    where C/S are prefix/suffix sums of c_j and j*c_j. Observed weighted
    disagreement uses the confusion cells directly.
    """
    conf = confusion(pairs, "a", "b").cache()
    m = _marginals(conf)
    before = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    m = m.withColumns({
        "c_lt": F.coalesce(F.sum("c").over(before), F.lit(0.0)),
        "s_lt": F.coalesce(F.sum(F.col("c") * F.col("idx")).over(before), F.lit(0.0)),
        "c_gt": F.coalesce(F.sum("c").over(after), F.lit(0.0)),
        "s_gt": F.coalesce(F.sum(F.col("c") * F.col("idx")).over(after), F.lit(0.0)),
    })
    marg = m.agg(
        F.sum("r").alias("N"), F.sum("d").alias("diag"), F.sum(F.col("r") * F.col("c")).alias("rc"),
        F.sum(F.col("r") * F.col("idx") * F.col("idx")).alias("r_i2"),
        F.sum(F.col("c") * F.col("idx") * F.col("idx")).alias("c_j2"),
        F.sum(F.col("r") * F.col("idx")).alias("r_i"), F.sum(F.col("c") * F.col("idx")).alias("c_j"),
        F.sum(F.col("r") * (F.col("idx") * F.col("c_lt") - F.col("s_lt") + F.col("s_gt")
                            - F.col("idx") * F.col("c_gt"))).alias("lin_e"))
    idx = m.select(F.col("label"), F.col("idx"))
    cells = (conf.join(idx.withColumnRenamed("label", "gold").withColumnRenamed("idx", "gi"), "gold")
             .join(idx.withColumnRenamed("label", "pred").withColumnRenamed("idx", "pi"), "pred"))
    obs = cells.agg(
        F.sum(F.when(F.col("gi") != F.col("pi"), F.col("n")).otherwise(0)).cast("double").alias("o_u"),
        F.sum(F.abs(F.col("gi") - F.col("pi")) * F.col("n")).cast("double").alias("o_l"),
        F.sum((F.col("gi") - F.col("pi")) * (F.col("gi") - F.col("pi")) * F.col("n")).cast("double").alias("o_q"))
    both = _one_row_join(marg, obs)
    n = F.col("N")
    e_u = n - F.col("rc") / n
    e_q = (n * F.col("r_i2") + n * F.col("c_j2") - 2 * F.col("r_i") * F.col("c_j")) / n
    e_l = F.col("lin_e") / n
    k = lambda o, e: _r(F.lit(1.0) - F.try_divide(o, F.when(e != 0, e)))
    return both.select(n.cast("long").alias("n"), _r(F.col("diag") / n).alias("agreement"),
                       k(F.col("o_u"), e_u).alias("cohen_kappa"),
                       k(F.col("o_l"), e_l).alias("kappa_linear"),
                       k(F.col("o_q"), e_q).alias("kappa_quadratic"))


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Combine two single-row aggregates side by side (equi-join on a constant)."""
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


def kappa_band(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for bound, name in KAPPA_BANDS:
        expr = F.when(c < bound, F.lit(name)) if expr is None else expr.when(c < bound, F.lit(name))
    return expr.otherwise(F.lit(KAPPA_TOP_BAND))


def agreement_report(pairs: DataFrame) -> DataFrame:
    k = kappa_table(pairs)
    return k.select("n", "agreement", "cohen_kappa", F.col("kappa_quadratic").alias("weighted_kappa"),
                    kappa_band("cohen_kappa").alias("interpretation"))


def confusion_pivot(pairs: DataFrame, labels: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Square confusion matrix: one row per label of the union (or the given
    labels), one count column per label, zeros filled. Built with ``pivot``
    (label values are the small class set)."""
    conf = confusion(pairs, "a", "b")
    if labels is None:
        labels = sorted(r[0] for r in conf.select(F.col("gold").alias("l"))
                        .union(conf.select("pred")).distinct().collect())
    lab = pairs.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    piv = conf.where(F.col("pred").isin(labels)).groupBy("gold").pivot("pred", labels).agg(F.sum("n"))
    out = lab.join(piv.withColumnRenamed("gold", "label"), "label", "left")
    return out.select("label", *[F.coalesce(F.col(f"`{x}`"), F.lit(0)).cast("long").alias(x) for x in labels]), labels


def confusion_long(pairs: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """(a_label, b_label, n) over all label pairs of the union, zeros included,
    by unpivoting the pivoted matrix (no cross join)."""
    piv, labels = confusion_pivot(pairs, labels)
    return piv.unpivot("label", labels, "b_label", "n").withColumnRenamed("label", "a_label")


def disagreements(df: DataFrame, a: str, b: str, null_label: str | None = "nan") -> DataFrame:
    """All columns of the rows where the two (normalized) labels differ."""
    return df.where(as_label(a, null_label) != as_label(b, null_label))


def disagreement_rate(pairs: DataFrame) -> DataFrame:
    dis = F.count_if(F.col("a") != F.col("b"))
    return pairs.agg(dis.alias("n_disagree"), F.count(F.lit(1)).alias("n"),
                     _r(dis.cast("double") / F.count(F.lit(1)) * 100).alias("disagree_pct"))


def per_category_agreement(pairs: DataFrame) -> DataFrame:
    """For each label: rows where either rater chose it, and the share of those
    rows where both did. Sorted by agreement, ties by label."""
    cats = pairs.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("category"),
                        (F.col("a") == F.col("b")).alias("same"))
    return (cats.groupBy("category").agg(F.count(F.lit(1)).alias("n_samples"),
                                         _r(F.avg(F.col("same").cast("double"))).alias("agreement"))
            .orderBy(F.desc("agreement"), F.asc("category")))
