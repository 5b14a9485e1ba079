"""Review-table sources and intake gates (scan, column resolution, lines,
nested JSON, encoding fallback, part files, intake cap, resume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetlens.functions.text import strip_ws
from facetlens.session import table_path

# Candidate text-column names, in priority order.
TEXT_COLUMN_CANDIDATES = ["Review", "review", "Text", "text", "Content", "content"]


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def read_reviews(spark: SparkSession, path: str, fmt: str = "csv",
                 schema: T.StructType | str | None = None) -> DataFrame:
    """Scan a review table. CSV keeps quoted newlines (``multiLine``) and a
    header row; without an explicit schema every column is read as string
    (no inference pass over the data)."""
    if fmt == "csv":
        r = (spark.read.option("header", True).option("multiLine", True)
             .option("escape", '"').option("encoding", "UTF-8"))
        if schema is not None:
            r = r.schema(schema)
        return r.csv(path)
    if fmt == "json":
        r = spark.read.option("multiLine", False)
        if schema is not None:
            r = r.schema(schema)
        return r.json(path)
    if fmt == "text":
        return read_lines(spark, path)
    return spark.read.format(fmt).load(path)


def resolve_text_column(df: DataFrame) -> str:
    """First present candidate name, else the first column (schema lookup only)."""
    for name in TEXT_COLUMN_CANDIDATES:
        if name in df.columns:
            return name
    return df.columns[0]


def with_text(df: DataFrame, out: str = "review_text") -> DataFrame:
    """Add the resolved text column under a fixed name."""
    return df.withColumn(out, F.col(resolve_text_column(df)).cast("string"))


def explode_lines(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per non-blank stripped line: (keep..., line_pos, line)."""
    keep = keep or []
    exploded = df.select(*keep, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_pos", "raw"))
    return (exploded.select(*keep, "line_pos", strip_ws(F.col("raw")).alias("line"))
            .where(F.col("line") != ""))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Line file -> (source, line_id, line), blank lines dropped.

    Line ids come from ``monotonically_increasing_id``: splits of one file are
    read in offset order, so ids increase with file position without a
    shuffle or a single-task pass.
    """
    df = spark.read.text(path)
    return (df.select(F.input_file_name().alias("source"),
                      F.monotonically_increasing_id().alias("line_id"),
                      strip_ws(F.col("value")).alias("line"))
            .where(F.col("line") != ""))


REVIEW_JSON_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("reviews", T.ArrayType(T.StructType([
        T.StructField("sentences", T.ArrayType(T.StringType()))])))]))


def flatten_reviews(df: DataFrame, nested_col: str = "reviews", keep: list[str] | None = None) -> DataFrame:
    """entity -> reviews[] -> sentences[] to one row per sentence.

    Positions are kept so the original order survives the explode.
    """
    keep = keep or []
    r = df.select(*keep, F.posexplode(nested_col).alias("review_pos", "review"))
    return r.select(*keep, "review_pos",
                    F.posexplode("review.sentences").alias("sentence_pos", "sentence"))


def read_text_fallback(spark: SparkSession, path_glob: str) -> DataFrame:
    """Whole-file decode: UTF-8 when the bytes are valid UTF-8, else Latin-1.

    Decided per file from the bytes, so a single bad byte switches that file
    (and only that file) to Latin-1.
    """
    raw = spark.read.format("binaryFile").load(path_glob).select("path", "content")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")),
                  F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return raw.select("path", text.alias("text"),
                      F.when(F.is_valid_utf8(F.col("content").cast("string")), F.lit("UTF-8"))
                      .otherwise(F.lit("ISO-8859-1")).alias("encoding"))


def read_parts(spark: SparkSession, paths: list[str], fmt: str = "csv") -> DataFrame:
    """Vertical union of part files; columns missing in a part become null."""
    if fmt in ("parquet", "orc"):
        return spark.read.option("mergeSchema", True).format(fmt).load(paths)
    frames = [read_reviews(spark, p, fmt) for p in paths]
    return union_parts(frames)


def union_parts(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def intake_filter(df: DataFrame, text_col: str, order_col: str, cap: int | None = None,
                  min_len: int = 3) -> DataFrame:
    """null -> '', strip, first ``cap`` rows by ``order_col`` if a cap is given, then keep length >= min_len.

    The cap is applied before the length gate (as the upload path does);
    ``cap=None`` is the scale mode and needs no global sort.
    """
    cleaned = df.withColumn(text_col, strip_ws(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    if cap is not None:
        cleaned = cleaned.orderBy(order_col).limit(cap)
    return cleaned.where(F.length(text_col) >= min_len)


def global_rank(df: DataFrame, order_cols: list[str] | None) -> DataFrame:
    """Add ``row_pos`` (0-based position in ``order_cols`` order, or in file
    order when ``order_cols`` is None) without moving all rows into one
    partition.

    The (range-partitioned, sorted) frame is checkpointed so every later read
    sees the same partitioning, per-partition row counts give each partition's
    start offset (one small row per partition), and each row adds its index
    inside its partition.
    """
    from facetlens.session import cut_lineage

    base = df.orderBy(*order_cols) if order_cols else df
    srt = base.withColumns({
        "_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()})
    srt = cut_lineage(srt)
    starts = srt.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    # one row per partition: a cumulative sum over it is tiny
    starts = starts.withColumn("_base", F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
    out = srt.join(F.broadcast(starts.select("_pid", "_m0", "_base")), "_pid")
    pos = F.coalesce(F.col("_base"), F.lit(0)) + (F.col("_mid") - F.col("_m0"))
    return out.withColumn("row_pos", pos).drop("_pid", "_mid", "_m0", "_base")


def resume_from(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """Positional resume: skip the first ``n`` rows in ``order_col`` order."""
    return global_rank(df, [order_col]).where(F.col("row_pos") >= n).drop("row_pos")


def with_row_position(df: DataFrame) -> DataFrame:
    """Positional row index of a keyless file (0-based, file order), for
    pairing files that only share row order."""
    return global_rank(df, None)


def resume_anti(df: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """Key-based resume: rows whose key is not yet in ``finished``."""
    return df.join(finished.select(key).distinct(), on=key, how="left_anti")


def project_result(df: DataFrame, names: list[str], display: dict[str, str] | None = None) -> DataFrame:
    """Keep the listed columns that exist, in the listed order; optional rename."""
    present = [n for n in names if n in df.columns]
    out = df.select(*present)
    if display:
        out = out.withColumnsRenamed({k: v for k, v in display.items() if k in present})
    return out


def nonblank(col: Column) -> Column:
    return F.coalesce(strip_ws(col), F.lit("")) != ""
