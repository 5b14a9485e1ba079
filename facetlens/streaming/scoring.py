"""Structured Streaming: the batch column functions applied to a stream,
windowed category counts with a watermark, and per-batch progress.

Sinks write through ``foreachBatch`` keyed by the batch id: a replayed batch
overwrites its own output, so a restarted query never duplicates rows.
Outputs and checkpoints live under the session's shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlens.functions.text import clean_text, word_count
from facetlens.operators.clauses import clause_array
from facetlens.session import ensure_checkpoint_dir


def read_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    import os

    r = spark.readStream.schema(schema).format("parquet")
    if not path.endswith("/") and os.path.splitext(path)[1]:
        # A single file: the source pins basePath to a non-glob path, which
        # must be a folder. A one-character glob class matches the same file
        # and lets the file's folder be the base path.
        r = r.option("basePath", os.path.dirname(path))
        path = f"{path[:-1]}[{path[-1]}]"
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def score_stream(sdf: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stateless per-review scoring: the same column functions as batch."""
    return sdf.select(key, word_count(clean_text(F.col(text_col))).alias("n_words"),
                      F.size(clause_array(F.col(text_col))).alias("n_clauses"))


def windowed_counts(sdf: DataFrame, ts_col: str, cls_col: str, window: str = "1 hour",
                    watermark: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts per (event-time window, class). The time column is cast to a
    session-zone timestamp first (the watermark needs TIMESTAMP, not NTZ)."""
    t = sdf.withColumn("_ts", F.col(ts_col).cast("timestamp")).withWatermark("_ts", watermark)
    w = F.window("_ts", window, slide) if slide else F.window("_ts", window)
    return t.groupBy(w.alias("w"), F.col(cls_col)).agg(F.count(F.lit(1)).alias("n"))


def _out_dirs(spark: SparkSession, name: str) -> tuple[str, str]:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = f"{name}-{uuid.uuid4().hex[:12]}"
    return f"{base}/streams/{run}/out", f"{base}/streams/{run}/checkpoint"


def run_available(sdf: DataFrame, name: str, mode: str = "append", keep_batch: bool = False):
    """Run the stream over everything available now and return
    (result DataFrame read back from the sink, progress list).

    append  : batch ``b`` writes ``out/batch=b`` (overwrite => idempotent replay)
    complete: each batch overwrites ``out`` with the full result table

    Waits until all available input is processed; a failure of the stream is
    raised here. ``keep_batch`` leaves the batch number in an appended result.
    """
    spark = sdf.sparkSession
    # the progress list must keep every micro-batch, not only the last hundred
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1000000")
    out, ckpt = _out_dirs(spark, name)

    def sink(batch: DataFrame, batch_id: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(out)
        else:
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (sdf.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    progress = q.recentProgress
    q.stop()
    result = spark.read.parquet(out)
    return (result if mode == "complete" or keep_batch else result.drop("batch")), progress


def batch_counts(written: DataFrame) -> DataFrame:
    """(batch_id, num_input_rows) of a stateless stream's sink, counted from what each batch wrote.

    ``written`` is the result of ``run_available(..., keep_batch=True)``. A
    replayed batch overwrites its own rows, so it counts once; a batch that
    wrote nothing has no row.
    """
    return written.groupBy(F.col("batch").cast("bigint").alias("batch_id")).agg(F.count(F.lit(1)).alias("num_input_rows"))


def progress_frame(spark: SparkSession, progress: list) -> DataFrame:
    """(batch_id, num_input_rows) from a query's progress reports (one small
    row per micro-batch)."""
    rows = [(int(p["batchId"]), int(p["numInputRows"])) for p in progress]
    return spark.createDataFrame(rows, "batch_id long, num_input_rows long")
