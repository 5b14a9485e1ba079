"""Append mode over several micro-batches: closed sliding windows, late rows, rows per batch."""

import datetime as dt

from pyspark.sql import functions as F

from facetlens import streaming as ST

START = dt.datetime(2024, 1, 1)


def test_closed_windows_and_counts_over_many_batches(spark, tmp_path):
    at = lambda h, m=0: START + dt.timedelta(hours=h, minutes=m)
    batches = [[(at(0, 5), "a"), (at(0, 50), "b")], [(at(1, 10), "a"), (at(3, 0), "a"), (at(2, 59), "b")],
               [(at(9, 0), "a")], [(at(9, 30), "b")], [(at(1, 0), "b"), (at(9, 40), "b")], [(at(12, 0), "a")]]
    # at(1, 0) comes too late: the batch before closed its windows
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "ts timestamp_ntz, c string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = lambda: ST.read_stream(spark, str(tmp_path / "in") + "/", schema, max_files=1)

    out, _ = ST.run_available(ST.windowed_counts(stream(), "ts", "c", "2 hours", "2 hours", slide="1 hour"), "t_closed", "append")
    got = {(r.s, r.c): r.n for r in out.select(F.col("w.start").cast("timestamp_ntz").alias("s"), "c", "n").collect()}
    want = {}
    for ts, c in [r for rows in batches for r in rows if r != (at(1, 0), "b")]:
        hour = ts.replace(minute=0)
        for s in (hour, hour - dt.timedelta(hours=1)):
            if s + dt.timedelta(hours=2) <= at(10):      # the watermark stands two hours behind 12:00
                want[s, c] = want.get((s, c), 0) + 1
    assert got == want

    written, _ = ST.run_available(stream(), "t_counts", "append", keep_batch=True)
    counts = {r.batch_id: r.num_input_rows for r in ST.batch_counts(written).collect()}
    assert [counts[i] for i in sorted(counts)] == [len(b) for b in batches]
