"""Faults mended in the second round."""

import pytest
from pyspark.sql import functions as F

from facetlens.operators import metrics as M
from facetlens.sources import readers as RD


def test_intake_keeps_all_rows_without_a_cap(spark):
    df = spark.range(500).select("id", F.lit("long enough").alias("text"))
    assert RD.intake_filter(df, "text", "id").count() == 500


def test_missing_label_is_one_label(spark):
    conf = spark.createDataFrame([("a", "a", 2), (None, None, 3), ("a", None, 1)], "gold string, pred string, n long")
    rows = {r["label"]: (r["support"], r["tp"], r["pred_n"]) for r in M.label_stats(conf).collect()}
    assert rows == {"a": (3, 2, 2), None: (3, 3, 4)}


def test_text_file_job_reads_lines_as_reviews(spark, tmp_path):
    from facetlens.plans import catalog, runs

    (tmp_path / "a.txt").write_text("The room was clean.\n\nThe staff was rude.\n")
    (tmp_path / "b.txt").write_text("Breakfast was cold.\n")
    seen = {}

    def scored(df, *args, **kwargs):
        seen["reviews"] = sorted(r["review"] for r in df.collect())
        raise RuntimeError("seen")

    real, runs.run_scored = runs.run_scored, scored
    try:
        with pytest.raises(RuntimeError, match="seen"):
            runs.run_file(spark, str(tmp_path), "text", None, None)
    finally:
        runs.run_scored = real
    assert seen["reviews"] == ["Breakfast was cold.", "The room was clean.", "The staff was rude."]
    assert catalog.QUERIES
