"""Sources, sinks, hygiene helpers, the model stage and streaming."""

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from facetlens.operators import hygiene as HY
from facetlens.operators.model_stage import RuleBackend, run_model
from facetlens.sources import readers as RD
from facetlens.sources import sinks as SK

SF = "/root/testdata/sf0.001"


def _tmp():
    return tempfile.mkdtemp(prefix="facetlens-test-")


def test_encoding_fallback(spark):
    d = _tmp()
    with open(f"{d}/a.txt", "wb") as f:
        f.write("café au lait".encode("utf-8"))
    with open(f"{d}/b.txt", "wb") as f:
        f.write("café noir".encode("latin-1"))
    got = {os.path.basename(r.path): (r.text, r.encoding)
           for r in RD.read_text_fallback(spark, f"{d}/*.txt").collect()}
    assert got == {"a.txt": ("café au lait", "UTF-8"), "b.txt": ("café noir", "ISO-8859-1")}


def test_read_lines_drops_blank(spark):
    d = _tmp()
    with open(f"{d}/r.txt", "w") as f:
        f.write("first review\n\n   \n second review \n")
    rows = RD.read_lines(spark, f"{d}/r.txt").orderBy("line_id").collect()
    assert [r.line for r in rows] == ["first review", "second review"]


def test_csv_scan_multiline_and_text_column(spark):
    d = _tmp()
    with open(f"{d}/in.csv", "w") as f:
        f.write('id,Content,other\n1,"line one\nline two",x\n2,short,y\n')
    df = RD.read_reviews(spark, f"{d}/in.csv")
    assert RD.resolve_text_column(df) == "Content"
    assert [r.Content for r in df.orderBy("id").collect()] == ["line one\nline two", "short"]
    nocand = spark.createDataFrame([("a", "b")], "first string, second string")
    assert RD.resolve_text_column(nocand) == "first"


def test_part_files_union_with_missing_columns(spark):
    d = _tmp()
    with open(f"{d}/p1.csv", "w") as f:
        f.write("clause,term\na,x\n")
    with open(f"{d}/p2.csv", "w") as f:
        f.write("clause,term,opinion\nb,y,good\n")
    df = RD.read_parts(spark, [f"{d}/p1.csv", f"{d}/p2.csv"])
    got = sorted((r.clause, r.term, r.opinion) for r in df.collect())
    assert got == [("a", "x", None), ("b", "y", "good")]


def test_part_sink_rows_per_file(spark):
    out = f"{_tmp()}/parts"
    df = spark.range(250).select(F.col("id").cast("int").alias("sentence_index"),
                                 F.lit("c").alias("clause"), F.lit("t").alias("term")).coalesce(1)
    SK.write_results(df, out, rows_per_file=100)
    assert len(glob.glob(f"{out}/part-*.csv")) == 3
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 250 and back.columns == ["sentence_index", "clause", "term"]
    SK.write_results(df, out, rows_per_file=100)          # rerun overwrites: idempotent
    assert spark.read.option("header", True).csv(out).count() == 250


def test_export_csv_roundtrip(spark):
    out = f"{_tmp()}/export"
    df = spark.createDataFrame([("a,b", 1), ('quote "x"', 2)], "t string, n int")
    SK.export_csv(df, out)
    back = spark.read.option("header", True).option("escape", '"').csv(out)
    assert sorted((r.t, int(r.n)) for r in back.collect()) == [("a,b", 1), ('quote "x"', 2)]


def test_dedup_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int").toDF("a", "b", "a", "a")
    assert HY.dedup_columns(df).columns == ["a", "b", "a_1", "a_2"]


def test_nested_json_flatten(spark):
    d = _tmp()
    with open(f"{d}/n.json", "w") as f:
        f.write('{"hotel": "h1", "reviews": [{"sentences": ["s1", "s2"]}, {"sentences": ["s3"]}]}\n')
    df = spark.read.json(f"{d}/n.json")
    rows = RD.flatten_reviews(df, "reviews", keep=["hotel"]).collect()
    assert [(r.review_pos, r.sentence_pos, r.sentence) for r in rows] == [(0, 0, "s1"), (0, 1, "s2"), (1, 0, "s3")]


def test_intake_cap_applies_before_length_gate(spark):
    df = spark.createDataFrame([(1, " ok "), (2, "a"), (3, "fine"), (4, None), (5, "good one")],
                               "id long, text string")
    capped = RD.intake_filter(df, "text", "id", cap=3)
    assert [r.id for r in capped.orderBy("id").collect()] == [3]
    assert [r.id for r in RD.intake_filter(df, "text", "id", cap=None).orderBy("id").collect()] == [3, 5]


def test_resume_positional_and_keyed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    rest = RD.resume_from(docs.repartition(5), 150, "doc_id")
    assert sorted(r.doc_id for r in rest.collect()) == sorted(r.doc_id for r in docs.collect())[150:]
    done = docs.where(F.col("doc_id") < 50)
    assert RD.resume_anti(docs, done, "doc_id").count() == docs.count() - done.count()


def test_fill_defaults_and_replace(spark):
    df = spark.createDataFrame([("a-b", None, float("nan")), (None, 0.5, None)], "t string, s double, u double")
    out = HY.fill_defaults(df, ["t", "missing"], ["s", "u", "absent"]).collect()
    assert (out[0].t, out[0].missing, out[0].s, out[0].u, out[0].absent) == ("a-b", "", 0.0, 0.0, 0.0)
    rep = HY.replace_literal(df.select("t"), "-", " ").collect()
    assert [r.t for r in rep] == ["a b", "nan"]


class _Flaky:
    key = "flaky-test"

    def generate(self, texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("backend failed")
        return [t.upper() for t in texts]


def test_model_stage_dedups_and_reports_failures(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "boom"), (4, None)], "id long, text string")
    out = {r.id: (r.response, r.model_status) for r in run_model(df, _Flaky(), "text", batch_rows=1).collect()}
    assert out[1] == ("A", "ok") and out[2] == ("A", "ok")
    assert out[3] == (None, "error") and out[4] == (None, "skipped")


def test_rule_backend_split_answers_parse(spark):
    from facetlens.operators import clauses as CL
    df = spark.createDataFrame([(1, "The room was clean, but the staff was rude")], "id long, text string")
    r = run_model(df, RuleBackend("split"), "text")
    got = [(x.clause, x.term) for x in CL.parse_clauses(r, "id").orderBy("clause_pos").collect()]
    assert got == [("The room was clean", "The"), ("the staff was rude", "the")]


def test_stream_counts_equal_batch(spark):
    from facetlens import streaming as ST
    ev = spark.read.parquet(f"{SF}/events.parquet")
    sdf = ST.read_stream(spark, f"{SF}/events.parquet", ev.schema)
    out, progress = ST.run_available(ST.windowed_counts(sdf, "ts", "event_type"), "t_counts", "complete")
    streamed = {(r.w.start, r.event_type): r.n for r in out.collect()}
    batch = (ev.withColumn("t", F.col("ts").cast("timestamp"))
             .groupBy(F.window("t", "1 hour").alias("w"), "event_type").count().collect())
    assert streamed == {(r.w.start, r.event_type): r["count"] for r in batch}
    assert sum(p["numInputRows"] for p in progress) == ev.count()


def test_stream_score_equals_batch(spark):
    from facetlens import streaming as ST
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sdf = ST.read_stream(spark, f"{SF}/documents.parquet", docs.schema)
    out, _ = ST.run_available(ST.score_stream(sdf), "t_score", "append")
    batch = ST.score_stream(docs)
    assert out.exceptAll(batch).count() == 0 and batch.exceptAll(out).count() == 0


@pytest.mark.parametrize("cap", [None])
def test_file_job_nests_every_review(spark, cap):
    from facetlens.operators import classify as CF
    from facetlens.plans import runs as RU
    d = _tmp()
    with open(f"{d}/u.csv", "w") as f:
        f.write('review\nThe room was clean and the staff friendly\nok\n"Breakfast was cold, but cheap"\n!!!\n')
    train = spark.read.parquet(f"{SF}/documents.parquet")
    model = CF.fit_nb(train, "lang", CF.word_tokens("text"))
    lex = spark.createDataFrame([("clean", 1), ("cold", -1), ("cheap", 1)], "entry string, sign int")
    nested = RU.run_file(spark, f"{d}/u.csv", "csv", model, lex, cap=cap, split_backend=RU.RULES,
                         opinion_backend=RU.RULES).collect()
    assert len(nested) == 3       # 'ok' is below the length gate; '!!!' has no clause
    assert {r.review: len(r.aspects) for r in nested}["!!!"] == 0
    by_review = {r.review: r.aspects for r in nested}
    assert [a.clause for a in by_review["Breakfast was cold, but cheap"]] == ["Breakfast was cold", "cheap"]
