"""Reviews are searched and moved once a review, not once a clause."""

import re

from pyspark.sql import functions as F

from facetlens.functions.text import folded, whole_word_in, whole_words_in
from facetlens.operators import answers as AN
from facetlens.operators import classify as CF
from facetlens.plans import runs as RU
from facetlens.plans.catalog import QUERIES

TERMS = ["room", "ROOM", "İstanbul", "straße", "STRASSE", "ΟΔΟΣ", "οδος", "ſo", "k", "c++", "a.b", "(very", "very)", "ét", "no one",
         "µm", "_x", "x", "don't", "zzqx", "!", "\\d", "$1", "ı"]
TEXTS = ["The Room, (very) clean", "istanbul Straße οδοσ", "So K C++ a.b aXb c++x", "ét Μm no  one no one", "_x x_ Don't!", "", None, "!a! \\d $1 I"]


def test_folded_search_equals_the_case_insensitive_pattern(spark):
    df = spark.createDataFrame([(t, w) for t in TEXTS for w in TERMS], "text string, term string")
    slow = F.regexp_like("text", F.concat(F.lit(r"(?iU)\b"), F.regexp_replace("term", r"([!-/:-@\[-`{-~])", r"\\$1"), F.lit(r"\b")))
    rows = df.select("*", slow.alias("slow"), whole_word_in("term", "text").alias("fast"),
                     whole_words_in(F.array("term"), "text").alias("many")).collect()
    assert [r for r in rows if r.slow != r.fast] == []
    assert [r for r in rows if r.many != ([r.term] if r.slow else [])] == []
    assert sum(bool(r.slow) for r in rows) > 15


def test_case_variants_fold_like_java(spark):
    letters = [chr(c) for c in range(1, 0x2200) if chr(c).lower() != chr(c) or chr(c).upper() != chr(c)]
    got = {r.x: r.f for r in spark.createDataFrame([(x,) for x in letters], "x string").select("x", folded("x").alias("f")).collect()}
    J = spark.sparkContext._jvm.java.lang.Character
    simple = {x: J.toLowerCase(J.toUpperCase(ord(x))) for x in letters}
    assert len(set(zip(got.values(), simple.values()))) == len(set(got.values())) == len(set(simple.values()))


def test_opinions_found_equals_item_by_item(spark):
    answers = [("room, Staff, zzqx", "Room ok"), ("staff, staff", "x"), (None, "x"), ("", "x"), ("a b c d e f g h, rude", None)]
    df = spark.createDataFrame([(answers, "Room ok, staff rude"), (answers, None), ([], "x"), (None, "x")],
                               "a array<struct<opinion:string,clause:string>>, s string")
    got = [r.o for r in df.select(AN.opinions_found("a", F.col("s")).alias("o")).collect()]
    assert got == [["room, Staff", "staff, staff", None, "", "rude"], ["room", "", None, "", ""], [], None]


def _docs(spark, tmp_path):
    text = ". ".join(f"the staff of house {i} was rude and the room (clean)" for i in range(30))
    spark.createDataFrame([(i, text, "en") for i in range(3)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filter_opinions_keeps_clauses_in_their_review(spark, tmp_path):
    _docs(spark, tmp_path)
    df = QUERIES["filter_opinions"](spark, str(tmp_path))
    plan = _plan(df)
    assert plan.index("Generate") < plan.index("Join")     # one row per clause only above the join with the text
    assert df.count() == 180


def test_full_run_joins_clauses_without_their_review(spark, tmp_path):
    _docs(spark, tmp_path)
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = RU.run_full(d.select("doc_id", "text"), "doc_id", "text", CF.fit_language_model(d), CF.fit_nb(d, "lang", CF.word_tokens("text")),
                      CF.frequent_token_lexicon(d, "text", 5), split_backend=RU.RULES, opinion_backend=RU.RULES)
    assert out.count() == 180 and out.where("sentence_original is null").count() == 0
    by_clause = [x for x in re.split(r"\n", _plan(out)) if "Join" in x and "_ck" in x]
    assert len(by_clause) == 2
    assert "regexp_like" not in _plan(out)                  # opinions were checked before, once a review
