"""Carry-forward and clause coverage on long responses and texts, against plain Python."""

import time

from pyspark.sql import functions as F

from facetlens.operators import clauses as CL


def brute_terms(lines):
    out, last = [], ""
    for line in lines:
        clause, _, term = line.partition("| Term:")
        last = term.strip() or last
        out.append((clause.replace("Clause:", "").strip() if "| Term:" in line else line, last))
    return out


def test_carry_forward_of_long_and_odd_responses(spark):
    long = [f"Clause: c{i} | Term: {'t%d' % i if i % 7 == 3 else ''}" if i % 3 else f"bare {i}" for i in range(10_000)]
    cases = [long, long[:3], ["Clause: a | Term: x"], ["only bare"], ["Clause: a | Term: ", "b", "Clause: c | Term: y", "d"], []]
    rows = [(i, "\n".join(c)) for i, c in enumerate(cases)] + [(99, None), (100, " \n ")]
    df = spark.createDataFrame(rows, "k int, response string")
    began = time.time()
    got = {}
    for r in CL.parse_clauses(df, "k").orderBy("k", "clause_pos").collect():
        got.setdefault(r.k, []).append((r.clause, r.term))
    assert got == {i: brute_terms(c) for i, c in enumerate(cases) if c}
    assert time.time() - began < 30


def test_clauses_are_searched_behind_the_last_match(spark):
    text = "é word, " * 3000 + "end"
    arr = lambda xs: [(0, x) for x in xs]
    rows = [(1, text, arr(["é word"] * 3000 + ["end"])), (2, text, arr(["end", "é word", "word"])), (3, text, arr(["end", "no such"])),
            (4, "", arr([])), (5, "aa", arr(["a", "a", "a"])), (6, "你好, 再见", arr(["你好", "再见", "好"])), (7, "ab", arr(["b", "x", "a"]))]
    df = spark.createDataFrame(rows, "k int, t string, c array<struct<pos:int,clause:string>>")
    got = {r.k: r.ok for r in df.select("k", CL.all_found(F.col("c"), F.col("t")).alias("ok")).collect()}
    assert got == {k: all(x in t for _, x in c) for k, t, c in rows}
    audit = CL.audit_clauses(df.select(F.col("k").alias("doc_id"), F.col("t").alias("text"))).where("doc_id = 1").first()
    assert audit.n_clauses == 3001 and audit.all_substrings and audit.no_blank


def test_contracted_negation_turns_polarity(spark):
    from facetlens.operators.classify import lexicon_polarity

    texts = ["it was good", "it wasn't good", "isn’t that good", "Don'T", "the ant's good"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    lex = spark.createDataFrame([("good", 1)], "entry string, sign int")
    got = {r.k: r.score for r in lexicon_polarity(docs, lex, "k", "t").collect()}
    assert got == {0: 1, 1: -1, 2: -1, 3: 0, 4: 1}
