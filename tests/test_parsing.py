"""Hand goldens for model-response parsing and answer cleanup (FIXTURES §2)."""

from pyspark.sql import functions as F

from facetlens.operators import answers as AN
from facetlens.operators import classify as CF
from facetlens.operators import clauses as CL


def _split(spark, response, sentence="a x b y"):
    df = spark.createDataFrame([(1, response, sentence)], "id long, response string, sentence string")
    return [(r.clause, r.term, r.n_markers)
            for r in CL.split_and_refine(df, "id", "sentence").orderBy("clause_pos").collect()]


def _parsed(spark, response):
    df = spark.createDataFrame([(1, response)], "id long, response string")
    return [(r.clause, r.term) for r in CL.parse_clauses(df, "id").orderBy("clause_pos").collect()]


def test_two_clauses(spark):
    assert _parsed(spark, "Clause: a x | Term: x\nClause: b y | Term: y") == [("a x", "x"), ("b y", "y")]


def test_carried_term(spark):
    assert _parsed(spark, "Clause: a x | Term: x\nClause: b y | Term: ") == [("a x", "x"), ("b y", "x")]


def test_first_line_blank_term(spark):
    assert _parsed(spark, "Clause: a x | Term:\nClause: b y | Term: y") == [("a x", ""), ("b y", "y")]


def test_no_marker_kept_verbatim_with_carried_term(spark):
    out = _parsed(spark, "Clause: a x | Term: x\nClause: free text")
    assert out == [("a x", "x"), ("Clause: free text", "x")]


def test_blank_lines_skipped(spark):
    assert _parsed(spark, "\n  \nClause: a x | Term: x\n\n") == [("a x", "x")]


def test_end_marker_in_last_term(spark):
    out = _split(spark, "Clause: a x | Term: x\nClause: room | Term: room<|im_end|>", "a x room")
    assert out[-1][:2] == ("room", "room")


def test_end_marker_only_gives_blank_and_is_not_carried(spark):
    out = _split(spark, "Clause: a x | Term: x\nClause: b y | Term: <|im_end|>")
    assert out == [("a x", "x", 1), ("b y", "", 1)]


def test_marker_twice_is_quarantined(spark):
    df = spark.createDataFrame([(1, "Clause: a | Term: a | Term: b")], "id long, response string")
    parsed = CL.parse_clauses(df, "id")
    good, bad = AN.quarantine(AN.with_status(parsed))
    assert good.count() == 0 and bad.count() == 1


def test_substring_vs_whole_word(spark):
    # split path keeps substrings, whole-sentence path needs whole words
    assert _split(spark, "Clause: bathroom was ok | Term: room", "bathroom was ok")[0][1] == "room"
    df = spark.createDataFrame([(1, "bathroom was ok", "Term: room")], "id long, s string, response string")
    assert CL.parse_terms(df, "s").first().term == ""


def test_punctuation_end_never_matches(spark):
    df = spark.createDataFrame([(1, "wifi! ok", "Term: wifi!, ok")], "id long, s string, response string")
    assert CL.parse_terms(df, "s").first().term == "ok"


def test_whole_word_case_insensitive_and_joined(spark):
    df = spark.createDataFrame([(1, "The Staff and the room", "Term: staff, ROOM, pool<|im_end|>")],
                               "id long, s string, response string")
    assert CL.parse_terms(df, "s").first().term == "staff, ROOM"


def test_regex_metacharacters_are_literal(spark):
    df = spark.createDataFrame([(1, "price (tax) a.b c+d", "Term: a.b, c+d, a*b")],
                               "id long, s string, response string")
    assert CL.parse_terms(df, "s").first().term == "a.b, c+d"


def _demux(spark, clauses, response, sentence=""):
    items = [{"clause": c, "term": ""} for c in clauses]
    df = spark.createDataFrame([(1, 0, items, response, sentence)],
                               "id long, batch_id int, items array<struct<clause:string,term:string>>, "
                               "response string, sentence string")
    return [r.opinion for r in AN.demux_answers(df, "id", "response", "sentence").orderBy("item_no").collect()]


def test_numbered_answers(spark):
    clauses = [f"c{i} clean quiet" for i in range(1, 11)]
    resp = "1. clean\n2. None\n10. quiet"
    out = _demux(spark, clauses, resp)
    assert out[0] == "clean" and out[1] == "" and out[2] == "" and out[9] == "quiet"


def test_ten_not_taken_for_one(spark):
    out = _demux(spark, ["x clean", "y"], "10. clean")
    assert out == ["", ""]


def test_markup_and_parentheses(spark):
    assert _demux(spark, ["very clean room"], "1. <b>clean</b> (very)") == ["clean"]


def test_long_explanation_blanked(spark):
    resp = "1. the term room is described as clean here"
    assert _demux(spark, ["room is described as clean here the term"], resp) == [""]


def test_eight_word_opinion_dropped(spark):
    clause = "one two three four five six seven eight nine"
    assert _demux(spark, [clause], "1. one two three four five six seven eight") == [""]
    assert _demux(spark, [clause], "1. one two three four five six seven") == ["one two three four five six seven"]


def test_opinion_found_in_sentence_only(spark):
    assert _demux(spark, ["room"], "1. spotless", sentence="a spotless room") == ["spotless"]


def test_clean_opinion_steps(spark):
    cases = {
        "3. Answer: friendly staff.": "friendly staff",
        "ID great": "great",
        "Opinion: nice": "nice",
        "good. Because it says so": "good",
        "This text describes the opinion about the room": "",
        "12": "12",
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = {r.raw: r.c for r in df.select("raw", AN.clean_opinion("raw").alias("c")).collect()}
    assert got == cases
    fin = {r.raw: r.c for r in df.select("raw", AN.final_opinion("raw").alias("c")).collect()}
    assert fin["12"] == ""


def test_polarity_labels(spark):
    rows = [(1, "room ok", [("LABEL_2", 0.9), ("LABEL_0", 0.1)]),
            (2, "room ok", [("positive", 0.876543)]),
            (3, "  ", [("LABEL_0", 0.99)]),
            (4, "room", [("LABEL_7", 0.5)])]
    df = spark.createDataFrame(rows, "id long, clause string, preds array<struct<label:string,score:double>>")
    out = {r.id: (r.p.polarity, r.p.polarity_score)
           for r in df.select("id", CF.decode_polarity("preds", "clause").alias("p")).collect()}
    assert out == {1: ("Positive", 0.9), 2: ("Positive", 0.8765), 3: ("Neutral", 0.0), 4: ("Neutral", 0.5)}


def test_clause_split_keeps_negation_inside(spark):
    df = spark.createDataFrame([(1, "The room was not clean, but the staff was very helpful!")],
                               "id long, text string")
    got = [r.clause for r in CL.split_clauses(df, "id").orderBy("clause_pos").collect()]
    assert got == ["The room was not clean", "the staff was very helpful"]
    audit = CL.audit_clauses(df, "id").first()
    assert audit.all_substrings and audit.no_blank and audit.n_clauses == 2


def test_batches_cut_inside_row(spark):
    items = [{"clause": f"c{i}", "term": "t"} for i in range(70)]
    df = spark.createDataFrame([(1, items)], "id long, items array<struct<clause:string,term:string>>")
    b = AN.batch_prompts(df, "id", "items", 32).orderBy("batch_id").collect()
    assert [r.n_items for r in b] == [32, 32, 6]
    assert b[1].prompt.count("\n1. [t] c32") == 1 and "32. [t] c63" in b[1].prompt
    empty = spark.createDataFrame([(2, [])], "id long, items array<struct<clause:string,term:string>>")
    assert AN.batch_prompts(empty, "id", "items").count() == 0


def test_lexicon_match_bigrams(spark):
    df = spark.createDataFrame([(1, "The front desk staff, the room")], "id long, text string")
    lex = spark.createDataFrame([("front desk",), ("room",)], "entry string")
    r = CL.match_lexicon(df, lex, "id").first()
    assert (r.n_hits, r.hits) == (2, "front desk, room")
