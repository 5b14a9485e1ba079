"""A review's clauses stay in its row: they are scored there, and neither written nor shuffled one by one."""

import pytest
from pyspark.sql import functions as F

from facetlens.operators import classify as CF
from facetlens.operators import clauses as CL
from facetlens.plans import runs as RU

DOCS = [(1, "The room wasn't clean, staff very rude. no breakfast", "en"), (2, "Zimmer sauber und ruhig", "de"), (3, "", "en"),
        (4, "room, !!!, --- wifi wifi zebra", "en"), (5, "quiet; the room (clean) was not so clean", "en"), (6, " ", "de")]


@pytest.fixture(scope="module")
def setup(spark):
    df = spark.createDataFrame(DOCS, "id long, text string, lang string")
    lex = spark.createDataFrame([("clean", 1), ("rude", -1), ("room", 1), ("room", 1), (None, 1)], "entry string, sign int")
    return df.select("id", "text"), CF.fit_language_model(df), CF.fit_nb(df, "lang", CF.word_tokens("text")), lex


def _arrays(spark):
    rows = [(1, ["room clean", "", None, "wifi zebra unseen", "!!"]), (2, []), (3, None), (4, ["was not so clean", "rude, very rude", "wasn't clean room"])]
    return spark.createDataFrame(rows, "id long, t array<string>")


def _each(df):
    return df.select("id", F.posexplode("t").alias("pos", "x")).select(F.struct("id", "pos").alias("ck"), "x")


@pytest.mark.parametrize("max_words", [500_000, 6, 1])
def test_categories_inside_equal_the_join(spark, setup, max_words):
    df, model = _arrays(spark), setup[2]
    got = {r.id: r.categories for r in CF.categories_inside(model, df, "id", "t", max_words).collect()}
    want = {(r.ck.id, r.ck.pos): (r.category, round(r.category_score, 12)) for r in CF.predict_category(model, _each(df), "ck", "x").collect()}
    assert {(i, p): (x.category, round(x.category_score, 12)) for i, a in got.items() for p, x in enumerate(a or [])} == want
    assert got[2] == [] and got[3] is None


@pytest.mark.parametrize("max_entries", [500_000, 1])
def test_polarities_inside_equal_the_join(spark, setup, max_entries):
    df, lex = _arrays(spark), setup[3]
    got = {r.id: r.polarities for r in CF.polarities_inside(df, lex, "id", "t", max_entries).collect()}
    want = {(r.ck.id, r.ck.pos): (r.score, r.polarity) for r in CF.lexicon_polarity(_each(df), lex, "ck", "x").collect()}
    assert {(i, p): (x.score, x.polarity) for i, a in got.items() for p, x in enumerate(a or [])} == want
    assert got[2] == [] and not got[3] and len({x for x, _ in want.values()}) > 2


def _kept(monkeypatch):
    kept, plain = [], RU.cut_lineage
    monkeypatch.setattr(RU, "cut_lineage", lambda d: kept.append(d.columns) or plain(d))
    return kept


def _rows(df):
    return sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())


def test_full_run_writes_no_review_text(setup, monkeypatch):
    df, lang, cat, lex = setup
    kept = _kept(monkeypatch)
    out = RU.run_full(df, "id", "text", lang, cat, lex, split_backend=RU.RULES, opinion_backend=RU.RULES)
    # of reviews with keys of their own: opinions only. The reviews that share keys, none here, are written as before
    assert [k for k in kept if "_row" not in k] == [["id"], ["id", "opinion"]]
    ones = {r.sentence_index - 1: r for r in out.collect() if r.status == "empty"}
    assert set(ones) == {3, 6} and all(r.category is None and r.clause is None for r in ones.values())


def test_scored_run_writes_and_joins_no_clauses(setup, monkeypatch):
    df, _, cat, lex = setup
    kept = _kept(monkeypatch)
    out = RU.run_scored(df, "id", "text", cat, lex, split_backend=RU.RULES, opinion_backend=RU.RULES, batch_size=2)
    assert kept == [["id"]] and "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r.id, r.batch_id, r.item_no): (r.clause, r.category, r.polarity) for r in out.collect()}
    assert rows[1, 0, 1] == ("The room wasn't clean", "en", "Positive") and rows[1, 1, 1] == ("no breakfast", "en", "Neutral")
    assert rows[3, None, None] == rows[6, None, None] == (None, None, None)


def test_file_run_nests_clauses_where_they_are(spark, setup, tmp_path, monkeypatch):
    df, _, cat, lex = setup
    df.write.parquet(f"{tmp_path}/reviews")
    kept = _kept(monkeypatch)
    out = RU.run_file(spark, f"{tmp_path}/reviews", "parquet", cat, lex, split_backend=RU.RULES, opinion_backend=RU.RULES)
    assert kept == [["review_id"]]                   # neither reviews nor clauses
    lines = [x.strip() for x in out._jdf.queryExecution().executedPlan().toString().split("\n")]
    at = next(i for i, x in enumerate(lines) if "(collect_list" in x.replace("[", "(") or "collect_list(" in x)
    between = lines[at:next(i for i, x in enumerate(lines) if i > at and "posexplode" in x)]
    assert not [x for x in between if "Exchange" in x]
    assert sorted(len(r.aspects) for r in out.collect()) == [1, 2, 2, 3]


def test_shared_and_missing_keys_give_what_joins_give(spark, setup):
    df, lang, cat, lex = setup
    more = df.union(df.where("id = 1")).union(spark.createDataFrame([(None, "room, clean"), (None, "rude")], "id long, text string"))
    for d in (df, more):
        r = RU._responses(d.select("id", "text"), "text", "split", RU.RULES).withColumn("status", F.lit("ok"))
        r = CL.parse_opinions(RU._responses(r, "text", "opinion", RU.RULES, "opinion_response"), "text", "opinion_response")
        want = RU._full_joined(r.select("id", "text", "response", "status", "opinion"), "id", "text", cat, lex, RU.RULES, True)
        got = RU.run_full(d, "id", "text", lang, cat, lex, split_backend=RU.RULES, opinion_backend=RU.RULES)
        assert _rows(got) == _rows(want)
    scored = RU.run_scored(more, "id", "text", cat, lex, split_backend=RU.RULES, opinion_backend=RU.RULES).collect()
    assert not [r for r in scored if r.id is None]
    assert len([r for r in scored if r.id == 1 and r.clause == "no breakfast"]) == 8    # of 2 reviews, with each of 2 texts, given each of 2
