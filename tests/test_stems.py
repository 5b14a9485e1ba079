"""Porter stems against published examples; stemmed ROUGE-L and the 16 metrics against brute force."""

import math

import pytest

from facetlens.functions.stem import porter_stem
from facetlens.operators import metrics as ME

STEMS = """caresses caress|ponies poni|ties tie|caress caress|cats cat|feed feed|agreed agre|plastered plaster|bled bled
motoring motor|sing sing|conflated conflat|troubled troubl|sized size|hopping hop|tanned tan|falling fall|hissing hiss
fizzed fizz|failing fail|filing file|happy happi|sky sky|skies sky|relational relat|conditional condit|rational ration
valenci valenc|hesitanci hesit|digitizer digit|conformabli conform|radicalli radic|differentli differ|vileli vile
analogousli analog|vietnamization vietnam|predication predic|operator oper|feudalism feudal|decisiveness decis
hopefulness hope|callousness callous|formaliti formal|sensitiviti sensit|sensibiliti sensibl|triplicate triplic
formative form|formalize formal|electriciti electr|electrical electr|hopeful hope|goodness good|revival reviv
allowance allow|inference infer|airliner airlin|gyroscopic gyroscop|adjustable adjust|defensible defens|irritant irrit
replacement replac|adjustment adjust|dependent depend|adoption adopt|homologou homolog|communism commun|activate activ
angulariti angular|homologous homolog|effective effect|bowdlerize bowdler|probate probat|rate rate|cease ceas
controll control|roll roll|dying die|news news|innings inning|proceed proceed|generously gener|geology geolog
friendly friendli|nicely nice|wonderfully wonder|nationally nation|traditionally tradit|spied spi|died die|stayed stay
playing play|flying fli|trying tri|cry cri|enjoy enjoy|using use|being be|hotels hotel|cleaning clean|rooms room
yellow yellow|is is|as as|y y|2nd 2nd|rooms2 rooms2|say say|syzygy syzygi"""


def test_stems_match_published_examples(spark):
    want = dict(p.split() for line in STEMS.split("\n") for p in line.split("|"))
    assert len(want) >= 100
    rows = spark.createDataFrame([(w,) for w in want], "word string").select("word", porter_stem("word").alias("stem")).collect()
    assert {r.word: r.stem for r in rows} == want


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


# rows, their tokens after stemming
PAIRS = [("The rooms were cleaning", "room was cleaned", ["the", "room", "were", "clean"], ["room", "was", "clean"]),
         ("The rooms were cleaning", "room was cleaned", ["the", "room", "were", "clean"], ["room", "was", "clean"]),
         ("", "", [], []), (None, "staff", [], ["staff"]), ("a: b", "a:b", ["a", "b"], ["a", "b"]),
         ("!!", "??", [], []), ("friendly staff " * 300, "staffed friendliness", ["friendli", "staff"] * 300, ["staf", "friendli"])]


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 0])
def test_stemmed_rouge_matches_brute_force(spark, monkeypatch, broadcast_bytes):
    plain = ME.stemmed_tokens
    monkeypatch.setattr(ME, "stemmed_tokens", lambda *a: plain(*a, broadcast_bytes=broadcast_bytes))
    rows = [(g, p) for g, p, _, _ in PAIRS]
    df = spark.createDataFrame(rows, "g string, p string")
    stem = {r.word: r.stem for r in spark.createDataFrame([("staffed",)], "word string")
            .select("word", porter_stem("word").alias("stem")).collect()}
    want = []
    for _, _, a, b in PAIRS:
        b = [stem["staffed"] if x == "staf" else x for x in b]
        want.append(2 * brute_lcs(a, b) / (len(a) + len(b)) if a or b else 0.0)
    got = ME.rouge_l_stemmed(df, "g", "p").first()
    assert got.n == len(rows) and got.rouge_l == pytest.approx(sum(want) / len(want), abs=2e-6)
    per = {(r.g, r.p): (r.n, r.rouge_l) for r in ME.rouge_pairs(df, "g", "p").collect()}
    assert per["The rooms were cleaning", "room was cleaned"] == (2, pytest.approx(4 / 7))
    empty = ME.rouge_l_stemmed(df.limit(0), "g", "p").first()
    assert (empty.n, empty.rouge_l) == (0, 0.0)


def test_evaluate_gives_sixteen_metrics(spark):
    cols = ["term", "opinion", "category", "polarity"]
    rows = [("Room", "clean", "A", "pos", "rooms", "cleaned", "a", "pos"), ("staff", None, "B", "neg", "Staff", "rude", "a", "neg")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols + ["pred_" + c for c in cols]))
    vec = {"room": [1.0, 0.0], "rooms": [1.0, 1.0], "staff": [0.0, 2.0], "clean": [1.0, 0.0], "cleaned": [0.0, 1.0], "nan": [1.0, 1.0]}
    vectors = spark.createDataFrame(list(vec.items()), "text string, vec array<double>")
    got = {r.metric: r.score for r in ME.evaluate(df, vectors=vectors).collect()}
    assert len(got) == 16
    assert got["term_rouge_l"] == 1.0 and got["opinion_rouge_l"] == 0.5
    assert got["term_embedding_sim"] == pytest.approx((1 / math.sqrt(2) + 1) / 2, abs=1e-6)
    assert got["opinion_embedding_sim"] == 0.0      # 'rude' has no vector: its pair is left out
    assert got["category_accuracy"] == 0.5 and got["polarity_accuracy"] == 1.0
