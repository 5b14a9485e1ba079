"""Training-data operators against brute force, on small tables with every awkward case."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetlens.llm import exact_dedup, line_dedup, packing, pieces, quality, shingle_join, token_store, topk, toxicity
from facetlens.llm.common import shared_path
from facetlens.llm.language import identify_language
from facetlens.llm.tokens import END_ID
from facetlens.llm.training import labelled_sample

P = pytest.importorskip("public_tokenizers")
LONG = " ".join(f"wort{i % 977} again" for i in range(30_000))
TEXTS = [None, "", "   ", "a b c", "a  b\tc", "one two three four five six seven eight nine ten",
         "one two three four five six seven eight nine ten eleven", "x" * 5000, LONG, LONG + " end",
         "naïve café, don't 12 ½ — 你好 <|endoftext|> \x1c sep", "line one\nline two\n\nline one", "12345 !!! ???"]
ROWS = [(i, t, "en" if i % 2 else "de") for i, t in enumerate(TEXTS)] + [
    (3, "a b c", None), (None, "a b c", "fr"), (None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    # extra columns with names the operators use themselves
    return df.select("*", *[F.lit("x").alias(c) for c in ("score", "kept", "sid", "h", "body", "salt", "n", "ids")])


def ids_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return t.encode(text or "", add_special_tokens=False).ids + [END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_store_round_trip(spark, docs):
    path = shared_path(spark, "test-store")
    token_store.write_store(docs, path)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_store.read_store(spark, path).collect())
    want = sorted((i is not None, i or 0, crc(ids_of(t)), len(ids_of(t)), i) for i, t, _ in ROWS)
    assert sorted((i is not None, i or 0, c, n, i) for _, i, n, c in got) == want
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n


def test_frame_decodes_from_checkpoints_and_detects_damage():
    rng = np.random.default_rng(5)
    ids = rng.zipf(1.3, 3 * token_store.BLOCK + 777).clip(0, 49_000).astype(np.uint16)
    raw = token_store.write_frame([1], np.array([len(ids)]), ids)
    frame = token_store.Frame(raw)
    assert (frame.ids() == ids).all()
    got = [frame.block(b, m) for b in range(len(frame.words)) for m in range(len(frame.marks))]
    assert (np.concatenate(got) == ids).all()
    with pytest.raises(ValueError):
        token_store.Frame(raw[:-1] + bytes([raw[-1] ^ 1]))


def test_packing_places_every_id_once(docs):
    rows = packing.pack(docs, cap=64, window=256).collect()
    by_seq, total = {}, 0
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total += r["length"]
    assert total == sum(len(ids_of(t)) for _, t, _ in ROWS)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64 and (at == 64 or at & (at - 1) == 0)
    ids = ids_of(LONG)
    mine = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == 8)
    at = 0
    for start, length, c in mine:
        assert start == at and c == crc(ids[start:start + length])
        at += length
    assert at == len(ids)


def test_exact_dedup_matches_brute_force(spark):
    rng = random.Random(1)
    rows = ROWS + [(100 + i, rng.choice(["hot text", "hot  text", f"own {i}"]), "en") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    got = exact_dedup.exact_dedup(df).collect()
    assert len(got) == len(rows)
    kept = {}
    for r in got:
        kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + r["kept"]
    assert len(kept) == len(groups) and set(kept.values()) == {1}
    want = {(min([x for x in ids if x is not None], default=None), len(ids)) for ids in groups.values()}
    assert {(r["keep_id"], r["group_size"]) for r in got} == want


def brute_components(rows):
    def shingles(t):
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        return frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 75 * len(a | b) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return {i: (len(s), label[i]) for i, s in sets}


@pytest.mark.parametrize("broadcast_ids", [1_000_000, 0])
def test_jaccard_matches_brute_force(spark, broadcast_ids):
    rng = random.Random(4)
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    rows = [(i, t) for i, t, _ in ROWS if i != 3 or t]
    for i in range(90):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(60)] = f"v{i}"
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000 + i, " ".join(base[:30] + [f"z{i}_{k}" for k in range(40)])) for i in range(20)]
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in shingle_join.jaccard_components(df, broadcast_ids=broadcast_ids, group_size=8).collect()
           if r["doc_id"] is not None}
    assert got == brute_components(rows)


def test_jaccard_links_beside_stronger_leaders(spark):
    # chains C-A-B-D of 100 shingles: a passage of all texts and two rare parts, neighbours share one;
    # A and B may each ask their other neighbour, so that A-B is found through the matrix only
    passage = " ".join(f"p{k}" for k in range(76))

    def part(name):
        return " ".join(f"{name}{k}" for k in range(14))

    rows = []
    for c in range(40):
        x, y, z, w, v = (part(f"{p}{c}_") for p in "xyzwv")
        rows += [(4 * c + i, f"{a} {passage} {b}") for i, (a, b) in enumerate([(x, w), (x, y), (z, y), (z, v)])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.jaccard_components(df).collect()}
    want = brute_components(rows)
    assert got == want and all(want[4 * c + i] == (100, 4 * c) for c in range(40) for i in range(4))


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [1.0] * 8),
             (304, rows[0][1]), (350, [1.0, 2.0]), (351, [3.0, 1.0]), (400, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit(1))
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, rows_per_block=64, queries_per_block=3).collect())
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows
            if i is not None and v and None not in v and np.isfinite(np.array(v)).all()]
    want = []
    for i, q in good:
        if i % 50 == 0:
            best = sorted((-int(q @ v), j) for j, v in good if j != i and len(v) == len(q))[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_automaton_matches_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(3)
    terms = list(dict.fromkeys("".join(rng.choice("abcd") for _ in range(rng.randint(3, 13))) for _ in range(60)))
    trie = toxicity.Trie(terms)
    for _ in range(600):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            w.insert(rng.randrange(len(w) + 1), rng.choice("abcde"))
            if rng.random() < 0.7:
                w.pop(rng.randrange(len(w)))
        w = "".join(w)
        best = min(((distance(w, t), k) for k, t in enumerate(terms)
                    if distance(w, t) <= toxicity.edits_allowed(len(t))), default=None)
        assert trie.near(w) == (best and (best[1], best[0]))


def test_quotation_lowers_a_hit():
    seen = toxicity._Seen(toxicity.Trie(["moron"]))
    weight = np.array([5.0])
    plain = toxicity.hits("you are a moron today", seen, weight)[0][0][3]
    quoted = toxicity.hits('the report said "such a moron today" again', seen, weight)[0][0][3]
    assert quoted < plain and toxicity.hits("such a mor0n", seen, weight)[0][0][2] == 1


def test_quotation_state_spans_the_whole_text():
    seen, weight = toxicity._Seen(toxicity.Trie(["moron"])), np.array([5.0])
    filler = "plain words of it " * 20

    def quoted(text):
        return [q for _, _, _, _, q in toxicity.hits(text, seen, weight)[0]]

    # own words behind a long quotation, quoted words far from the mark, and a mark without a partner
    assert quoted(f'he read "{filler}to the end" and you moron') == [False]
    assert quoted(f'he read "{filler}such a moron" and left') == [True]
    assert quoted(f'a 5" pipe, {filler}you moron') == [False]


def test_lexicon_holds_rare_terms_and_no_chance_words(spark):
    """12,000 texts, half of them toxic; a term of 40 texts, words of 3 and 6 toxic texts, copies and near copies."""
    rng = random.Random(4)
    rows = [(int(i % 2), f"text {i} with {'zork' if i % 2 else 'quiet'} w{i * 7919} " + " ".join(f"c{rng.randrange(3000)}" for _ in range(8)))
            for i in range(12_000)]
    rows += [(1, f"text {i}x with quiet snarf w{i * 104729}") for i in range(40)]
    rows += [(1, f"text {i}y with blip w{i * 1299709}") for i in range(3)] + [(1, f"text {i}z quiet blop w{i * 15485863}") for i in range(6)]
    rows += [(1, "copy you blarg")] * 60
    body = " ".join(f"b{i}" for i in range(400))
    rows += [(1, f"n{i} {body} glorp") for i in range(60)]
    got = {w for w, _ in toxicity.learn_lexicon(spark.createDataFrame(rows, "label int, text string"))}
    assert got == {"zork", "snarf"}


def test_labelled_sample_of_one_id_repeated(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(20_000)] + [(2, "two"), (3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1)] * 5000 + [(2, 0), (2, 0), (3, 0), (None, 1), (4, 1)], "doc_id bigint, toxic int")
    got = labelled_sample(docs, labels, "toxic", 6, lambda c: F.lit(False)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == [(1, "text 0", 1), (2, "two", 0), (3, None, 0)]


def test_classifiers_on_awkward_rows(spark, docs):
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((1000 + i, "zork " * 30 if bad else f"The {i} quiet words of text number {i * 7}.", int(not bad), i % 5 == 0))
    extra = spark.createDataFrame([(a, b + (" you snarf" if t else ""), "en") for a, b, _, t in rows],
                                  "doc_id bigint, text string, lang string")
    table = docs.select("doc_id", "text", "lang").union(extra).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(a, q, int(t)) for a, _, q, t in rows] + [(None, 1, 1), (5, None, None)],
                                   "doc_id bigint, quality int, toxic int")
    want = {a: (q, int(t)) for a, _, q, t in rows}
    for name, out in (("q", quality.classify_quality(table, labels)), ("t", toxicity.classify_toxicity(table, labels))):
        got = out.collect()
        assert len(got) == table.count() and all(0 <= r["score"] <= 1 for r in got)
        hit = [r["predicted"] == want[r["doc_id"]][name == "t"] for r in got if r["doc_id"] in want and r["held_out"]]
        assert sum(hit) >= 0.95 * len(hit)
    empty = labels.limit(0)
    assert {r["score"] for r in quality.classify_quality(docs, empty).collect()} == {0.5}
    assert all(r["score"] < 1e-9 for r in toxicity.classify_toxicity(docs, empty).collect())


def test_language(spark, docs):
    en = ["the house and the garden were very green that morning", "where is the nearest shop with good things"]
    de = ["das haus und der garten waren sehr schön heute morgen", "wo ist der nächste laden mit guten sachen"]
    rows = [(1000 + i, f"{(en if i % 2 else de)[i // 2 % 2]} {i}", "en" if i % 2 else "de") for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in identify_language(table.union(docs.where("doc_id <> 3").select("doc_id", "text", "lang"))).collect()}
    assert all(got[i]["lang_pred"] == x for i, _, x in rows)
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[12]["lang_pred"] == "und" and got[12]["score"] == 0
    none = identify_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_pieces_round_trip_and_best_score(docs):
    got = pieces.piece_round_trip(docs).collect()
    assert all(r["round_trip"] in (True, None) for r in got) and sum(r["round_trip"] is None for r in got) == 2
    back = pieces.decode_pieces(pieces.encode_pieces(docs)).where("doc_id = 9").first()["text"]
    assert back == LONG + " end"
    c = pieces.coder()
    score = {p: s for p, (_, _, s) in c.automaton.items()}
    for word in ("thion", "▁international,", "▁the", "▁Wörterbuch", "a|b", "▁naïveté"):
        best = [0.0] + [-np.inf] * len(word)
        for e in range(1, len(word) + 1):
            if word[e - 1] not in c.single:
                best[e] = best[e - 1] + c.unknown
            for s in range(e):
                if word[s:e] in score:
                    best[e] = max(best[e], best[s] + score[word[s:e]])
        assert c.best_path(word)[1] == best[-1]


def test_line_templates(spark):
    rows = [(i, f"own line number words {'x' * i} here\nContact us at user{i}@mail.org for help now\nshort") for i in range(12)]
    rows += [(50, None), (51, ""), (None, "Contact us at user9@mail.org for help now")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit(1))
    for at_once in (2_000_000, 1):
        got = {r["doc_id"]: r for r in line_dedup.drop_recurring_lines(df, least_docs=10, keys_at_once=at_once).collect()}
        assert got[50]["text"] is None and got[51]["text"] == "" and got[None]["n_dropped"] == 1
        # both lines of rows 1 to 11 share a template; row 0 has one token less
        assert {got[i]["text"] for i in range(1, 12)} == {"short"}
        assert got[0]["text"] == "own line number words  here\nshort"


def test_recurring_lines_of_few_documents(spark, tmp_path):
    from facetlens.llm.queries import op5_line_templates

    phone, long = "Tel 030 1234 5678 Fax 030 9999", " ".join(f"passage{c}word" for c in "abcdefgh" * 7)
    rows = [(1, f"alone a\n{phone}\nRead on"), (2, f"alone b\n{phone}\n{long}"), (3, f"alone c\n{long}\nRead  on\n"),
            # copies of one text, and lines of one text, are one document
            (4, "only in copies\nof one text"), (5, "only in copies\nof one text"), (6, "only in copies\nof one text"),
            (7, "\n".join(f"an entry of list {w}" for w in ("red", "green", "blue", "white"))),
            # a template of three texts, in texts of their own
            (8, "order 81 was sent to Ann"), (9, "order 92 was sent to Bob"), (10, "order 7 was sent to Cem"), (None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = {1: "alone a", 2: "alone b", 3: "alone c\n", 8: "", 9: "", 10: "",
            **{i: t for i, t in rows if i in (None, 4, 5, 6, 7)}}
    for at_once in (2_000_000, 0):
        out = line_dedup.drop_recurring_lines(docs, least_docs=3, least_tokens=1, least_same=2, keys_at_once=at_once)
        assert {r["doc_id"]: r["text"] for r in out.collect()} == want
    got = {r["doc_id"]: (r["n_dropped"], r["n_chars_kept"]) for r in op5_line_templates(spark, str(tmp_path)).collect()}
    assert {i: n for i, (_, n) in got.items()} == {i: t if t is None else len(t) for i, t in want.items()}
    assert got[1][0] == got[2][0] == got[3][0] == 2 and got[8][0] == 1


def test_recurring_lines_with_hot_texts_and_lines(spark):
    # 400 copies of one text are salted; one line of 400 texts is joined apart from the others
    rows = [(i, "said once\nin all texts\n\nalso twice") for i in range(400)] + [(None, "said once\nin all texts")]
    own = ["".join("abcdefghij"[int(c)] for c in str(1000 + i)) for i in range(400)]
    rows += [(1000 + i, f"{own[i]}\nin all texts") for i in range(400)] + [(2000, "also  twice\nthe last")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    for at_once in (2_000_000, 0):
        out = line_dedup.drop_recurring_lines(df, least_docs=3, least_tokens=1, least_same=2, keys_at_once=at_once).collect()
        got = {r["doc_id"]: r["text"] for r in out}
        assert len(out) == len(rows) and {got[i] for i in range(400)} == {""} and got[None] == ""
        assert [got[1000 + i] for i in range(400)] == own and got[2000] == "the last"


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    path = shared_path(spark, "test-empty")
    token_store.write_store(none, path)
    frames = [packing.pack(none), exact_dedup.exact_dedup(none), shingle_join.jaccard_components(none),
              token_store.read_store(spark, path), quality.classify_quality(none, labels), identify_language(none),
              toxicity.classify_toxicity(none, labels), pieces.piece_round_trip(none), line_dedup.drop_recurring_lines(none),
              topk.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), F.lit(True))]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_pipeline_stages_keep_columns_and_drop_copies(spark, docs):
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["quality", "language", "exact_dedup", "near_duplicates", "packing"]
    base = docs.select("doc_id", "text", "lang")
    out = C.drop_exact_copies(spark, docs, "")
    assert out.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0d]+", " ", r["text"] or "") for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t, _ in ROWS})
    near = {r["doc_id"] for r in C.drop_near_copies(spark, base, "").collect()}
    assert 8 in near and 9 not in near and 5 in near and 6 not in near


def test_pipeline_tells_texts_under_one_id_apart(spark):
    import corpus_pipeline as C

    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    exact = [(1, "A"), (2, "A"), (2, "B"), (3, "B"), (3, "C"), (None, "A"), (None, "D"), (4, None), (4, "E")]
    near = [(1, a), (2, a + " end"), (2, b), (3, b + " end"), (3, "own text"), (5, c), (5, c + " end"), (5, "other words"),
            (6, c + " end"), (None, a), (7, ""), (7, " ")]
    # two groups that share their smallest id, and one text of each goes
    near += [(10, "p " + a.replace("a", "q")), (10, "p " + a.replace("a", "r")), (11, a.replace("a", "q")), (11, "kept here"),
             (12, a.replace("a", "r"))]

    def left(stage, rows):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("gone_id", F.lit(1))
        return sorted(((r["doc_id"] or 0, r["text"] or "") for r in stage(spark, df, "").collect()))

    assert left(C.drop_exact_copies, exact) == [(0, "D"), (1, "A"), (2, "B"), (3, "C"), (4, ""), (4, "E")]
    got = left(C.drop_near_copies, near)
    five = [t for i, t in got if i == 5]
    assert len(five) == 2 and "other words" in five and len(set(five) & {c, c + " end"}) == 1
    gone = {(2, a + " end"), (3, b + " end"), (6, c + " end"), (11, a.replace("a", "q")), (12, a.replace("a", "r"))}
    assert [x for x in got if x[0] != 5] == sorted((i or 0, t) for i, t in near if i != 5 and (i, t) not in gone)


def test_unrelated_classes_under_one_id_stay_apart(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    # id 9 names texts of two groups
    rows = [(5, a), (9, a + " end"), (9, b), (12, b + " end")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in shingle_join.jaccard_components(df).collect())
    assert got == [(5, 5), (9, 5), (9, 9), (12, 9)]
