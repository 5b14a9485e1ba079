"""Clause splitting, clause audit, model-response parsing and lexicon matching.

Responses belong to one review row, so parsing is done inside the row with
array higher-order functions (split, transform, aggregate, filter) and only
exploded at the end: no shuffle is needed to carry a term forward or to
validate terms against their sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlens.functions.text import (END_MARKER, split_terms, strip_markers, strip_ws,
                                      whole_word_in)
from facetlens.session import cut_lineage, sized_broadcast

# The conjunctions clauses are cut at (rule 2 of the split task).
CLAUSE_CONJUNCTIONS = ["and", "but", "while", "although"]
# Adverbs that stay attached to the word they modify (rule 5).
INTENSIFIERS = ["really", "very", "so", "too", "quite", "extremely", "absolutely", "rather",
                "fairly", "pretty", "incredibly", "particularly", "deeply", "highly"]
# Negative or limiting words kept inside the clause (rule 6).
NEGATIONS = ["nothing", "none", "nobody", "no one", "nowhere", "never", "hardly", "barely",
             "scarcely", "without", "no", "not"]

TERM_MARKER = "| Term:"
_NOT_WORD = r"[^\p{L}\p{N}_]"
# Cut at runs of sentence punctuation / newlines, or at a conjunction standing
# between non-word characters (the surrounding character is consumed; pieces
# are stripped afterwards, so clauses stay continuous substrings).
CLAUSE_SPLIT_PATTERN = (r"(?i)[.,;:!?\n]+|(?:^|" + _NOT_WORD + r")(?:"
                        + "|".join(CLAUSE_CONJUNCTIONS) + r")(?:" + _NOT_WORD + r"|$)")


def clause_array(text) -> Column:
    """Array of struct(pos, clause): non-blank stripped pieces with their piece index."""
    pieces = F.split(text if isinstance(text, Column) else F.col(text), CLAUSE_SPLIT_PATTERN)
    tagged = F.transform(pieces, lambda p, i: F.struct(i.alias("pos"), strip_ws(p).alias("clause")))
    return F.filter(tagged, lambda s: s["clause"] != "")


def split_clauses(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per clause: (key, clause_pos, clause). Narrow: no shuffle."""
    return (df.select(key, F.explode(clause_array(text_col)).alias("c"))
            .select(key, F.col("c.pos").alias("clause_pos"), F.col("c.clause").alias("clause")))


def audit_clauses(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per review: clause count, every clause a substring of the sentence,
    share of the sentence's non-space characters covered by clauses, no blank clause."""
    t = F.col(text_col)
    df = df.select(key, text_col, clause_array(text_col).alias("_arr"))  # split once
    arr = F.col("_arr")
    nonspace = lambda c: F.length(F.regexp_replace(c, r"\s", ""))
    covered = F.aggregate(F.transform(arr, lambda s: nonspace(s["clause"])), F.lit(0),
                          lambda a, b: a + b)
    return df.select(
        key,
        F.size(arr).alias("n_clauses"),
        all_found(arr, t).alias("all_substrings"),
        F.forall(arr, lambda s: s["clause"] != "").alias("no_blank"),
        F.round(F.try_divide(covered.cast("double"), nonspace(t).cast("double")), 6).alias("coverage"),
    )


def all_found(arr: Column, text: Column) -> Column:
    """True if every clause occurs in the text; each search goes on behind the last match.

    What is left of the text is kept as bytes, which are cut without counting
    characters, so clauses in text order cost one scan of the text; a clause
    that is not found ahead is looked for in the whole text.
    """
    start = F.struct(text.cast("binary").alias("rest"), F.lit(True).alias("ok"))

    def search(acc: Column, s: Column) -> Column:
        return F.struct(acc.alias("acc"), s["clause"].alias("clause"), F.instr(acc["rest"].cast("string"), s["clause"]).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        def put(x: Column) -> Column:
            rest, clause, at = x["acc"]["rest"], x["clause"], x["at"]
            behind = F.octet_length(F.left(rest.cast("string"), at - 1)) + F.octet_length(clause) + 1
            return F.when(at > 0, F.struct(F.substring(rest, behind, F.octet_length(rest)).alias("rest"), x["acc"]["ok"].alias("ok"))).otherwise(
                F.struct(rest.alias("rest"), (x["acc"]["ok"] & (F.instr(text, clause) > 0)).alias("ok")))

        return F.transform(F.array(search(acc, s)), put)[0]

    return F.coalesce(F.aggregate(arr, start, step, lambda acc: acc["ok"]), arr.isNull())


# ---------------------------------------------------------------- response parsing

def _response_lines(resp) -> Column:
    lines = F.transform(F.split(resp, "\n"), lambda x: strip_ws(x))
    return F.filter(lines, lambda x: x != "")


def parsed_clause_array(resp) -> Column:
    """Parse a split/term response into array<struct(clause, term, n_markers)>.

    A line with the marker is cut into clause and term (``Clause:`` removed);
    a line without it is a clause verbatim. A blank or missing term takes the
    most recent non-blank term of an earlier line; before any, ''. Every given
    term is repeated up to the next one, so the cost is linear in the lines.
    """
    r = resp if isinstance(resp, Column) else F.col(resp)

    marker, size = F.lit(TERM_MARKER), len(TERM_MARKER)

    def cut(line):   # bytes are compared: a pattern would be compiled for every line
        return F.struct(line.alias("line"), F.substring_index(line, TERM_MARKER, 1).alias("head"),
                        ((F.octet_length(line) - F.octet_length(F.replace(line, marker, F.lit("")))) / size).cast("int").alias("n_markers"))

    def filled(x):
        has = x["n_markers"] > 0
        behind = F.substring_index(F.substring(x["line"], F.char_length(x["head"]) + size + 1, F.lit(1 << 30)), TERM_MARKER, 1)
        return F.struct(F.when(has, strip_ws(F.replace(x["head"], F.lit("Clause:"), F.lit("")))).otherwise(x["line"]).alias("clause"),
                        F.when(has, strip_ws(behind)).alias("given"), x["n_markers"].alias("n_markers"))

    def one(x):
        return F.struct(x["clause"], F.when(x["given"] != "", x["given"]).alias("given"), x["n_markers"])

    # each step binds its array once: lambdas only read finished values
    def found(items: Column) -> Column:
        places = F.transform(items, lambda it, i: F.when(it["given"].isNotNull(), i))
        return F.struct(items.alias("items"), F.filter(places, lambda p: p.isNotNull()).alias("at"))

    def bounded(x: Column) -> Column:
        n = F.size(x["items"])
        return F.struct(x["items"].alias("items"), x["at"].alias("at"), F.coalesce(F.get(x["at"], 0), n).alias("first"),
                        F.concat(F.slice(x["at"], 2, 1 << 30), F.array(n)).alias("ends"))

    def carried(x: Column) -> Column:
        runs = F.zip_with(x["at"], F.slice(x["ends"], 1, F.size(x["at"])),
                          lambda p, e: F.array_repeat(F.get(x["items"], p)["given"], e - p))
        terms = F.flatten(F.concat(F.array(F.array_repeat(F.lit(""), x["first"])), runs))
        return F.zip_with(x["items"], terms, lambda it, t: F.struct(
            it["clause"].alias("clause"), t.alias("term"), it["n_markers"].alias("n_markers")))

    whole = F.array(F.transform(F.transform(F.transform(_response_lines(r), cut), filled), one))
    return F.transform(F.transform(F.transform(whole, found), bounded), carried)[0]


def parse_clauses(df: DataFrame, key: str, resp_col: str = "response",
                  keep: list[str] | None = None) -> DataFrame:
    """(key, response) -> one row per clause (key, clause_pos, clause, term, n_markers)."""
    keep = keep or []
    return (df.select(key, *keep, F.posexplode(parsed_clause_array(F.col(resp_col))).alias("clause_pos", "c"))
            .select(key, *keep, "clause_pos", F.col("c.clause").alias("clause"),
                    F.col("c.term").alias("term"), F.col("c.n_markers").alias("n_markers")))


def refine_terms_array(arr, sentence, lowered: bool = False) -> Column:
    """End marker off the last clause's term; keep comma items that occur
    (case-insensitive substring) in the sentence; join with ','.
    Pass column references: they are read once per clause."""
    n = F.size(arr)
    low = sentence if lowered else F.lower(sentence)

    def fix(c, i):
        term = F.when(i == n - 1, strip_ws(F.replace(c["term"], F.lit(END_MARKER), F.lit("")))).otherwise(c["term"])
        kept = F.filter(split_terms(term), lambda t: F.contains(low, F.lower(t)))
        return F.struct(c["clause"].alias("clause"), F.array_join(kept, ",").alias("term"),
                        c["n_markers"].alias("n_markers"))

    return F.transform(arr, fix)


def split_and_refine(df: DataFrame, key: str, sentence_col: str, resp_col: str = "response",
                     keep: list[str] | None = None) -> DataFrame:
    """Split path: parse + refine, one row per clause with the sentence kept.

    The parsed array and the lower-cased sentence are projected first, so the
    per-clause lambda reads them instead of recomputing them per element.
    """
    keep = keep or []
    pre = df.select(key, sentence_col, *keep, parsed_clause_array(F.col(resp_col)).alias("_arr"),
                    F.lower(F.col(sentence_col)).alias("_low"))
    arr = refine_terms_array(F.col("_arr"), F.col("_low"), lowered=True)
    return (pre.select(key, sentence_col, *keep, F.posexplode(arr).alias("clause_pos", "c"))
            .select(key, F.col(sentence_col).alias("sentence_original"), *keep, "clause_pos",
                    F.col("c.clause").alias("clause"), F.col("c.term").alias("term"),
                    F.col("c.n_markers").alias("n_markers")))


def validated_list(resp, sentence, label: str, joiner: str = ", ") -> Column:
    """Markers off, split on ',', keep whole-word (case-insensitive) matches
    in ``sentence``, join with ``joiner``."""
    items = split_terms(strip_markers(resp, label))
    return F.array_join(F.filter(items, lambda t: whole_word_in(t, sentence)), joiner)


def parse_terms(df: DataFrame, sentence_col: str, resp_col: str = "response") -> DataFrame:
    """Whole-sentence term parse: adds ``term`` (", "-joined)."""
    return df.withColumn("term", validated_list(F.col(resp_col), F.col(sentence_col), "Term"))


def parse_opinions(df: DataFrame, sentence_col: str, resp_col: str = "opinion_response") -> DataFrame:
    """Opinion parse validated against the original sentence: adds ``opinion``."""
    return df.withColumn("opinion", validated_list(F.col(resp_col), F.col(sentence_col), "Opinion"))


# ---------------------------------------------------------------- lexicon match

LEXICON_TOKEN_SPLIT = r"[^\p{L}\p{N}']+"


def lexicon_tokens(text_col) -> Column:
    """Lower-cased runs of letters, digits and apostrophes."""
    return F.filter(F.split(F.lower(F.col(text_col)), LEXICON_TOKEN_SPLIT), lambda x: x != "")


def grams_of(toks: Column, test=None) -> Column:
    """array<struct(pos, entry)>: unigrams of a token column at even, bigrams at odd positions; with ``test``,
    those whose entry it accepts."""
    uni = F.transform(toks, lambda t, i: F.struct((i * 2).alias("pos"), t.alias("entry")))
    pairs = F.zip_with(toks, F.slice(toks, 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
    bi = F.transform(pairs, lambda x, i: F.struct((i * 2 + 1).alias("pos"), x.alias("entry")))
    if test is None:
        return F.concat(uni, F.filter(bi, lambda s: s["entry"].isNotNull()))
    return F.concat(F.filter(uni, lambda s: test(s["entry"])), F.filter(bi, lambda s: s["entry"].isNotNull() & test(s["entry"])))


def lexicon_grams(df: DataFrame, key: str = "doc_id", text_col: str = "text",
                  keep: list[str] | None = None) -> DataFrame:
    """(key, pos, entry): unigrams at even and bigrams at odd positions, in
    text order, exploded inside each row (no shuffle)."""
    keep = keep or []
    toks = df.select(key, *keep, lexicon_tokens(text_col).alias("_toks"))
    return toks.select(key, *keep, F.explode(grams_of(F.col("_toks"))).alias("g")).select(key, *keep, "g.pos", "g.entry")


def frequent_lexicon(df: DataFrame, text_col: str = "text", k_uni: int = 30, k_bi: int = 10, first: int = 500,
                     most: int = 2000) -> DataFrame:
    """(entry): the ``k_uni`` most frequent unigrams and ``k_bi`` most frequent
    bigrams (ties by entry). Bounded by k_uni + k_bi rows.

    A bigram occurs at most as often as either of its words. Bigrams of the ``first`` most frequent words
    are counted first; the ``k_bi``-th best of them bounds the result from below, so only bigrams of words
    that reach this count can belong to it. They are counted as well when some of their words were left out;
    should more than ``most`` words reach it, every bigram is counted.
    """
    toks = df.select(lexicon_tokens(text_col).alias("t"))
    words = toks.select(F.explode("t").alias("entry")).groupBy("entry").agg(F.count(F.lit(1)).alias("n")).cache()
    best = [F.desc("n"), F.asc("entry")]

    def bigrams(among: list[str] | None) -> DataFrame:
        t = F.col("t")
        pairs = F.zip_with(t, F.slice(t, 2, 1 << 30), lambda a, b: F.when(
            b.isNotNull() if among is None else a.isin(among) & b.isin(among), F.concat(a, F.lit(" "), b)))
        return toks.select(F.explode(F.filter(pairs, lambda x: x.isNotNull())).alias("entry")).groupBy("entry").agg(
            F.count(F.lit(1)).alias("n")).orderBy(*best).limit(k_bi)

    top = [r["entry"] for r in words.orderBy(*best).limit(first).collect()]
    bi = cut_lineage(bigrams(top)) if top else words.limit(0)
    found = [r["n"] for r in bi.select("n").collect()]
    least = min(found) if len(found) == k_bi else 1
    enough = words.where(F.col("n") >= least).limit(most + 1).collect()
    if len(enough) > most:
        bi = bigrams(None)
    elif not {r["entry"] for r in enough} <= set(top):
        bi = bigrams([r["entry"] for r in enough])
    return words.orderBy(*best).limit(k_uni).select("entry").union(bi.select("entry")).distinct()


def match_lexicon(df: DataFrame, lexicon: DataFrame, key: str = "doc_id", text_col: str = "text",
                  max_broadcast_rows: int = 5_000_000, max_listed: int = 1_000) -> DataFrame:
    """Unigram and bigram lexicon hits per review, in text order.

    Up to ``max_listed`` entries are looked for inside each row. For a longer
    lexicon grams are exploded per row and equi-joined with it (broadcast when
    its size is proven small, shuffled otherwise). Only the hits are
    regrouped, so the regroup shuffle carries matches, not text.
    Output: (key, n_hits, hits) with hits joined by ', '; a review without
    hits has n_hits 0 and ''.
    """
    lex = lexicon.select(F.lower("entry").alias("entry")).where("entry is not null").distinct()
    listed = [r["entry"] for r in lex.limit(max_listed + 1).collect()]
    if len(listed) <= max_listed:
        toks = df.select(key, lexicon_tokens(text_col).alias("_toks"))
        hits = toks.select(key, F.explode(grams_of(F.col("_toks"), lambda x: x.isin(listed))).alias("g")).select(key, "g.pos", "g.entry")
    else:
        hits = lexicon_grams(df, key, text_col).join(sized_broadcast(lex, max_broadcast_rows), "entry")
    found = (hits.groupBy(key)
             .agg(F.count(F.lit(1)).alias("n_hits"),
                  F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "entry"))),
                                           lambda s: s["entry"]), ", ").alias("hits")))
    return df.select(key).join(found, key, "left").select(
        key, F.coalesce("n_hits", F.lit(0).cast("bigint")).alias("n_hits"), F.coalesce("hits", F.lit("")).alias("hits"))
