"""Registered queries: one per operator, each reading whole driver tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the operator through the
library; ``SQL[name]`` is an independent DuckDB statement over the same
tables that must give the same rows (omitted only where the operator is not
expressible as one SQL statement; those are checked in pytest).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlens.functions import text as T
from facetlens.functions.stem import porter_stems
from facetlens.operators import agreement as AG
from facetlens.operators import answers as AN
from facetlens.operators import clauses as CL
from facetlens.operators import classify as CF
from facetlens.operators import hygiene as HY
from facetlens.operators import metrics as ME
from facetlens.operators import reporting as RP
from facetlens.operators.model_stage import RuleBackend, run_model
from facetlens.plans import fixtures as FX
from facetlens.plans import sqlfrag as S
from facetlens.session import cut_lineage
from facetlens.sources import readers as RD
from facetlens.sources import sinks as SK

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return deco


def tbl(spark, sf, name):
    return RD.load_table(spark, sf, name)


# ============================================================ A. sources

@query("scan_reviews", """
SELECT doc_id, lang, source, n_chars, length(text) AS text_len FROM documents
""")
def q_scan_reviews(spark, sf):
    df = RD.read_reviews(spark, f"{sf}/documents.parquet", "parquet")
    return df.select("doc_id", "lang", "source", "n_chars", F.length("text").alias("text_len"))


@query("resolve_text_col", """
SELECT doc_id, text AS review_text FROM documents
""")
def q_resolve_text_col(spark, sf):
    df = RD.with_text(tbl(spark, sf, "documents"))
    return df.select("doc_id", "review_text")


_LINES_SQL = f"""
SELECT doc_id, line_pos, {S.strip('raw')} AS line FROM (
  SELECT doc_id, unnest(string_split(text, {S.NL})) AS raw,
         generate_subscripts(string_split(text, {S.NL}), 1) - 1 AS line_pos
  FROM documents)
WHERE {S.strip('raw')} <> ''
"""


@query("explode_lines", _LINES_SQL)
def q_explode_lines(spark, sf):
    return RD.explode_lines(tbl(spark, sf, "documents"), "text", keep=["doc_id"])


@query("flatten_nested", f"""
SELECT conv_id, review_pos, sentence_pos, sentence FROM (
  SELECT conv_id, review_pos, unnest(string_split(text, {S.NL})) AS sentence,
         generate_subscripts(string_split(text, {S.NL}), 1) - 1 AS sentence_pos
  FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS review_pos
        FROM conversations))
""")
def q_flatten_nested(spark, sf):
    cv = tbl(spark, sf, "conversations")
    nested = cv.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "turn", F.split("text", "\n").alias("sentences")))).alias("reviews"))
    return RD.flatten_reviews(nested, "reviews", keep=["conv_id"])


@query("union_parts", """
SELECT doc_id, lang, CASE WHEN lang = 'en' THEN NULL ELSE source END AS source, n_chars FROM documents
""")
def q_union_parts(spark, sf):
    docs = tbl(spark, sf, "documents")
    langs = ["de", "en", "es", "fr"]
    parts = [docs.where(F.col("lang") == l).select("doc_id", "lang", "n_chars", *([] if l == "en" else ["source"]))
             for l in langs]
    other = docs.where(~F.coalesce(F.col("lang").isin(langs), F.lit(False))).select("doc_id", "lang", "n_chars", "source")
    return RD.union_parts(parts + [other]).select("doc_id", "lang", "source", "n_chars")


_CLAUSE_SPLIT_SQL = "'" + CL.CLAUSE_SPLIT_PATTERN.replace("'", "''") + "'"
_CLAUSES_SQL = f"""
SELECT doc_id, clause_pos, clause FROM (
  SELECT doc_id, generate_subscripts(regexp_split_to_array(text, {_CLAUSE_SPLIT_SQL}), 1) - 1 AS clause_pos,
         {S.strip(f"unnest(regexp_split_to_array(text, {_CLAUSE_SPLIT_SQL}))")} AS clause
  FROM documents)
WHERE clause <> ''
"""


@query("nest_aspects", f"""
SELECT doc_id, count(*) AS n_aspects, string_agg(clause, ' | ' ORDER BY clause_pos) AS joined
FROM ({_CLAUSES_SQL}) GROUP BY doc_id
""")
def q_nest_aspects(spark, sf):
    cl = CL.split_clauses(tbl(spark, sf, "documents"), "doc_id", "text")
    n = SK.nest_aspects(cl, "doc_id", "clause_pos", ["clause"])
    return n.select("doc_id", F.size("aspects").alias("n_aspects"),
                    F.array_join(F.transform("aspects", lambda a: a["clause"]), " | ").alias("joined"))


@query("intake_filter", f"""
SELECT doc_id, length({S.strip("coalesce(text, '')")}) AS text_len FROM documents
WHERE length({S.strip("coalesce(text, '')")}) >= 3
""")
def q_intake_filter(spark, sf):
    df = RD.intake_filter(tbl(spark, sf, "documents"), "text", "doc_id", cap=None)
    return df.select("doc_id", F.length("text").alias("text_len"))


@query("intake_cap", f"""
SELECT doc_id, length(t) AS text_len FROM (
  SELECT doc_id, {S.strip("coalesce(text, '')")} AS t FROM documents ORDER BY doc_id LIMIT 200)
WHERE length(t) >= 3
""")
def q_intake_cap(spark, sf):
    df = RD.intake_filter(tbl(spark, sf, "documents"), "text", "doc_id", cap=200)
    return df.select("doc_id", F.length("text").alias("text_len"))


@query("resume_offset", """
SELECT doc_id, lang FROM documents ORDER BY doc_id OFFSET 700
""")
def q_resume_offset(spark, sf):
    return RD.resume_from(tbl(spark, sf, "documents").select("doc_id", "lang"), 700, "doc_id")


@query("resume_anti", """
SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def q_resume_anti(spark, sf):
    return RD.resume_anti(tbl(spark, sf, "documents").select("doc_id", "lang"), tbl(spark, sf, "labels"), "doc_id")


@query("project_result", """
SELECT doc_id + 1 AS sentence_index, text AS "Original Sentence", lang AS "Category", source AS "Polarity"
FROM documents
""")
def q_project_result(spark, sf):
    d = tbl(spark, sf, "documents").select(
        (F.col("doc_id") + 1).alias("sentence_index"), F.col("text").alias("sentence_original"),
        F.col("lang").alias("category"), F.col("source").alias("polarity"))
    return RD.project_result(d, SK.RESULT_COLUMNS, SK.DISPLAY_NAMES)


# ============================================================ B. text scalars and hygiene

@query("clean_text", f"""
SELECT doc_id, {S.clean('text')} AS clean FROM documents
""")
def q_clean_text(spark, sf):
    return tbl(spark, sf, "documents").select("doc_id", T.clean_text("text").alias("clean"))


@query("clean_pages", f"""
SELECT page_id, {S.clean("concat_ws(' ', url, html)")} AS clean FROM pages
""")
def q_clean_pages(spark, sf):
    return tbl(spark, sf, "pages").select("page_id", T.clean_text(F.concat_ws(" ", "url", "html")).alias("clean"))


@query("sql_functions", f"""
SELECT doc_id, {S.clean('text')} AS cleaned, {S.strip('lower(lang)')} AS lang,
       length({S.strip("lower(text)")}) AS n_normal FROM documents WHERE {S.clean('text')} <> ''
""")
def q_sql_functions(spark, sf):
    from facetlens.functions.sqlnames import register_sql_functions

    register_sql_functions(spark)
    tbl(spark, sf, "documents").createOrReplaceTempView("named_documents")
    return spark.sql("SELECT doc_id, clean_text(text) AS cleaned, normalize_text(lang) AS lang, "
                     "length(normalize_text(text)) AS n_normal FROM named_documents WHERE clean_text(text) <> ''")


@query("normalize_text", f"""
SELECT doc_id, {S.strip('lower(text)')} AS norm FROM documents
""")
def q_normalize_text(spark, sf):
    return tbl(spark, sf, "documents").select("doc_id", T.normalize("text").alias("norm"))


@query("lower_all", """
SELECT o_orderkey, o_custkey, lower(o_orderstatus) AS o_orderstatus, o_totalprice, o_orderdate,
       lower(o_orderpriority) AS o_orderpriority FROM orders
""")
def q_lower_all(spark, sf):
    return HY.lower_strings(tbl(spark, sf, "orders"))


@query("dash_to_space", """
SELECT o_orderkey, replace(coalesce(o_orderstatus, 'nan'), '-', ' ') AS o_orderstatus,
       replace(coalesce(o_orderpriority, 'nan'), '-', ' ') AS o_orderpriority FROM orders
""")
def q_dash_to_space(spark, sf):
    o = tbl(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return HY.replace_literal(o, "-", " ")


@query("word_count", f"""
SELECT doc_id, len({S.tokens('text')}) AS n_words FROM documents
""")
def q_word_count(spark, sf):
    return tbl(spark, sf, "documents").select("doc_id", T.word_count("text").alias("n_words"))


@query("short_rows", f"""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE len({S.tokens('text')}) < 2) AS n_short,
       count(*) FILTER (WHERE len({S.tokens('text')}) >= 2) AS n_kept FROM documents
""")
def q_short_rows(spark, sf):
    return HY.short_row_report(tbl(spark, sf, "documents"), "text")


@query("drop_short", f"""
SELECT doc_id FROM documents WHERE len({S.tokens('text')}) >= 2
""")
def q_drop_short(spark, sf):
    return HY.drop_short(tbl(spark, sf, "documents"), "text").select("doc_id")


@query("remap_labels", """
SELECT CASE WHEN event_type = 'click' THEN 'view' ELSE event_type END AS event_type, count(*) AS n
FROM events GROUP BY 1
""")
def q_remap_labels(spark, sf):
    ev = HY.remap_labels(tbl(spark, sf, "events"), "event_type", {"click": "view"})
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("fill_defaults", """
SELECT e.event_id, coalesce(CAST(l.toxic AS VARCHAR), '') AS polarity, '' AS opinion,
       coalesce(CAST(l.quality AS DOUBLE), 0.0) AS category_score, 0.0 AS polarity_score
FROM events e LEFT JOIN labels l ON l.doc_id = e.user_id
""")
def q_fill_defaults(spark, sf):
    ev = tbl(spark, sf, "events").select("event_id", "user_id")
    lb = tbl(spark, sf, "labels").select(F.col("doc_id").alias("user_id"), F.col("quality").alias("category_score"),
                                         F.col("toxic").cast("string").alias("polarity"))
    j = ev.join(lb, "user_id", "left")
    out = HY.fill_defaults(j, ["polarity", "opinion"], ["category_score", "polarity_score"])
    return out.select("event_id", "polarity", "opinion", "category_score", "polarity_score")


@query("coerce_text", """
SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE text IS NOT NULL AND text <> ''), '')
       AS coerced, CAST(max(turn) AS VARCHAR) AS last_turn
FROM conversations GROUP BY conv_id
""")
def q_coerce_text(spark, sf):
    cv = tbl(spark, sf, "conversations")
    g = cv.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns"),
                                  F.max("turn").alias("last"))
    return g.select("conv_id", T.coerce_array_text(F.transform("turns", lambda s: s["text"])).alias("coerced"),
                    T.coerce_scalar_text("last").alias("last_turn"))


@query("strip_markers", f"""
WITH d AS (SELECT doc_id, {S.tokens('text')} AS tk FROM documents)
SELECT doc_id, {S.strip_markers("'Term: ' || coalesce(tk[1], '') || ', ' || translate(coalesce(tk[3], ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || ', zzqx, ' || coalesce(tk[5], '') || '<|im_end|>'", 'Term')} AS stripped
FROM d
""")
def q_strip_markers(spark, sf):
    d = tbl(spark, sf, "documents")
    return d.select("doc_id", T.strip_markers(AN.rule_list_response("text", "Term"), "Term").alias("stripped"))


@query("distinct_labels", "SELECT DISTINCT event_type FROM events")
def q_distinct_labels(spark, sf):
    return HY.distinct_labels(tbl(spark, sf, "events"), "event_type")


@query("drill_down", """
SELECT event_id, event_type, CASE WHEN value < 20 THEN 'Negative' WHEN value < 60 THEN 'Neutral'
       ELSE 'Positive' END AS polarity
FROM events WHERE event_type IN ('click', 'purchase') AND value >= 60
""")
def q_drill_down(spark, sf):
    ev = HY.drill(tbl(spark, sf, "events"), "event_type", values=["click", "purchase"])
    ev = ev.withColumn("polarity", RP.bucket_polarity("value"))
    return HY.drill(ev, "polarity", equals="Positive").select("event_id", "event_type", "polarity")


# ============================================================ C. clauses, responses, parsing

_SPLIT_RESP_SQL = f"""
l AS (SELECT doc_id, text, lang, list_filter(list_transform(string_split(text, {S.NL}), lambda x: {S.strip('x')}),
                                          lambda x: x <> '') AS lines FROM documents),
r AS (SELECT doc_id, text, lang, array_to_string(list_transform(lines, lambda l, k: CASE
        WHEN (k - 1) % 9 = 8 THEN 'Clause: ' || l || ' | Term: ' || {S.first_word('l')} || ' | Term: ' || {S.first_word('l')}
        WHEN (k - 1) % 4 = 3 THEN l
        ELSE 'Clause: ' || l || ' | Term: ' || CASE WHEN (k - 1) % 4 = 1 THEN '' ELSE {S.first_word('l')} END
      END), {S.NL}) || '<|im_end|>' AS response FROM l),
p AS (SELECT doc_id, text, list_filter(list_transform(string_split(response, {S.NL}), lambda x: {S.strip('x')}),
                                    lambda x: x <> '') AS rl FROM r),
u AS (SELECT doc_id, text, unnest(rl) AS line, generate_subscripts(rl, 1) - 1 AS clause_pos FROM p),
v AS (SELECT doc_id, text, clause_pos, line, string_split(line, '| Term:') AS parts,
             instr(line, '| Term:') > 0 AS has FROM u),
w AS (SELECT doc_id, text, clause_pos,
             CASE WHEN has THEN {S.strip("replace(parts[1], 'Clause:', '')")} ELSE line END AS clause,
             CASE WHEN has AND {S.strip('parts[2]')} <> '' THEN {S.strip('parts[2]')} END AS given,
             len(parts) - 1 AS n_markers FROM v),
parsed AS (SELECT doc_id, text, clause_pos, clause, n_markers,
             coalesce(last_value(given IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY clause_pos
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS term FROM w)
"""


def _split_responses(spark, sf):
    d = tbl(spark, sf, "documents")
    return d.select("doc_id", "text", "lang", AN.rule_split_response("text").alias("response"))


@query("parse_clauses", f"WITH {_SPLIT_RESP_SQL} SELECT doc_id, clause_pos, clause, term, n_markers FROM parsed")
def q_parse_clauses(spark, sf):
    return CL.parse_clauses(_split_responses(spark, sf), "doc_id")


@query("refine_terms", f"""
WITH {_SPLIT_RESP_SQL}
SELECT doc_id, clause_pos, clause,
       array_to_string(list_filter({S.split_terms('t2')}, lambda x: instr(lower(text), lower(x)) > 0), ',') AS term
FROM (SELECT *, CASE WHEN clause_pos = max(clause_pos) OVER (PARTITION BY doc_id)
                     THEN {S.strip("replace(term, '<|im_end|>', '')")} ELSE term END AS t2 FROM parsed)
""")
def q_refine_terms(spark, sf):
    out = CL.split_and_refine(_split_responses(spark, sf), "doc_id", "text")
    return out.select("doc_id", "clause_pos", "clause", "term")


@query("quarantine_counts", f"""
WITH {_SPLIT_RESP_SQL}
SELECT status, count(*) AS n_docs, sum(n_clauses) AS n_clauses FROM (
  SELECT doc_id, CASE WHEN max(n_markers) > 1 THEN 'error' ELSE 'ok' END AS status, count(*) AS n_clauses
  FROM parsed GROUP BY doc_id) GROUP BY status
""")
def q_quarantine_counts(spark, sf):
    parsed = CL.parse_clauses(_split_responses(spark, sf), "doc_id")
    per_doc = parsed.groupBy("doc_id").agg(F.max("n_markers").alias("n_markers"),
                                           F.count(F.lit(1)).alias("n_clauses"))
    good, bad = AN.quarantine(AN.with_status(per_doc))
    both = good.unionByName(bad)
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_clauses").alias("n_clauses"))


_RESP_LIST_SQL = ("'{label}: ' || coalesce(tk[1], '') || ', ' || translate(coalesce(tk[3], ''), "
                  "'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || ', zzqx, ' || "
                  "coalesce(tk[5], '') || '<|im_end|>'")


def _validated_sql(label: str, out: str) -> str:
    resp = _RESP_LIST_SQL.format(label=label)
    return f"""
WITH d AS (SELECT doc_id, text, {S.tokens('text')} AS tk FROM documents),
r AS (SELECT doc_id, text, {resp} AS resp FROM d)
SELECT doc_id, array_to_string(list_filter({S.split_terms(S.strip_markers('resp', label))},
                                           lambda t: {S.whole_word('t', 'text')}), ', ') AS {out} FROM r
"""


@query("parse_terms", _validated_sql("Term", "term"))
def q_parse_terms(spark, sf):
    d = tbl(spark, sf, "documents")
    d = d.withColumn("response", AN.rule_list_response("text", "Term"))
    return CL.parse_terms(d, "text").select("doc_id", "term")


@query("parse_opinions", _validated_sql("Opinion", "opinion"))
def q_parse_opinions(spark, sf):
    d = tbl(spark, sf, "documents")
    d = d.withColumn("opinion_response", AN.rule_list_response("text", "Opinion"))
    return CL.parse_opinions(d, "text").select("doc_id", "opinion")


@query("split_clauses", _CLAUSES_SQL)
def q_split_clauses(spark, sf):
    return CL.split_clauses(tbl(spark, sf, "documents"), "doc_id", "text")


@query("audit_clauses", f"""
WITH c AS ({_CLAUSES_SQL}),
a AS (SELECT c.doc_id, count(*) AS n, bool_and(instr(d.text, c.clause) > 0) AS subs, bool_and(c.clause <> '') AS nb,
             sum(length(regexp_replace(c.clause, '\\s', '', 'g'))) AS cov
      FROM c JOIN documents d USING (doc_id) GROUP BY c.doc_id)
SELECT d.doc_id, coalesce(a.n, 0) AS n_clauses, coalesce(a.subs, true) AS all_substrings,
       coalesce(a.nb, true) AS no_blank,
       round(CAST(coalesce(a.cov, 0) AS DOUBLE) / nullif(length(regexp_replace(d.text, '\\s', '', 'g')), 0), 6) AS coverage
FROM documents d LEFT JOIN a USING (doc_id)
""")
def q_audit_clauses(spark, sf):
    return CL.audit_clauses(tbl(spark, sf, "documents"), "doc_id", "text")


def _fill_sql(template: str, **cols: str) -> str:
    parts, rest = [], template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        parts += [S.q(head), f"coalesce({cols[name]}, '')"]
    parts.append(S.q(rest))
    return " || ".join(parts)


@query("build_prompts", f"""
SELECT doc_id, length({_fill_sql(AN.PROMPT_TEMPLATES['term'], text='text')}) AS term_prompt_len,
       length({_fill_sql(AN.PROMPT_TEMPLATES['opinion'], text='text', term=S.first_word('text'))}) AS opinion_prompt_len,
       instr({_fill_sql(AN.PROMPT_TEMPLATES['split'], text='text')}, text) > 0 AS has_text
FROM documents
""")
def q_build_prompts(spark, sf):
    d = tbl(spark, sf, "documents").withColumn("first_term", AN.first_word("text"))
    return d.select("doc_id",
                    F.length(AN.build_prompt("term", "text")).alias("term_prompt_len"),
                    F.length(AN.build_prompt("opinion", "text", "first_term")).alias("opinion_prompt_len"),
                    (F.instr(AN.build_prompt("split", "text"), F.col("text")) > 0).alias("has_text"))


@query("model_stage", f"""
SELECT doc_id, CASE WHEN {S.strip('text')} <> '' THEN 'Term: ' || {S.first_word('text')} END AS response,
       CASE WHEN {S.strip('text')} <> '' THEN 'ok' ELSE 'skipped' END AS model_status
FROM documents
""")
def q_model_stage(spark, sf):
    d = tbl(spark, sf, "documents").select("doc_id", "text")
    return run_model(d, RuleBackend("term"), "text").select("doc_id", "response", "model_status")


_ITEMS_SQL = f"""
c AS ({_CLAUSES_SQL}),
i AS (SELECT doc_id, clause, {S.first_word('clause')} AS term,
             row_number() OVER (PARTITION BY doc_id ORDER BY clause_pos) - 1 AS n FROM c),
items AS (SELECT doc_id, n // 32 AS batch_id, n % 32 + 1 AS item_no, clause, term FROM i)
"""


@query("batch_prompts", f"""
WITH {_ITEMS_SQL}
SELECT doc_id, batch_id, count(*) AS n_items,
       {S.q(AN.BATCH_HEADER)} || string_agg(item_no || '. [' || term || '] ' || clause, {S.NL} ORDER BY item_no) || {S.q(AN.BATCH_FOOTER)} AS prompt
FROM items GROUP BY doc_id, batch_id
""")
def q_batch_prompts(spark, sf):
    d = tbl(spark, sf, "documents").select("doc_id", AN.clause_items("text").alias("items"))
    return AN.batch_prompts(d, "doc_id", "items").select("doc_id", "batch_id", "n_items", "prompt")


def _clean_opinion_sql(x: str, p: str = "o") -> tuple[str, str]:
    """SELECT-list steps (DuckDB lateral aliases) of clean_opinion + final check."""
    steps = [
        f"coalesce({x}, '')",
        f"regexp_replace({p}0, '^\\d+\\.\\s*', '')",
        f"regexp_replace({p}1, '(?i)^ID\\s*', '')",
        f"regexp_replace({p}2, '\\.+\\z', '')",
        f"regexp_replace({p}3, '<[^>]+>', '', 'g')",
        f"regexp_replace({p}4, '\\([^)]+\\)', '', 'g')",
        f"CASE WHEN instr({p}5, 'Answer:') > 0 THEN {S.strip(f'string_split({p}5, {S.q(chr(65) + 'nswer:')})[-1]')} ELSE {p}5 END",
        f"CASE WHEN instr({p}6, '.') > 0 THEN {S.strip(f'split_part({p}6, {S.q(chr(46))}, 1)')} ELSE {p}6 END",
        "CASE WHEN (" + " OR ".join(f"instr(lower({p}7), {S.q(w)}) > 0" for w in AN.SKIP_PHRASES)
        + f") AND length({p}7) > 30 THEN '' ELSE {p}7 END",
    ]
    k = len(steps)
    for w in AN.LABEL_PREFIXES:
        steps.append(f"regexp_replace({p}{k - 1}, {S.q('(?i)^' + w + chr(92) + 's*')}, '')")
        k += 1
    steps.append(S.strip(f"{p}{k - 1}"))
    k += 1
    steps.append(f"CASE WHEN lower({p}{k - 1}) IN ('none', '<none>', 'n/a') OR regexp_matches({p}{k - 1}, '^\\d+\\.?$') "
                 f"THEN '' ELSE {p}{k - 1} END")
    sel = ",\n       ".join(f"{e} AS {p}{i}" for i, e in enumerate(steps))
    return sel, f"{p}{len(steps) - 1}", f"{p}{len(steps) - 2}"


_CO_SEL, _CO_FINAL, _CO_CLEAN = _clean_opinion_sql("line")


@query("clean_opinion", f"""
SELECT doc_id, line_pos, cleaned FROM (
  SELECT doc_id, line_pos, {_CO_SEL}, {_CO_CLEAN} AS cleaned FROM ({_LINES_SQL}))
""")
def q_clean_opinion(spark, sf):
    lines = RD.explode_lines(tbl(spark, sf, "documents"), "text", keep=["doc_id"])
    return lines.select("doc_id", "line_pos", AN.clean_opinion("line").alias("cleaned"))


# no SQL: too slow on whole texts of every language; tests/test_runs.py holds a brute-force version
@query("demux_answers")
def q_demux_answers(spark, sf):
    d = tbl(spark, sf, "documents").select("doc_id", "text", AN.clause_items("text").alias("items"))
    b = AN.batch_prompts(d, "doc_id", "items").join(d.select("doc_id", "text"), "doc_id")
    b = b.withColumn("response", AN.rule_batch_response(F.col("items")))
    return AN.demux_answers(b, "doc_id", "response", sentence_col="text")


# no SQL: too slow on whole texts of every language; tests/test_runs.py holds a brute-force version
@query("filter_opinions")
def q_filter_opinions(spark, sf):
    d = tbl(spark, sf, "documents")
    # clauses stay in their review's row until its text has been searched
    c = d.select("doc_id", CL.clause_array("text").alias("c")).join(d.select("doc_id", "text"), "doc_id")
    cand = F.transform("c", lambda c: F.struct(F.concat(
        AN.first_word(c["clause"]), F.lit(", "), c["clause"], F.lit(", zzqx")).alias("opinion"), c["clause"].alias("clause")))
    kept = F.zip_with("c", AN.opinions_found(cand, F.col("text")), lambda c, k: F.struct(c["pos"].alias("clause_pos"), k.alias("kept")))
    return c.select("doc_id", F.explode(kept).alias("k")).select("doc_id", "k.clause_pos", "k.kept")


_LEX_TOK = "'" + CL.LEXICON_TOKEN_SPLIT.replace("'", "''") + "'"
_GRAMS_SQL = f"""
tk AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), {_LEX_TOK}), lambda x: x <> '') AS t
       FROM documents),
g AS (SELECT doc_id, lang, (generate_subscripts(t, 1) - 1) * 2 AS pos, unnest(t) AS entry FROM tk
      UNION ALL
      SELECT doc_id, lang, (i - 1) * 2 + 1 AS pos, t[i] || ' ' || t[i + 1] AS entry
      FROM (SELECT doc_id, lang, t, unnest(range(1, len(t))) AS i FROM tk)),
uni AS (SELECT entry FROM g WHERE lang = 'en' AND pos % 2 = 0 GROUP BY entry ORDER BY count(*) DESC, entry LIMIT 30),
bi AS (SELECT entry FROM g WHERE lang = 'en' AND pos % 2 = 1 GROUP BY entry ORDER BY count(*) DESC, entry LIMIT 10),
lex AS (SELECT entry FROM uni UNION SELECT entry FROM bi)
"""


@query("match_lexicon", f"""
WITH {_GRAMS_SQL},
m AS (SELECT doc_id, count(*) AS n_hits, string_agg(entry, ', ' ORDER BY pos) AS hits FROM g JOIN lex USING (entry)
      GROUP BY doc_id)
SELECT doc_id, coalesce(n_hits, 0) AS n_hits, coalesce(hits, '') AS hits FROM documents LEFT JOIN m USING (doc_id)
""")
def q_match_lexicon(spark, sf):
    d = tbl(spark, sf, "documents")
    lex = CL.frequent_lexicon(d.where(F.col("lang") == "en"), "text", 30, 10)
    return CL.match_lexicon(d, lex, "doc_id", "text")


# ============================================================ D. classification

def _nb_sql(feat_expr: str, pred_where: str = "TRUE") -> str:
    """CTEs fd/c/docs/tot/cls (training) and pred(doc_id, pred, score) (scoring)."""
    return f"""
fd AS (SELECT doc_id, lang AS label, text, {feat_expr} AS fl FROM documents),
g AS (SELECT label, unnest(fl) AS feature FROM fd),
c AS (SELECT label, feature, count(*) AS c FROM g GROUP BY 1, 2),
docs AS (SELECT label, count(*) AS n_docs FROM fd GROUP BY 1),
tot AS (SELECT label, sum(c) AS n_features, count(*) AS n_distinct FROM c GROUP BY 1),
vv AS (SELECT count(DISTINCT feature) AS v FROM c),
cls AS (SELECT d.label, ln(d.n_docs / (SELECT sum(n_docs) FROM docs)) AS prior,
               CAST(coalesce(t.n_features, 0) AS DOUBLE) + (SELECT v FROM vv) AS denom
        FROM docs d LEFT JOIN tot t USING (label)),
pd AS (SELECT doc_id, fl FROM fd WHERE {pred_where}),
kc AS (SELECT doc_id, feature, count(*) AS cnt FROM (SELECT doc_id, unnest(fl) AS feature FROM pd)
       WHERE feature IN (SELECT feature FROM c) GROUP BY 1, 2),
sc AS (SELECT kc.doc_id, cls.label, sum(kc.cnt * ln((coalesce(c.c, 0) + 1.0) / cls.denom)) AS s
       FROM kc CROSS JOIN cls LEFT JOIN c ON c.feature = kc.feature AND c.label = cls.label GROUP BY 1, 2),
fl AS (SELECT pd.doc_id, cls.label, cls.prior + coalesce(sc.s, 0) AS t
       FROM pd CROSS JOIN cls LEFT JOIN sc ON sc.doc_id = pd.doc_id AND sc.label = cls.label),
mx AS (SELECT doc_id, max(t) AS m FROM fl GROUP BY 1),
pred AS (SELECT fl.doc_id, min(fl.label) FILTER (WHERE fl.t = mx.m) AS pred, 1.0 / sum(exp(fl.t - mx.m)) AS score
         FROM fl JOIN mx USING (doc_id) GROUP BY fl.doc_id)
"""


_TRIGRAMS_SQL = "list_transform(range(1, length(lower(text)) - 1), lambda i: substr(lower(text), i, 3))"
_WORDS_SQL = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_NONBLANK = f"{S.strip('text')} <> ''"


def _lang_model(spark, sf):
    d = tbl(spark, sf, "documents")
    return d, CF.fit_language_model(d, "text", "lang")


@query("lang_train", f"""
WITH {_nb_sql(_TRIGRAMS_SQL)}
SELECT d.label, d.n_docs, coalesce(t.n_features, 0) AS n_features, coalesce(t.n_distinct, 0) AS n_distinct
FROM docs d LEFT JOIN tot t USING (label)
""")
def q_lang_train(spark, sf):
    _, m = _lang_model(spark, sf)
    return m.class_stats.select("label", "n_docs", "n_features", "n_distinct")


_LANG_PRED_SQL = f"""
WITH {_nb_sql(_TRIGRAMS_SQL, _NONBLANK)}
SELECT d.doc_id, d.lang, coalesce(p.pred, '') AS pred_lang FROM documents d LEFT JOIN pred p USING (doc_id)
"""


@query("lang_predict", _LANG_PRED_SQL)
def q_lang_predict(spark, sf):
    d, m = _lang_model(spark, sf)
    return CF.detect_language(m, d, "doc_id").join(d.select("doc_id", "lang"), "doc_id").select(
        "doc_id", "lang", "pred_lang")


@query("lang_gate", f"""
SELECT doc_id, pred_lang, pred_lang = 'en' AS is_target FROM ({_LANG_PRED_SQL})
""")
def q_lang_gate(spark, sf):
    d, m = _lang_model(spark, sf)
    return CF.language_gate(m, d.select("doc_id", "text"), "doc_id").select("doc_id", "pred_lang", "is_target")


@query("translation_route", f"""
SELECT CASE WHEN passes THEN 'pass' ELSE 'translate' END AS route, count(*) AS n,
       count(DISTINCT text) FILTER (WHERE NOT passes) AS n_distinct_to_translate
FROM (SELECT d.text, l.pred_lang = 'en' OR {S.strip("coalesce(d.text, '')")} = '' AS passes
      FROM ({_LANG_PRED_SQL}) l JOIN documents d USING (doc_id)) GROUP BY 1
""")
def q_translation_route(spark, sf):
    d, m = _lang_model(spark, sf)
    r = CF.route_translation(CF.language_gate(m, d.select("doc_id", "text"), "doc_id"))
    return r.groupBy("route").agg(F.count(F.lit(1)).alias("n"),
                                  F.countDistinct("to_translate").alias("n_distinct_to_translate"))


@query("label_index", """
SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id
FROM (SELECT DISTINCT event_type AS label FROM events WHERE event_type IS NOT NULL)
""")
def q_label_index(spark, sf):
    return CF.label_index(tbl(spark, sf, "events"), "event_type")


@query("stratified_split", """
WITH h AS (SELECT doc_id, lang, ((doc_id % 2147483647) * 2654435761 + 42) % 4294967296 AS hv FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY hv, doc_id) AS rn,
             count(*) OVER (PARTITION BY lang) AS n FROM h)
SELECT lang, CASE WHEN rn <= ceil(0.1 * n) THEN 'test' ELSE 'train' END AS split, count(*) AS n,
       CAST(sum(doc_id) AS BIGINT) AS id_sum
FROM r GROUP BY 1, 2
""")
def q_stratified_split(spark, sf):
    s = CF.stratified_split(tbl(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.1, 42)
    return s.groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("id_sum"))


def _word_model(spark, sf):
    d = tbl(spark, sf, "documents")
    return d, CF.fit_nb(d, "lang", CF.word_tokens("text"))


@query("nb_train", f"""
WITH {_nb_sql(_WORDS_SQL)}
SELECT d.label, d.n_docs, coalesce(t.n_features, 0) AS n_features, coalesce(t.n_distinct, 0) AS n_distinct
FROM docs d LEFT JOIN tot t USING (label)
""")
def q_nb_train(spark, sf):
    _, m = _word_model(spark, sf)
    return m.class_stats.select("label", "n_docs", "n_features", "n_distinct")


@query("predict_category", f"""
WITH {_nb_sql(_WORDS_SQL, _NONBLANK)}
SELECT d.doc_id, coalesce(p.pred, 'Unknown') AS category, coalesce(round(p.score, 4), 0.0) AS category_score
FROM documents d LEFT JOIN pred p USING (doc_id)
""")
def q_predict_category(spark, sf):
    d, m = _word_model(spark, sf)
    p = CF.predict_category(m, d, "doc_id", "text")
    return p.select("doc_id", "category", F.round("category_score", 4).alias("category_score"))


@query("decode_polarity", """
WITH e AS (SELECT event_id, CASE WHEN value < 1 THEN '' ELSE event_type END AS clause,
                  (value * 7) % 1 AS s1, (value * 13) % 1 AS s2, (value * 3) % 1 AS s3 FROM events),
b AS (SELECT *, CASE WHEN s2 > s1 THEN (CASE WHEN s3 > s2 THEN 3 ELSE 2 END)
                     ELSE (CASE WHEN s3 > s1 THEN 3 ELSE 1 END) END AS k FROM e)
SELECT event_id,
       CASE WHEN clause = '' THEN 'Neutral' WHEN k = 1 THEN 'Negative' WHEN k = 2 THEN 'Positive' ELSE 'Neutral' END
         AS polarity,
       CASE WHEN clause = '' THEN 0.0 ELSE round(CASE k WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END, 4) END
         AS polarity_score
FROM b
""")
def q_decode_polarity(spark, sf):
    ev = tbl(spark, sf, "events")
    preds = F.array(
        F.struct(F.lit("LABEL_0").alias("label"), ((F.col("value") * 7) % 1).alias("score")),
        F.struct(F.lit("positive").alias("label"), ((F.col("value") * 13) % 1).alias("score")),
        F.struct(F.lit("LABEL_1").alias("label"), ((F.col("value") * 3) % 1).alias("score")))
    clause = F.when(F.col("value") < 1, F.lit("")).otherwise(F.col("event_type"))
    dec = CF.decode_polarity(preds, clause)
    return ev.select("event_id", dec["polarity"].alias("polarity"), dec["polarity_score"].alias("polarity_score"))


def _sql_list(xs) -> str:
    return "(" + ", ".join(S.q(x) for x in xs) + ")"


@query("lexicon_polarity", f"""
WITH tk AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w,
            list_filter(regexp_split_to_array(regexp_replace(lower(text), 'n[''’]t([^a-z]|$)', ' not\\1', 'g'), '[^a-z]+'),
                        lambda x: x <> '') AS t FROM documents),
top AS (SELECT entry, count(*) AS n FROM (SELECT unnest(w) AS entry FROM tk WHERE lang = 'en')
        GROUP BY entry ORDER BY n DESC, entry LIMIT 40),
lex AS (SELECT entry, CASE WHEN row_number() OVER (ORDER BY n DESC, entry) % 2 = 1 THEN 1 ELSE -1 END AS sign FROM top),
u AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM tk),
x AS (SELECT doc_id, t[i] AS entry, CASE WHEN i >= 2 THEN t[i - 1] END AS p1, CASE WHEN i >= 3 THEN t[i - 2] END AS p2
      FROM u),
s AS (SELECT x.doc_id, sum(lex.sign * CASE WHEN p1 IN {_sql_list(CL.INTENSIFIERS)} THEN 2 ELSE 1 END
                            * CASE WHEN p1 IN {_sql_list(CL.NEGATIONS)} OR p2 IN {_sql_list(CL.NEGATIONS)}
                                   THEN -1 ELSE 1 END) AS score
      FROM x JOIN lex USING (entry) GROUP BY 1)
SELECT tk.doc_id, CAST(coalesce(s.score, 0) AS BIGINT) AS score,
       CASE WHEN coalesce(s.score, 0) > 0 THEN 'Positive' WHEN coalesce(s.score, 0) < 0 THEN 'Negative'
            ELSE 'Neutral' END AS polarity
FROM tk LEFT JOIN s USING (doc_id)
""")
def q_lexicon_polarity(spark, sf):
    d = tbl(spark, sf, "documents")
    lex = CF.frequent_token_lexicon(d.where(F.col("lang") == "en"), "text", 40)
    return CF.lexicon_polarity(d, lex, "doc_id", "text")


_CENTROID_SQL = """
e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
cen AS (SELECT label, dim, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY 1, 2),
cn AS (SELECT label, sqrt(sum(m * m)) AS nc FROM cen GROUP BY 1),
vn AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS nv FROM e GROUP BY 1),
dt AS (SELECT e.vec_id, cen.label AS cl, sum(CAST(e.x AS DOUBLE) * cen.m) AS d FROM e JOIN cen USING (dim) GROUP BY 1, 2),
sc AS (SELECT dt.vec_id, cl, d / (nv * nc) AS cs FROM dt JOIN vn USING (vec_id) JOIN cn ON cn.label = dt.cl),
best AS (SELECT vec_id, cl, row_number() OVER (PARTITION BY vec_id ORDER BY cs DESC, cl) AS rn FROM sc),
p5 AS (SELECT v.vec_id, v.label AS gold, b.cl AS pred FROM embeddings v JOIN best b ON b.vec_id = v.vec_id AND b.rn = 1)
"""


@query("nearest_centroid", f"WITH {_CENTROID_SQL} SELECT vec_id, gold AS label, pred AS pred_label FROM p5")
def q_nearest_centroid(spark, sf):
    return CF.nearest_centroid(tbl(spark, sf, "embeddings"), "label", "embedding", "vec_id")


# ============================================================ pair frames (SQL side)

_P1 = """SELECT event_id, user_id, ts, value, event_type AS gold, pred FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pred FROM events)
WHERE pred IS NOT NULL"""
_P2 = ("SELECT doc_id, coalesce(lower(CAST(quality AS VARCHAR)), 'nan') AS a, "
       "coalesce(lower(CAST(1 - toxic AS VARCHAR)), 'nan') AS b FROM labels")
_P3 = """SELECT a.conv_id, a.turn, a.text AS gold, b.text AS pred FROM conversations a
JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1"""
_FW = "[" + ", ".join(S.q(w) for w in FX.FUNCTION_WORDS) + "]"
_P4 = f"""SELECT doc_id, coalesce(list_filter(t[1:h], lambda x: list_contains({_FW}, x))[1], '') AS gold,
       coalesce(list_filter(t[h + 1:], lambda x: list_contains({_FW}, x))[1], '') AS pred
FROM (SELECT doc_id, t, len(t) // 2 AS h FROM (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS t
  FROM documents))"""


def _bucket_sql(x: str) -> str:
    return f"CASE WHEN {x} < 20 THEN 'Negative' WHEN {x} < 60 THEN 'Neutral' ELSE 'Positive' END"


_P7 = f"""SELECT event_id, event_type || ' ' || CAST(user_id AS VARCHAR) AS term, props AS opinion,
       {S.capitalize('event_type')} AS category, {_bucket_sql('value')} AS polarity,
       pet || ' ' || CAST(user_id AS VARCHAR) AS pred_term, pprops AS pred_opinion, pet AS pred_category,
       {_bucket_sql('pv')} AS pred_polarity, event_type AS clause
FROM (SELECT *, lag(event_type) OVER w AS pet, lag(value) OVER w AS pv, lag(props) OVER w AS pprops FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE pet IS NOT NULL"""


def _p1(spark, sf):
    return FX.p1_events(spark, sf)


def _p2(spark, sf):
    return AG.rater_pairs(FX.p2_labels(spark, sf), "a", "b", "doc_id")


def _p5(spark, sf):
    return CF.nearest_centroid(tbl(spark, sf, "embeddings"), "label", "embedding", "vec_id").select(
        "vec_id", F.col("label").alias("gold"), F.col("pred_label").alias("pred"))


def _p6(spark, sf):
    d, m = _lang_model(spark, sf)
    p = CF.detect_language(m, d, "doc_id")
    return d.select("doc_id", F.col("lang").alias("gold")).join(p, "doc_id").withColumnRenamed("pred_lang", "pred")


_P5_WITH = f"WITH {_CENTROID_SQL}"
_P6_WITH = f"WITH {_nb_sql(_TRIGRAMS_SQL, _NONBLANK)}, p6 AS (SELECT d.doc_id, d.lang AS gold, coalesce(p.pred, '') AS pred FROM documents d LEFT JOIN pred p USING (doc_id))"


# ============================================================ E. evaluation

def _acc_sql(with_: str, src: str) -> str:
    return (f"{with_} SELECT count(*) AS n, round(coalesce(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 0.0), 6)"
            f" AS accuracy FROM {src}")


def _stats_sql(src: str, g: str = "gold", p: str = "pred") -> str:
    return f"""
conf AS (SELECT {g} AS gold, {p} AS pred, count(*) AS n FROM {src} GROUP BY 1, 2),
gs AS (SELECT gold AS label, sum(n) AS support, sum(CASE WHEN gold = pred THEN n ELSE 0 END) AS tp FROM conf GROUP BY 1),
ps AS (SELECT pred AS label, sum(n) AS pred_n FROM conf GROUP BY 1),
ls AS (SELECT coalesce(gs.label, ps.label) AS label, CAST(coalesce(support, 0) AS DOUBLE) AS support,
              CAST(coalesce(tp, 0) AS DOUBLE) AS tp, CAST(coalesce(pred_n, 0) AS DOUBLE) AS pred_n
       FROM gs FULL OUTER JOIN ps ON gs.label = ps.label),
st AS (SELECT *, CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM ls),
st2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END
              AS f1 FROM st)"""


def _macro_sql(with_: str, src: str) -> str:
    pre = f"{with_}, " if with_ else "WITH "
    return (f"{pre}{_stats_sql(src)} SELECT count(*) AS n_labels, round(avg(precision), 6) AS macro_precision, "
            f"round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM st2")


@query("pair_eval", _P3)
def q_pair_eval(spark, sf):
    p3 = FX.p3_turns(spark, sf)
    gold = p3.select("conv_id", "turn", "gold")
    pred = p3.select("conv_id", "turn", "pred")
    return ME.pair_eval(pred, gold, ["conv_id", "turn"]).select("conv_id", "turn", "gold", "pred")


def _tk(x: str) -> str:
    return S.strip(f"lower(coalesce(CAST({x} AS VARCHAR), 'nan'))")


@query("exact_match_f1", f"""
SELECT count(*) AS n, round(coalesce(count(*) FILTER (WHERE {_tk('gold')} = {_tk('pred')}) / nullif(count(*), 0), 0.0), 6)
       AS exact_match_f1 FROM ({_P4})
""")
def q_exact_match_f1(spark, sf):
    return ME.text_scores(FX.p4_function_words(spark, sf), "gold", "pred").select("n", "exact_match_f1")


def _token_sql(src: str) -> str:
    hit = f"list_has_any({S.tokens(_tk('gold'))}, {S.tokens(_tk('pred'))})"
    return (f"SELECT count(*) AS n, round(coalesce(count(*) FILTER (WHERE {hit}) / nullif(count(*), 0), 0.0), 6)"
            f" AS token_f1 FROM ({src})")


@query("token_f1", _token_sql(_P4))
def q_token_f1(spark, sf):
    return ME.text_scores(FX.p4_function_words(spark, sf), "gold", "pred").select("n", "token_f1")


@query("token_f1_turns", _token_sql(_P3))
def q_token_f1_turns(spark, sf):
    return ME.text_scores(FX.p3_turns(spark, sf), "gold", "pred").select("n", "token_f1")


def _rtok(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"


def _lcs(a: str, b: str) -> str:
    return (f"list_reduce({a}, lambda prev, x: list_reduce(range(1, len({b}) + 1), lambda acc, j: "
            f"list_append(acc, CASE WHEN {b}[j] = x THEN prev[j] + 1 ELSE greatest(prev[j + 1], acc[j]) END), [0]), "
            f"list_transform(range(0, len({b}) + 1), lambda i: 0))[-1]")


def _rouge_f(ga: str, pa: str) -> str:
    l = f"CAST({_lcs(ga, pa)} AS DOUBLE)"
    return (f"CASE WHEN len({ga}) = 0 OR len({pa}) = 0 OR {l} = 0 THEN 0.0 ELSE "
            f"2 * ({l} / len({pa})) * ({l} / len({ga})) / (({l} / len({pa})) + ({l} / len({ga}))) END")


@query("rouge_l_nostem", f"""
WITH pr AS (SELECT {_rtok('gold')} AS ga, {_rtok('pred')} AS pa FROM ({_P3}))
SELECT count(*) AS n, round(coalesce(avg({_rouge_f('ga', 'pa')}), 0.0), 6) AS rouge_l FROM pr
""")
def q_rouge_l_nostem(spark, sf):
    t = FX.p3_turns(spark, sf).select(ME.rouge_tokens("gold").alias("g"), ME.rouge_tokens("pred").alias("p"))
    return ME.rouge_l_tokens(t, "g", "p")


def _stemmed_ctes(pairs: str) -> str:
    """CTEs that end in ``scored(g, p, f)``: stemmed ROUGE-L of the distinct pairs of ``pairs`` (g, p)."""
    return f"""dp AS (SELECT DISTINCT g, p FROM ({pairs})),
tw AS (SELECT g, p, 0 AS side, unnest({_rtok('g')}) AS word, generate_subscripts({_rtok('g')}, 1) AS i FROM dp
       UNION ALL SELECT g, p, 1, unnest({_rtok('p')}), generate_subscripts({_rtok('p')}, 1) FROM dp),
words AS (SELECT DISTINCT word FROM tw),
{S.stem_ctes('words')},
ts AS (SELECT g, p, coalesce(list(stem ORDER BY i) FILTER (side = 0), []) AS ga,
              coalesce(list(stem ORDER BY i) FILTER (side = 1), []) AS pa FROM tw JOIN stems USING (word) GROUP BY g, p),
scored AS (SELECT dp.g, dp.p, coalesce({_rouge_f('ga', 'pa')}, 0.0) AS f FROM dp LEFT JOIN ts ON ts.g = dp.g AND ts.p = dp.p)"""


@query("rouge_l", f"""
WITH p3 AS (SELECT coalesce(gold, '') AS g, coalesce(pred, '') AS p FROM ({_P3})), {_stemmed_ctes('SELECT g, p FROM p3')}
SELECT count(*) AS n, round(coalesce(avg(f), 0.0), 6) AS rouge_l FROM p3 JOIN scored USING (g, p)
""")
def q_rouge_l(spark, sf):
    return ME.rouge_l_stemmed(FX.p3_turns(spark, sf), "gold", "pred")


# both halves of every whole text; the SQL recurrence is too slow there: tested by brute force
@query("rouge_l_halves")
def q_rouge_l_halves(spark, sf):
    d = tbl(spark, sf, "documents").select(ME.rouge_tokens("text").alias("t"))
    h = F.floor(F.size("t") / 2).cast("int")
    pr = d.select(F.array_join(F.slice("t", F.lit(1), h), " ").alias("g"), F.array_join(F.slice("t", h + 1, F.size("t")), " ").alias("p"))
    return ME.rouge_l_stemmed(pr, "g", "p")


@query("porter_stems", f"""
WITH words AS (SELECT DISTINCT unnest({_rtok('text')}) AS word FROM documents), {S.stem_ctes('(SELECT * FROM words WHERE len(word) > 3)')}
SELECT word, stem FROM stems
""")
def q_porter_stems(spark, sf):
    words = tbl(spark, sf, "documents").select(F.explode(ME.rouge_tokens("text")).alias("word")).where(F.length("word") > 3)
    return porter_stems(words.distinct())


# whole texts, where the SQL recurrence above is too slow: tested by brute force
@query("rouge_l_whole")
def q_rouge_l_whole(spark, sf):
    d = tbl(spark, sf, "documents").select(ME.rouge_tokens("text").alias("t"))
    h = F.floor(F.size("t") / 2).cast("int")
    pr = d.select(F.slice("t", F.lit(1), h).alias("g"), F.slice("t", h + 1, F.size("t")).alias("p"))
    return ME.rouge_l_tokens(pr, "g", "p")


@query("embedding_similarity", """
WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
pr AS (SELECT a.vec_id, sum(CAST(a.x AS DOUBLE) * CAST(b.x AS DOUBLE)) AS dot,
              sqrt(sum(CAST(a.x AS DOUBLE) * CAST(a.x AS DOUBLE))) AS na,
              sqrt(sum(CAST(b.x AS DOUBLE) * CAST(b.x AS DOUBLE))) AS nb
       FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND b.dim = a.dim GROUP BY a.vec_id)
SELECT count(*) AS n_pairs, round(coalesce(avg(dot / (na * nb)), 0.0), 6) AS mean_cosine FROM pr
""")
def q_embedding_similarity(spark, sf):
    e = tbl(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("pred_vec"))
    pairs = e.select("vec_id", F.col("embedding").alias("gold_vec")).join(nxt, "vec_id")
    return ME.embedding_similarity(pairs, "gold_vec", "pred_vec")


@query("accuracy", _acc_sql("", f"({_P1})"))
def q_accuracy(spark, sf):
    return ME.accuracy(_p1(spark, sf), "gold", "pred")


@query("accuracy_centroid", _acc_sql(_P5_WITH, "p5"))
def q_accuracy_centroid(spark, sf):
    return ME.accuracy(_p5(spark, sf), "gold", "pred")


@query("accuracy_lang", _acc_sql(_P6_WITH, "p6"))
def q_accuracy_lang(spark, sf):
    return ME.accuracy(_p6(spark, sf), "gold", "pred")


@query("macro_prf", _macro_sql("", f"({_P1})"))
def q_macro_prf(spark, sf):
    return ME.macro_prf(_p1(spark, sf), "gold", "pred")


@query("macro_prf_centroid", _macro_sql(_P5_WITH, "p5"))
def q_macro_prf_centroid(spark, sf):
    return ME.macro_prf(_p5(spark, sf), "gold", "pred")


@query("macro_prf_lang", _macro_sql(_P6_WITH, "p6"))
def q_macro_prf_lang(spark, sf):
    return ME.macro_prf(_p6(spark, sf), "gold", "pred")


@query("weighted_prf", f"""
WITH {_stats_sql(f"({_P1})")}
SELECT round(coalesce(sum(precision * support) / sum(support), 0.0), 6) AS weighted_precision,
       round(coalesce(sum(recall * support) / sum(support), 0.0), 6) AS weighted_recall,
       round(coalesce(sum(f1 * support) / sum(support), 0.0), 6) AS weighted_f1,
       CAST(sum(support) AS BIGINT) AS support FROM st2
""")
def q_weighted_prf(spark, sf):
    return ME.weighted_prf(_p1(spark, sf), "gold", "pred")


@query("classification_report", f"""
WITH {_stats_sql(f"({_P1})")}
SELECT label AS row_label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM st2
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM st2
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
                 CAST(sum(support) AS BIGINT) FROM st2
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
                 round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
                 CAST(sum(support) AS BIGINT) FROM st2
""")
def q_classification_report(spark, sf):
    return ME.classification_report(_p1(spark, sf), "gold", "pred")


def _evaluate_sql() -> str:
    text_rows, pairs = [], []
    for k in ("term", "opinion"):
        g, p = _tk(f"lower({k})"), _tk(f"lower(pred_{k})")
        hit = f"list_has_any({S.tokens(g)}, {S.tokens(p)})"
        text_rows += [
            f"SELECT '{k}_exact_match_f1' AS metric, count(*) FILTER (WHERE {g} = {p}) / count(*) AS score FROM p7",
            f"SELECT '{k}_token_f1', count(*) FILTER (WHERE {hit}) / count(*) FROM p7",
            f"SELECT '{k}_rouge_l', avg(f) FROM p7 JOIN scored ON scored.g = {g} AND scored.p = {p}",
            f"""SELECT '{k}_embedding_sim', avg(cos) FROM p7 JOIN cosines c ON c.g = {g} AND c.p = {p}""",
        ]
        pairs.append(f"SELECT {g} AS g, {p} AS p FROM p7")
    lab = []
    ctes = []
    for k in ("category", "polarity"):
        src = f"(SELECT lower({k}) AS gold, lower(pred_{k}) AS pred FROM p7)"
        ctes.append(_stats_sql(src).replace("conf AS", f"conf_{k} AS").replace("FROM conf", f"FROM conf_{k}")
                    .replace("gs AS", f"gs_{k} AS").replace("ps AS", f"ps_{k} AS").replace("ls AS", f"ls_{k} AS")
                    .replace("FROM gs FULL OUTER JOIN ps ON gs.label = ps.label",
                             f"FROM gs_{k} gs FULL OUTER JOIN ps_{k} ps ON gs.label = ps.label")
                    .replace("st AS", f"st_{k} AS").replace("FROM ls)", f"FROM ls_{k})")
                    .replace("st2 AS", f"st2_{k} AS").replace("FROM st)", f"FROM st_{k})"))
        lab += [f"SELECT '{k}_accuracy', sum(tp) / sum(support) FROM st2_{k}",
                f"SELECT '{k}_macro_f1', avg(f1) FROM st2_{k}",
                f"SELECT '{k}_precision', avg(precision) FROM st2_{k}",
                f"SELECT '{k}_recall', avg(recall) FROM st2_{k}"]
    body = "\nUNION ALL ".join(text_rows + lab)
    vec = lambda x: f"(('0x' || left(md5({x}), 7))::BIGINT % (SELECT max(vec_id) + 1 FROM embeddings))"
    cosines = f"""cosines AS (SELECT g, p, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS cos
FROM dp JOIN embeddings a ON a.vec_id = {vec('g')} JOIN embeddings b ON b.vec_id = {vec('p')})"""
    return f"WITH p7 AS ({_P7}),{_stemmed_ctes(' UNION '.join(pairs))},{cosines},{','.join(ctes)}\nSELECT metric, round(score, 6) AS score FROM ({body})"


_EVAL_SQL = _evaluate_sql()


def _evaluated(spark, sf):
    """All 16 metrics; every distinct text stands for the embedding that its digest picks."""
    pairs = FX.p7_absa_pairs(spark, sf)
    sides = [f"{side}{k}" for k in ("term", "opinion") for side in ("", "pred_")]
    texts = pairs.select(F.explode(F.array(*[ME.text_key(F.lower(c)) for c in sides])).alias("text")).distinct()
    e = tbl(spark, sf, "embeddings")
    number = F.conv(F.substring(F.md5("text"), 1, 7), 16, 10).cast("bigint")
    texts = texts.join(F.broadcast(e.agg((F.max("vec_id") + 1).alias("size"))))
    vectors = texts.withColumn("vec_id", number % F.col("size")).join(e, "vec_id").select("text", F.col("embedding").alias("vec"))
    return ME.evaluate(pairs, vectors=vectors)


@query("evaluate_all", _EVAL_SQL)
def q_evaluate_all(spark, sf):
    return _evaluated(spark, sf)


@query("metric_tables", f"""
SELECT CASE WHEN contains(metric, 'term') OR contains(metric, 'opinion') THEN 'text' ELSE 'label' END AS table_name,
       array_to_string(list_transform(string_split(replace(metric, '_', ' '), ' '),
                                      lambda w: upper(w[1]) || lower(w[2:])), ' ') AS display_metric,
       round(score, 4) AS score
FROM ({_EVAL_SQL})
""")
def q_metric_tables(spark, sf):
    return ME.metric_tables(_evaluated(spark, sf))


@query("wrong_rows", f"""
SELECT event_id, gold, pred FROM ({_P1}) WHERE gold IS DISTINCT FROM pred OR gold IS NULL ORDER BY event_id LIMIT 10
""")
def q_wrong_rows(spark, sf):
    return ME.wrong_rows(_p1(spark, sf), "gold", "pred", "event_id", 10)


def _err_sql(src: str, g: str, p: str) -> str:
    wrong = f"count(*) FILTER (WHERE {g} IS DISTINCT FROM {p} OR {g} IS NULL)"
    return (f"SELECT {wrong} AS wrong_count, count(*) AS total_count, "
            f"round(100.0 - {wrong} / nullif(count(*), 0) * 100, 6) AS accuracy_pct FROM ({src})")


@query("error_summary", _err_sql(_P1, "gold", "pred"))
def q_error_summary(spark, sf):
    return ME.error_summary(_p1(spark, sf), "gold", "pred")


@query("error_summary_case", _err_sql(_P7, "category", "pred_category"))
def q_error_summary_case(spark, sf):
    return ME.error_summary(FX.p7_absa_pairs(spark, sf), "category", "pred_category")


@query("class_error_rates", f"""
SELECT gold, count(*) FILTER (WHERE gold IS DISTINCT FROM pred) AS wrong_count, count(*) AS total_count,
       round(count(*) FILTER (WHERE gold IS DISTINCT FROM pred) / count(*) * 100, 6) AS error_pct,
       round(100.0 - count(*) FILTER (WHERE gold IS DISTINCT FROM pred) / count(*) * 100, 6) AS accuracy_pct
FROM ({_P1}) GROUP BY gold
""")
def q_class_error_rates(spark, sf):
    return ME.class_error_rates(_p1(spark, sf), "gold", "pred")


@query("term_counts", f"""
WITH {_SPLIT_RESP_SQL},
rt AS (SELECT array_to_string(list_filter({S.split_terms('t2')}, lambda x: instr(lower(text), lower(x)) > 0), ',') AS term
       FROM (SELECT *, CASE WHEN clause_pos = max(clause_pos) OVER (PARTITION BY doc_id)
                            THEN {S.strip("replace(term, '<|im_end|>', '')")} ELSE term END AS t2 FROM parsed))
SELECT term, count(*) AS n FROM rt GROUP BY term ORDER BY n DESC, term LIMIT 20
""")
def q_term_counts(spark, sf):
    out = CL.split_and_refine(_split_responses(spark, sf), "doc_id", "text")
    return ME.value_counts(out, "term", 20)


@query("wrong_top_terms", f"""
SELECT term, count(*) AS n FROM ({_P7}) WHERE polarity IS DISTINCT FROM pred_polarity
GROUP BY term ORDER BY n DESC, term LIMIT 20
""")
def q_wrong_top_terms(spark, sf):
    p7 = FX.p7_absa_pairs(spark, sf)
    return ME.value_counts(p7.where(ME.not_equal(F.col("polarity"), F.col("pred_polarity"))), "term", 20)


# ============================================================ F. agreement

def _kappa_sql(src: str) -> str:
    return f"""
WITH p AS ({src}), conf AS (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2),
labs AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS DOUBLE) AS idx
         FROM (SELECT a AS label FROM conf UNION SELECT b FROM conf)),
r AS (SELECT a AS label, CAST(sum(n) AS DOUBLE) AS r FROM conf GROUP BY 1),
c AS (SELECT b AS label, CAST(sum(n) AS DOUBLE) AS c FROM conf GROUP BY 1),
tot AS (SELECT CAST(sum(n) AS DOUBLE) AS nn FROM conf),
obs AS (SELECT sum(CASE WHEN la.idx <> lb.idx THEN n ELSE 0 END) AS o_u, sum(abs(la.idx - lb.idx) * n) AS o_l,
               sum((la.idx - lb.idx) * (la.idx - lb.idx) * n) AS o_q,
               sum(CASE WHEN conf.a = conf.b THEN n ELSE 0 END) AS diag
        FROM conf JOIN labs la ON la.label = conf.a JOIN labs lb ON lb.label = conf.b),
ex AS (SELECT sum(CASE WHEN l1.idx <> l2.idx THEN coalesce(r.r, 0) * coalesce(c.c, 0) ELSE 0 END) AS e_u,
              sum(abs(l1.idx - l2.idx) * coalesce(r.r, 0) * coalesce(c.c, 0)) AS e_l,
              sum((l1.idx - l2.idx) * (l1.idx - l2.idx) * coalesce(r.r, 0) * coalesce(c.c, 0)) AS e_q
       FROM labs l1 CROSS JOIN labs l2 LEFT JOIN r ON r.label = l1.label LEFT JOIN c ON c.label = l2.label),
k AS (SELECT CAST(nn AS BIGINT) AS n, round(diag / nn, 6) AS agreement,
             round(1 - o_u / nullif(e_u / nn, 0), 6) AS cohen_kappa,
             round(1 - o_l / nullif(e_l / nn, 0), 6) AS kappa_linear,
             round(1 - o_q / nullif(e_q / nn, 0), 6) AS kappa_quadratic FROM tot, obs, ex)
"""


def _band_sql(x: str) -> str:
    parts = " ".join(f"WHEN {x} < {b} THEN {S.q(n)}" for b, n in AG.KAPPA_BANDS)
    return f"CASE {parts} ELSE {S.q(AG.KAPPA_TOP_BAND)} END"


_P1_AB = f"SELECT event_id, coalesce(lower(gold), 'nan') AS a, coalesce(lower(pred), 'nan') AS b FROM ({_P1})"


def _p1_ab(spark, sf):
    return AG.rater_pairs(_p1(spark, sf), "gold", "pred", "event_id")


@query("load_labels", "SELECT lower(o_orderpriority) AS human_category FROM orders")
def q_load_labels(spark, sf):
    return AG.load_labels(spark, f"{sf}/orders.parquet", "o_orderpriority", fmt="parquet")


@query("stack_annotators", """
SELECT 'quality' AS annotator, lower(CAST(quality AS VARCHAR)) AS human_category FROM labels
UNION ALL SELECT 'not_toxic', lower(CAST(1 - toxic AS VARCHAR)) FROM labels
""")
def q_stack_annotators(spark, sf):
    lb = tbl(spark, sf, "labels")
    frames = {"quality": lb.select(F.lower(F.col("quality").cast("string")).alias("human_category")),
              "not_toxic": lb.select(F.lower((F.lit(1) - F.col("toxic")).cast("string")).alias("human_category"))}
    return AG.stack_annotators(frames)


@query("agreement", f"""
SELECT count(*) AS n, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM ({_P2})
""")
def q_agreement(spark, sf):
    return AG.agreement(_p2(spark, sf))


@query("cohen_kappa", _kappa_sql(_P2) + "SELECT n, cohen_kappa FROM k")
def q_cohen_kappa(spark, sf):
    return AG.kappa_table(_p2(spark, sf)).select("n", "cohen_kappa")


@query("kappa_linear", _kappa_sql(_P1_AB) + "SELECT n, kappa_linear FROM k")
def q_kappa_linear(spark, sf):
    return AG.kappa_table(_p1_ab(spark, sf)).select("n", "kappa_linear")


@query("kappa_quadratic", _kappa_sql(_P1_AB) + "SELECT n, kappa_quadratic FROM k")
def q_kappa_quadratic(spark, sf):
    return AG.kappa_table(_p1_ab(spark, sf)).select("n", "kappa_quadratic")


@query("kappa_band", f"""
SELECT * FROM (
{_kappa_sql(_P1_AB)} SELECT 'events' AS pair, cohen_kappa, {_band_sql('cohen_kappa')} AS interpretation FROM k)
UNION ALL SELECT * FROM (
{_kappa_sql(_P2)} SELECT 'labels' AS pair, cohen_kappa, {_band_sql('cohen_kappa')} AS interpretation FROM k)
""")
def q_kappa_band(spark, sf):
    a = AG.agreement_report(_p1_ab(spark, sf)).select(F.lit("events").alias("pair"), "cohen_kappa", "interpretation")
    b = AG.agreement_report(_p2(spark, sf)).select(F.lit("labels").alias("pair"), "cohen_kappa", "interpretation")
    return a.unionByName(b)


@query("agreement_report", _kappa_sql(_P2) + f"""
SELECT n, agreement, cohen_kappa, kappa_quadratic AS weighted_kappa, {_band_sql('cohen_kappa')} AS interpretation FROM k
""")
def q_agreement_report(spark, sf):
    return AG.agreement_report(_p2(spark, sf))


def _conf_long_sql(src: str) -> str:
    return f"""
WITH p AS ({src}), conf AS (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2),
labs AS (SELECT a AS label FROM conf UNION SELECT b FROM conf)
SELECT l1.label AS a_label, l2.label AS b_label, coalesce(conf.n, 0) AS n
FROM labs l1 CROSS JOIN labs l2 LEFT JOIN conf ON conf.a = l1.label AND conf.b = l2.label
"""


@query("confusion_long", _conf_long_sql(_P1_AB))
def q_confusion_long(spark, sf):
    return AG.confusion_long(_p1_ab(spark, sf))


_EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("confusion_pivot", f"""
WITH p AS ({_P1_AB}), conf AS (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2),
labs AS (SELECT a AS label FROM conf UNION SELECT b FROM conf)
SELECT labs.label, {", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE b = {S.q(x)}), 0) AS BIGINT) AS {x}" for x in _EVENT_TYPES)}
FROM labs LEFT JOIN conf ON conf.a = labs.label GROUP BY labs.label
""")
def q_confusion_pivot(spark, sf):
    piv, _ = AG.confusion_pivot(_p1_ab(spark, sf))
    return piv


@query("confusion_flags", _conf_long_sql(
    "SELECT lower(l_returnflag) AS a, lower(l_linestatus) AS b FROM lineitem"))
def q_confusion_flags(spark, sf):
    li = tbl(spark, sf, "lineitem").withColumn("k", F.lit(0))
    return AG.confusion_long(AG.rater_pairs(li, "l_returnflag", "l_linestatus", "k"))


@query("disagreements", """
SELECT doc_id, quality, toxic, 1 - toxic AS not_toxic FROM labels
WHERE coalesce(lower(CAST(quality AS VARCHAR)), 'nan') <> coalesce(lower(CAST(1 - toxic AS VARCHAR)), 'nan')
""")
def q_disagreements(spark, sf):
    lb = tbl(spark, sf, "labels").withColumn("not_toxic", F.lit(1) - F.col("toxic"))
    return AG.disagreements(lb, "quality", "not_toxic")


@query("disagreement_rate", f"""
SELECT count(*) FILTER (WHERE a <> b) AS n_disagree, count(*) AS n,
       round(count(*) FILTER (WHERE a <> b) / count(*) * 100, 6) AS disagree_pct FROM ({_P2})
""")
def q_disagreement_rate(spark, sf):
    return AG.disagreement_rate(_p2(spark, sf))


@query("per_category_agreement", f"""
SELECT category, count(*) AS n_samples, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS agreement
FROM (SELECT a, b, unnest(list_distinct([a, b])) AS category FROM ({_P1_AB})) GROUP BY category
""")
def q_per_category_agreement(spark, sf):
    return AG.per_category_agreement(_p1_ab(spark, sf))


# ============================================================ G. reporting

_EV_SCORED = f"SELECT event_id, event_type AS category, {_bucket_sql('value')} AS polarity, value AS score FROM events"


def _ev_scored(spark, sf):
    ev = tbl(spark, sf, "events")
    return ev.select("event_id", F.col("event_type").alias("category"),
                     RP.bucket_polarity("value").alias("polarity"), F.col("value").alias("score"))


@query("summary_cube", f"""
SELECT category, polarity, GROUPING(category, polarity) AS grouping_id, count(*) AS n,
       round(avg(score), 6) AS mean_score FROM ({_EV_SCORED}) GROUP BY CUBE (category, polarity)
""")
def q_summary_cube(spark, sf):
    return RP.summary_cube(_ev_scored(spark, sf))


@query("summary_rollup", f"""
SELECT category, polarity, GROUPING(category, polarity) AS grouping_id, count(*) AS n,
       round(avg(score), 6) AS mean_score FROM ({_EV_SCORED}) GROUP BY ROLLUP (category, polarity)
""")
def q_summary_rollup(spark, sf):
    return RP.summary_cube(_ev_scored(spark, sf), rollup=True)


@query("term_weights", f"""
WITH t AS (SELECT unnest(string_split({S.clean('text')}, ' ')) AS token FROM documents),
c AS (SELECT token, count(*) AS n FROM t WHERE token <> '' GROUP BY token ORDER BY n DESC, token LIMIT 50)
SELECT token, n, round(n / max(n) OVER (), 6) AS weight FROM c
""")
def q_term_weights(spark, sf):
    return RP.term_weights(tbl(spark, sf, "documents"), "text", 50)


@query("filter_results", f"""
SELECT event_id, category, polarity FROM ({_EV_SCORED}) WHERE category IN ('click', 'view') AND polarity = 'Positive'
""")
def q_filter_results(spark, sf):
    return RP.filter_results(_ev_scored(spark, sf), ["click", "view"], "Positive").select(
        "event_id", "category", "polarity")


@query("score_summary", """
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_score,
       round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type
""")
def q_score_summary(spark, sf):
    return RP.score_summary(tbl(spark, sf, "events"), "event_type", "value")


# ============================================================ H. streaming

@query("stream_score", f"""
WITH cl AS ({_CLAUSES_SQL}), n AS (SELECT doc_id, count(*) AS n_clauses FROM cl GROUP BY doc_id)
SELECT d.doc_id, len({S.tokens(S.clean('d.text'))}) AS n_words, coalesce(n.n_clauses, 0) AS n_clauses
FROM documents d LEFT JOIN n USING (doc_id)
""")
def q_stream_score(spark, sf):
    from facetlens import streaming as ST
    docs = tbl(spark, sf, "documents")
    sdf = ST.read_stream(spark, f"{sf}/documents.parquet", docs.schema)
    out, _ = ST.run_available(ST.score_stream(sdf), "stream_score", "append")
    return out.select("doc_id", F.col("n_words").cast("int").alias("n_words"), "n_clauses")


@query("stream_counts", """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
       event_type, count(*) AS n FROM events GROUP BY ALL
""")
def q_stream_counts(spark, sf):
    from facetlens import streaming as ST
    ev = tbl(spark, sf, "events")
    sdf = ST.read_stream(spark, f"{sf}/events.parquet", ev.schema)
    out, _ = ST.run_available(ST.windowed_counts(sdf, "ts", "event_type", "1 hour", "2 hours"),
                              "stream_counts", "complete")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("w.end").cast("timestamp_ntz").alias("window_end"), "event_type", "n")


# windows that the watermark (two hours behind the last event) has closed
@query("stream_closed", """
WITH e AS (SELECT date_trunc('hour', ts) AS h, event_type FROM events),
w AS (SELECT h AS window_start, event_type FROM e UNION ALL SELECT h - INTERVAL 1 HOUR, event_type FROM e)
SELECT window_start, window_start + INTERVAL 2 HOUR AS window_end, event_type, count(*) AS n FROM w
WHERE window_start + INTERVAL 2 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOUR FROM events) GROUP BY ALL
""")
def q_stream_closed(spark, sf):
    from facetlens import streaming as ST
    sdf = ST.read_stream(spark, f"{sf}/events.parquet", tbl(spark, sf, "events").schema)
    out, _ = ST.run_available(ST.windowed_counts(sdf, "ts", "event_type", "2 hours", "2 hours", slide="1 hour"),
                              "stream_closed", "append")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("w.end").cast("timestamp_ntz").alias("window_end"), "event_type", "n")


@query("stream_progress", "SELECT CAST(0 AS BIGINT) AS batch_id, count(*) AS num_input_rows FROM events")
def q_stream_progress(spark, sf):
    from facetlens import streaming as ST
    sdf = ST.read_stream(spark, f"{sf}/events.parquet", tbl(spark, sf, "events").schema)
    written, _ = ST.run_available(sdf.select("event_id", "event_type"), "stream_progress", "append", keep_batch=True)
    return ST.batch_counts(written)


# ============================================================ K. composed runs

def _run_models(spark, sf, with_lang: bool = False):
    d = tbl(spark, sf, "documents")
    lang = CF.fit_language_model(d, "text", "lang") if with_lang else None
    cat = CF.fit_nb(d, "lang", CF.word_tokens("text"))
    lex = CF.frequent_token_lexicon(d.where(F.col("lang") == "en"), "text", 40)
    return d, lang, cat, lex


@query("full_batch")
def q_full_batch(spark, sf):
    from facetlens.plans import runs as RU
    d, lang, cat, lex = _run_models(spark, sf, with_lang=True)
    return RU.run_full(d.select("doc_id", "text"), "doc_id", "text", lang, cat, lex,
                       split_backend=RU.RULES, opinion_backend=RU.RULES)


@query("simple_batch", f"""
WITH d AS (SELECT doc_id, text, {S.tokens('text')} AS tk FROM documents),
r AS (SELECT doc_id, text, {_RESP_LIST_SQL.format(label='Term')} AS tr, {_RESP_LIST_SQL.format(label='Opinion')} AS orr
      FROM d)
SELECT doc_id, text AS sentence, text AS clause,
       array_to_string(list_filter({S.split_terms(S.strip_markers('tr', 'Term'))}, lambda t: {S.whole_word('t', 'text')}), ', ') AS term,
       array_to_string(list_filter({S.split_terms(S.strip_markers('orr', 'Opinion'))}, lambda t: {S.whole_word('t', 'text')}), ', ') AS opinion
FROM r
""")
def q_simple_batch(spark, sf):
    from facetlens.plans import runs as RU
    good, _bad = RU.run_simple(tbl(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text",
                               term_backend=RU.RULES, opinion_backend=RU.RULES)
    return good


@query("scored_run")
def q_scored_run(spark, sf):
    from facetlens.plans import runs as RU
    d, _lang, cat, lex = _run_models(spark, sf)
    out = RU.run_scored(d.select("doc_id", "text"), "doc_id", "text", cat, lex,
                        split_backend=RU.RULES, opinion_backend=RU.RULES)
    return out.withColumn("category_score", F.round("category_score", 4))


@query("file_run")
def q_file_run(spark, sf):
    from facetlens.plans import runs as RU
    d, _lang, cat, lex = _run_models(spark, sf)
    nested = RU.run_file(spark, f"{sf}/documents.parquet", "parquet", cat, lex,
                         split_backend=RU.RULES, opinion_backend=RU.RULES)
    return nested.select("review_id", F.size("aspects").alias("n_aspects"))


@query("train_run")
def q_train_run(spark, sf):
    from facetlens.plans import runs as RU
    fitted = RU.fit_category(tbl(spark, sf, "documents"), "doc_id", "text", "lang")
    return RU.category_report(fitted, "lang")


@query("lr_category")
def q_lr_category(spark, sf):
    d = tbl(spark, sf, "documents")
    split = cut_lineage(CF.stratified_split(d.select("doc_id", "text", "lang"), "lang", "doc_id", 0.1, 42))
    model = CF.fit_text_lr(split.where(F.col("split") == "train"), "text", "lang")
    test = split.where(F.col("split") == "test")
    pred = CF.predict_text_lr(model, test, "doc_id", "text").join(test.select("doc_id", "lang"), "doc_id")
    return ME.accuracy(pred, "lang", "category")
