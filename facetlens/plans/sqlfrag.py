"""SQL text fragments for the DuckDB cross-check queries.

Each helper returns a piece of SQL text that mirrors one column function of
the library; they only format strings.
"""

from __future__ import annotations

from facetlens.functions import stem as P
from facetlens.functions.text import END_MARKER

NL = "chr(10)"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def clean(x: str) -> str:
    y = f"regexp_replace(lower(CAST({x} AS VARCHAR)), 'http\\S+', '', 'g')"
    y = f"regexp_replace({y}, '[^a-z0-9\\s]', ' ', 'g')"
    y = f"regexp_replace({y}, '\\s+', ' ', 'g')"
    return strip(y)


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> '')"


def split_terms(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, ','), lambda t: {strip('t')}), lambda t: t <> '')"


def strip_markers(x: str, label: str) -> str:
    y = f"replace(replace(replace({x}, {q(END_MARKER)}, ''), {q(label + ':')}, ''), {NL}, ' ')"
    return strip(y)


def regex_literal(x: str) -> str:
    return f"regexp_replace({x}, '([!-/:-@\\[-`{{-~])', '\\\\\\1', 'g')"


_W = "[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]"
_NW = "[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}]"


def whole_word(term: str, text: str) -> str:
    """Unicode word-boundary match. RE2's \\b only knows ASCII word
    characters, so each boundary is spelled out from the class of the term's
    first / last character."""
    left = (f"CASE WHEN regexp_matches({term}, '^{_W}') THEN '(?:^|{_NW})' ELSE '{_W}' END")
    right = (f"CASE WHEN regexp_matches({term}, '{_W}$') THEN '(?:{_NW}|$)' ELSE '{_W}' END")
    return f"regexp_matches({text}, '(?is)' || {left} || {regex_literal(term)} || {right})"


def first_word(x: str) -> str:
    return f"regexp_extract({x}, '([A-Za-z]+)', 1)"


def capitalize(x: str) -> str:
    return f"upper(substr({x}, 1, 1)) || lower(substr({x}, 2))"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def _cut(n: str) -> str:
    return f"left(w, len(w) - {n})"


def _suffix_step(name: str, src: str, rules: list[tuple[str, str, str]]) -> str:
    """CTEs ``name_s`` and ``name``: w of ``src`` with its longest listed suffix replaced where the rule's pattern is met."""
    found = "|".join(s for s, _, _ in rules)
    new = " ".join(f"WHEN '{s}' THEN '{n}'" for s, n, _ in rules)
    met = " OR ".join(f"(s IN ({', '.join(q(s) for s, _, p in rules if p == pattern)}) AND regexp_matches({_cut('len(s)')}, {q(pattern)}))"
                      for pattern in dict.fromkeys(p for _, _, p in rules))
    return (f"{name}_s AS (SELECT word, w, regexp_extract(w, '({found})$', 1) AS s FROM {src}),\n"
            f"{name} AS (SELECT word, CASE WHEN {met} THEN {_cut('len(s)')} || CASE s {new} END ELSE w END AS w FROM {name}_s)")


def stem_ctes(src: str) -> str:
    """CTEs that end in ``stems(word, stem)`` for the words of ``src(word)``: the Porter rules as SQL."""
    twice = "|".join(c + c for c in "bcdfghjkmnpqrtvwx0123456789")     # l, s and z stay doubled
    own = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in P.IRREGULAR.items())
    has = lambda x, p: f"regexp_matches({x}, {q(p)})"
    marked = "regexp_replace(regexp_replace(word, '(^|[aeiou])y', '\\1J', 'g'), '([^aeiouy])yy', '\\1YJ', 'g')"
    return ",\n".join([
        f"st0 AS (SELECT word, regexp_replace({marked}, '([^aeiouy])y', '\\1Y', 'g') AS w FROM {src})",
        f"st1 AS (SELECT word, CASE WHEN len(w) = 4 AND ends_with(w, 'ies') THEN {_cut('1')} ELSE w END AS w FROM st0)",
        _suffix_step("st2", "st1", [(s, n, "") for s, n in P.PLURAL.items()]),
        f"st3 AS (SELECT word, w, CASE WHEN {has('w', '(?:ied|eed)$')} THEN '' ELSE "
        f"regexp_extract(w, '^(.*{P.V}.*)(?:ed|ing)$', 1) END AS c FROM st2)",
        f"""st4 AS (SELECT word, CASE
  WHEN ends_with(w, 'ied') THEN CASE WHEN len(w) = 4 THEN {_cut('1')} ELSE {_cut('2')} END
  WHEN ends_with(w, 'eed') THEN CASE WHEN {has('w', P.POSITIVE + '.*eed$')} THEN {_cut('1')} ELSE w END
  WHEN c = '' THEN w WHEN {has('c', '(?:at|bl|iz)$')} THEN c || 'e'
  WHEN {has('c', f'(?:{twice})$')} THEN left(c, len(c) - 1) WHEN {has('c', '(?:ll|ss|zz)$')} THEN c
  WHEN {has('c', P.ONE)} AND {has('c', P.SHORT_END)} THEN c || 'e' ELSE c END AS w FROM st3)""",
        "st5 AS (SELECT word, regexp_replace(w, '^(..+)Y$', '\\1i') AS w FROM st4)",
        f"st6 AS (SELECT word, regexp_replace(w, '^(.*{P.POSITIVE}.*al)li$', '\\1') AS w FROM st5)",
        _suffix_step("st7", "st6", [(s, n, P.POSITIVE) for s, n in P.DOUBLE.items()] + [("logi", "log", f"{P.POSITIVE}|{P.V}$")]),
        _suffix_step("st8", "st7", [(s, n, P.POSITIVE) for s, n in P.DERIVED.items()]),
        _suffix_step("st9", "st8", [(s, "", P.MORE) for s in P.DROPPED] + [("ion", "", P.MORE + ".*$")]).replace(
            "(s IN ('ion')", "(s IN ('ion') AND regexp_matches(w, '[st]ion$')"),
        f"""st10 AS (SELECT word, CASE WHEN ends_with(w, 'e') AND ({has(_cut('1'), P.MORE)}
  OR ({has(_cut('1'), P.ONE)} AND NOT {has(_cut('1'), P.SHORT_END)})) THEN {_cut('1')} ELSE w END AS w FROM st9)""",
        f"st11 AS (SELECT word, CASE WHEN ends_with(w, 'll') AND {has(_cut('1'), P.MORE)} THEN {_cut('1')} ELSE w END AS w FROM st10)",
        f"stems AS (SELECT word, CASE WHEN len(word) <= 3 THEN word ELSE coalesce(CASE word {own} END, "
        f"translate(w, 'JY', 'yy')) END AS stem FROM st11)"])
