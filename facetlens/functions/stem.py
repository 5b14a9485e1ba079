"""Porter stemming in column functions, in the extended form that ROUGE scorers use.

Every step is a ``transform`` of a one-word array, so its regular expressions
read a finished value; chained column expressions would be copied into each
other by the optimizer, once for every use, step by step. Whether a ``y`` is a vowel depends
only on the letters before it; it is therefore marked once (``Y`` vowel, ``J``
consonant) and unmarked at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

V, C = "[aeiouY]", "[^aeiouY]"
#: Conditions on what stands before a suffix, as patterns to be found in it.
POSITIVE = V + C                              # a vowel run closed by a consonant: measure of at least 1
MORE = f"{V}{C}+{V}+{C}"                      # measure of at least 2
ONE = f"^{C}*{V}+{C}+{V}*$"                   # measure of exactly 1
SHORT_END = f"(?:{C}{V}[^aeiouYJwx]|^{V}{C})$"   # closes in consonant, vowel, consonant

# Words with a stem of their own.
IRREGULAR = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
             "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
             "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
             "exceed": "exceed", "succeed": "succeed"}
# The suffix tables of the published algorithm. The longest suffix of a word decides.
PLURAL = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
DOUBLE = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble",
          "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
          "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al",
          "iviti": "ive", "biliti": "ble", "fulli": "ful"}
DERIVED = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
DROPPED = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate",
           "iti", "ous", "ive", "ize"]


def _marked(w: Column) -> Column:
    w = F.regexp_replace(w, "(^|[aeiou])y", "$1J")
    w = F.regexp_replace(w, r"(?:(?<=[^aeiouy])|(?!^)\G)yy", "YJ")      # runs of y alternate
    return F.regexp_replace(w, "(?<=[^aeiouy])y", "Y")


def _less(w: Column, n: Column | int) -> Column:
    """``w`` without its last ``n`` letters."""
    return F.left(w, F.length(w) - n)


def _replaced(w: Column, rules: list[tuple[str, str, str]]) -> Column:
    """``w`` (a one-word array) with its longest listed suffix replaced if the rest meets the rule's pattern.

    Rules: (suffix, new, pattern).
    """
    suffix = "(" + "|".join(s for s, _, _ in rules) + ")$"
    news = F.create_map(*[F.lit(x) for s, n, _ in rules for x in (s, n)])

    def cut(x: Column) -> Column:
        return F.struct(x.alias("w"), F.regexp_extract(x, suffix, 1).alias("s"))

    def put(x: Column) -> Column:
        met, stem = F.lit(False), _less(x["w"], F.length(x["s"]))
        for pattern in dict.fromkeys(p for _, _, p in rules):
            met = met | (x["s"].isin([s for s, _, p in rules if p == pattern]) & stem.rlike(pattern))
        return F.when(met, F.concat(stem, F.element_at(news, x["s"]))).otherwise(x["w"])

    return F.transform(F.transform(w, cut), put)


def _cut_ending(w: Column) -> Column:
    """-ied, -eed, -ed and -ing; what -ed or -ing leaves behind is mended."""

    def cut(x: Column) -> Column:
        return F.struct(x.alias("w"), F.when(x.rlike("(?:ied|eed)$"), F.lit(""))
                        .otherwise(F.regexp_extract(x, f"^(.*{V}.*)(?:ed|ing)$", 1)).alias("c"))

    def put(x: Column) -> Column:
        w, c = x["w"], x["c"]
        return (F.when(w.endswith("ied"), _less(w, F.when(F.length(w) == 4, 1).otherwise(2)))
                .when(w.endswith("eed"), F.when(w.rlike(f"{POSITIVE}.*eed$"), _less(w, 1)).otherwise(w))
                .when(c == "", w)
                .when(c.rlike("(?:at|bl|iz)$"), F.concat(c, F.lit("e")))
                .when(c.rlike(f"({C})\\1$"), F.when(c.rlike("[lsz]$"), c).otherwise(_less(c, 1)))
                .when(c.rlike(ONE) & c.rlike(SHORT_END), F.concat(c, F.lit("e"))).otherwise(c))

    return F.transform(F.transform(w, cut), put)


def _cut_last(w: Column) -> Column:
    """A last -e, then a last l of two."""

    def e(x: Column) -> Column:
        return F.when(x.endswith("e") & (_less(x, 1).rlike(MORE) | (_less(x, 1).rlike(ONE) & ~_less(x, 1).rlike(SHORT_END))),
                      _less(x, 1)).otherwise(x)

    def ll(x: Column) -> Column:
        return F.when(x.endswith("ll") & _less(x, 1).rlike(MORE), _less(x, 1)).otherwise(x)

    return F.transform(F.transform(w, e), ll)


def porter_stem(col: Column | str) -> Column:
    """Stem of one lower-case word; words of one or two letters are their own stems."""
    c = F.col(col) if isinstance(col, str) else col
    w = F.array(_marked(c))
    w = F.transform(w, lambda x: F.when((F.length(x) == 4) & x.endswith("ies"), _less(x, 1)).otherwise(x))
    w = _replaced(w, [(s, n, "") for s, n in PLURAL.items()])
    w = _cut_ending(w)
    # -alli first, since what it leaves is looked up again
    w = F.transform(w, lambda x: F.regexp_replace(F.regexp_replace(x, "(?<=..)Y$", "i"), f"^(.*{POSITIVE}.*al)li$", "$1"))
    w = _replaced(w, [(s, n, POSITIVE) for s, n in DOUBLE.items()] + [("logi", "log", f"{POSITIVE}|{V}$")])
    w = _replaced(w, [(s, n, POSITIVE) for s, n in DERIVED.items()])
    w = _replaced(w, [(s, "", MORE) for s in DROPPED] + [("ion", "", f"{MORE}.*(?<=[st])$")])
    own = F.element_at(F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv]), c)
    return F.when(F.length(c) <= 2, c).otherwise(F.coalesce(own, F.translate(_cut_last(w)[0], "JY", "yy")))


def porter_stems(words: DataFrame, col: str = "word", out: str = "stem") -> DataFrame:
    """(word, stem) of a column of lower-case words."""
    return words.select(col, porter_stem(col).alias(out))
