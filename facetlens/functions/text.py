"""Column-level text functions.

Every function here takes and returns a ``Column`` and is built from
``pyspark.sql.functions`` only, so it stays inside whole-stage codegen and
never crosses into a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for identical results.
END_MARKER = "<|im_end|>"
URL_PATTERN = r"http\S+"
NON_ALNUM_PATTERN = r"[^a-z0-9\s]"
# ASCII punctuation: escaped with a backslash before a term is spliced into a
# regular expression, so the term always matches literally.
REGEX_PUNCT = r"([!-/:-@\[-`{-~])"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    """Whitespace-class strip (``trim`` only removes spaces)."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def clean_text(col) -> Column:
    """lower -> drop URLs -> non [a-z0-9 whitespace] to space -> collapse -> strip.

    URLs are removed before punctuation so ``http://x.y`` disappears whole.
    """
    c = F.lower(_c(col).cast("string"))
    c = F.regexp_replace(c, URL_PATTERN, "")
    c = F.regexp_replace(c, NON_ALNUM_PATTERN, " ")
    c = F.regexp_replace(c, r"\s+", " ")
    return strip_ws(c)


def normalize(col) -> Column:
    """lower then strip."""
    return strip_ws(F.lower(_c(col)))


def tokens(col) -> Column:
    """Whitespace tokens with empty pieces removed."""
    return F.filter(F.split(_c(col), r"\s+"), lambda x: x != "")


def word_count(col) -> Column:
    return F.size(tokens(col))


def capitalize(col) -> Column:
    """First character upper, rest lower (``initcap`` would title-case every word)."""
    c = _c(col)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def strip_markers(col, label: str) -> Column:
    """Drop the end marker and ``<label>:``, newlines to spaces, strip."""
    c = F.replace(_c(col), F.lit(END_MARKER), F.lit(""))
    c = F.replace(c, F.lit(f"{label}:"), F.lit(""))
    c = F.replace(c, F.lit("\n"), F.lit(" "))
    return strip_ws(c)


def regex_literal(col) -> Column:
    """Escape ASCII punctuation so a column value can be matched literally."""
    return F.regexp_replace(_c(col), REGEX_PUNCT, r"\\$1")


# Letters that differ from others only in case though ``lower`` keeps them apart
# (dotless i, long s, final sigma, micro sign, variants of Greek and Cyrillic letters).
CASE_VARIANTS = ("\u0131\u017f\u03c2\u00b5\u0345\u1fbe\u03d0\u03f5\u03d1\u03f0\u03d6\u03f1\u03d5"
                 "\u1c80\u1c81\u1c82\u1c83\u1c84\u1c85\u1c86\u1c87\u1c88\u1e9b")
CASE_LETTERS = "is\u03c3\u03bc\u03b9\u03b9\u03b2\u03b5\u03b8\u03ba\u03c0\u03c1\u03c6\u0432\u0434\u043e\u0441\u0442\u0442\u044a\u0463\ua64b\u1e61"


def once(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` reads it."""
    return F.transform(F.array(value), fn)[0]


def folded(col) -> Column:
    """Text with case removed letter by letter: two texts fold alike just when a
    case-insensitive Unicode pattern takes one for the other."""
    low = F.lower(F.replace(_c(col), F.lit("\u0130"), F.lit("i")))
    return once(low, lambda x: F.when(x.rlike("[\u00b5\u0131-\u1fbe]"), F.translate(x, CASE_VARIANTS, CASE_LETTERS)).otherwise(x))


def _word_in(term, text, flags: str) -> Column:
    """The pattern begins with the bare term, which is searched for without looking
    at every word boundary on the way."""
    def found(t: Column) -> Column:
        return F.regexp_like(_c(text), F.concat(F.lit(flags), t, F.lit(r"(?<=\b"), t, F.lit(r")\b")))

    return once(regex_literal(term), found)


def whole_word_in(term, text) -> Column:
    """Case-insensitive whole-word occurrence of ``term`` in ``text``.

    ``\\b`` on both sides, Unicode-aware word characters; a term that ends in
    punctuation therefore never matches (there is no boundary after ``!``).
    """
    return _word_in(term, text, "(?iU)")


def whole_words_in(items, text) -> Column:
    """The items of an array that occur in ``text`` as whole words. The text is folded
    once, so that many items are searched for without regard to case."""
    return once(F.struct(_c(items).alias("items"), folded(text).alias("text")), lambda x: F.filter(
        x["items"], lambda t: _word_in(folded(t), x["text"], "(?U)")))


def split_terms(col, sep: str = ",") -> Column:
    """Comma list -> array of stripped, non-blank items."""
    return F.filter(F.transform(F.split(_c(col), sep), lambda x: strip_ws(x)),
                    lambda x: x != "")


def coerce_array_text(col) -> Column:
    """Array -> space-joined non-blank items; null -> ''."""
    return F.coalesce(
        F.array_join(F.filter(_c(col), lambda x: x.isNotNull() & (x != "")), " "),
        F.lit(""))


def coerce_scalar_text(col) -> Column:
    """Any non-array value -> its string form; null -> ''."""
    return F.coalesce(_c(col).cast("string"), F.lit(""))
