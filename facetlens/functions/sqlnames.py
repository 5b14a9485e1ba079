"""Session SQL functions: the text functions under names for ``spark.sql``.

They are SQL expressions, not Python functions, so Catalyst inlines them and
filters and projections around them are optimised as usual.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from facetlens.functions.text import NON_ALNUM_PATTERN, URL_PATTERN
from facetlens.operators.answers import LABEL_PREFIXES, SKIP_PHRASES


def _sub(text: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({text}, r'{pattern}', r'{new}')"


def _strip(text: str) -> str:
    return _sub(text, r"^\s+|\s+$")


def _clean_opinion(text: str) -> str:
    steps = [(r"^\d+\.\s*", ""), (r"(?i)^ID\s*", ""), (r"\.+\z", ""), ("<[^>]+>", ""), (r"\([^)]+\)", ""),
             (r"(?s)^.*Answer:\s*(.*?)\s*\z", "$1"), (r"(?s)^\s*([^.]*?)\s*\..*\z", "$1"),
             (r"(?is)^(?=.{31})(?=.*(?:" + "|".join(SKIP_PHRASES) + r")).*\z", "")]
    for pattern, new in steps + [(rf"(?i)^{w}\s*", "") for w in LABEL_PREFIXES]:
        text = _sub(text, pattern, new)
    return _strip(text)


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create ``clean_text``, ``normalize_text`` and ``clean_opinion`` for this session; returns their names."""
    words = _sub(_sub(_sub("lower(t)", URL_PATTERN), NON_ALNUM_PATTERN, " "), r"\s+", " ")
    bodies = {"clean_text": _strip(words), "normalize_text": _strip("lower(t)"),
              "clean_opinion": _clean_opinion("coalesce(t, '')")}
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS STRING RETURN {body}")
    return list(bodies)
