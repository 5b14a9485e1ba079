from facetlens.functions.text import (  # noqa: F401
    END_MARKER, capitalize, clean_text, coerce_array_text, coerce_scalar_text,
    normalize, regex_literal, split_terms, strip_markers, strip_ws, tokens,
    whole_word_in, word_count)
