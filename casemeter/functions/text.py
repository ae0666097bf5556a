"""Text normalisation, tokens and n-grams as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The line-break mark that becomes a space, and the word pattern
#: (two or more word characters).
LINE_BREAK_MARK = "<br />"
WORD_PATTERN = r"(?U)\b\w\w+\b"


def normalise(text: Column, max_chars: int | None = None) -> Column:
    out = F.replace(text, F.lit(LINE_BREAK_MARK), F.lit(" "))
    return out if max_chars is None else F.substring(out, 1, max_chars)


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def with_bigrams(tokens: Column) -> Column:
    """Unigrams followed by space-joined bigrams."""
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))),
        F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(tokens, pairs)
