"""Text expressions: strip, model input, tokens and n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: white space as Unicode defines it, plus the four separators
# U+001C to U+001F.
_SPACE = r"[\s\x1c-\x1f]+"
_STRIP = rf"(?U)^{_SPACE}|{_SPACE}$"

# Fixed value: a token is a run of two or more word characters.
TOKEN_PATTERN = r"([\p{L}\p{N}_]{2,})"


def strip(text: Column) -> Column:
    """Strip all Unicode white space; Spark's ``trim`` takes U+0020 only."""
    return F.regexp_replace(text, _STRIP, "")


def model_input(title: Column, text: Column) -> Column:
    """Title and text joined by ``'. '``, with leading dots and spaces removed."""
    joined = F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(text, F.lit("")))
    return F.ltrim(joined, F.lit(". "))


def terms_sql(column: str, ngram_max: int) -> str:
    """SQL for the terms of a text: tokens, then n-grams up to ``ngram_max``.

    SQL text, because the ML stages take the same expression (SQLTransformer).
    """
    pattern = TOKEN_PATTERN.replace("\\", "\\\\")
    tokens = f"regexp_extract_all(lower({column}), '{pattern}', 1)"
    if ngram_max == 1:
        return tokens
    # Level n pairs level n-1 with the tokens n-1 places on; short texts give [].
    levels, previous = ["t"], "t"
    for n in range(2, ngram_max + 1):
        size = f"greatest(size(t) - {n - 1}, 0)"
        previous = (
            f"zip_with(slice({previous}, 1, {size}), slice(t, {n}, {size}), "
            "(a, b) -> concat(a, ' ', b))"
        )
        levels.append(previous)
    # The one-element transform names the token array once, so it is built once.
    return f"transform(array({tokens}), t -> concat({', '.join(levels)}))[0]"


def terms(column: str, ngram_max: int = 1) -> Column:
    return F.expr(terms_sql(column, ngram_max))
