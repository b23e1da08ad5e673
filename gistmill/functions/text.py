"""Text cleaning as Column expressions; whitespace means all Unicode whitespace."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from gistmill import fixed_values as fx

# The same 29 characters, faster in Java: Latin-1 is looked up in a bitmap, and for
# anything else one range test comes before the tests of single characters.
_WS = rf"[{fx.WS_LATIN}[\x{{1680}}-\x{{3000}}&&[{fx.WS_OTHER}]]]"
_QUOTED = rf"(?s)\A[{fx.OPENING_QUOTES}](.*)[{fx.CLOSING_QUOTES}]\z"
_ITALIC = r"(?s)\A(?:\*|\*([^*].*)\*)\z"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{_WS}+|{_WS}+\z", "")


def squeeze_whitespace(text: Column) -> Column:
    """Every run of whitespace becomes one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, f"{_WS}+", " "))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words: 0 for an empty text, null for a null."""
    return F.regexp_count(text, F.lit(f"[^{_WS}]+"))


def content_id(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, fx.ID_HEX_CHARS)


def sentences(text: Column, limit: int = -1) -> Column:
    return F.split(text, fx.SENTENCE_BOUNDARY.replace(fx.WS, _WS), limit)


def first_sentence(text: Column) -> Column:
    """Text before the first sentence boundary, or all of it if there is none."""
    return strip(sentences(strip(text), 2)[0])


def clean_completion(text: Column) -> Column:
    """Drop chat boilerplate around a model's answer.

    In this order: opening phrase, one label line, one pair of quotes, one pair
    of single asterisks; trimmed after each.
    """
    text = strip(text)
    for pattern, kept in (
        (fx.PREAMBLE, ""),
        (fx.LABEL_LINE, ""),
        (_QUOTED, "$1"),
        (_ITALIC, "$1"),
    ):
        text = strip(F.regexp_replace(text, pattern.replace(fx.WS, _WS), kept))
    return text


def ellipsize(text: Column, chars: int = fx.EXAMPLE_CHARS) -> Column:
    cut = F.concat(F.substring(text, 1, chars), F.lit("…"))
    return F.when(F.length(text) > chars, cut).otherwise(text)
