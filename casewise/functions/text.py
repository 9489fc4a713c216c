"""Text cleaning, tokenising and shortening as Spark columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.config import ASCII_PUNCTUATION, STOPWORDS
from casewise.functions.unicode import nfkc

# Whitespace as Unicode text defines it; Java's own \s is ASCII only.
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
TOKEN = rf"[{WORD}]+|[^{WORD}{SPACE}]"


def with_once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """``withColumn`` for a column that costs much: worked out once a row, whoever reads it.

    A plain projection is merged into every filter and expression above it, each with a copy of the work. A generator
    of one row is not.
    """
    once = "_once"
    return df.select("*", F.explode(F.array(column)).alias(once)).withColumn(name, F.col(once)).drop(once)


def strip(text: Column) -> Column:
    """Remove whitespace of any kind at both ends (``trim`` only knows the space)."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def text_or_blank(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def stripped_or_blank(text: Column) -> Column:
    return strip(text_or_blank(text))


def normalize_text(text: Column) -> Column:
    """NFKC and uniform line ends."""
    return F.regexp_replace(nfkc(text), "\r\n?", "\n")


def clean_whitespace(text: Column) -> Column:
    """Collapse whitespace runs to one space and strip."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def tokenize(text: Column) -> Column:
    """Runs of word characters, or single characters that are neither word nor space."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def lower_tokens(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def remove_stopwords(tokens: Column, stopwords: Iterable[str] = STOPWORDS) -> Column:
    words = sorted(stopwords)
    return F.filter(tokens, lambda token: ~token.isin(words))


def strip_punctuation(tokens: Column) -> Column:
    """Delete ASCII punctuation inside tokens and drop tokens left empty."""
    bare = F.transform(tokens, lambda token: F.translate(token, ASCII_PUNCTUATION, ""))
    return F.filter(bare, lambda token: token != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+"))


def summarize(text: Column, limit: int = 180) -> Column:
    """One-line preview of at most ``limit`` characters; a blank text shows as ``-``."""
    line = clean_whitespace(text)
    shortened = F.concat(F.rtrim(F.substring(line, 1, limit)), F.lit("..."))
    return (
        F.when(line == "", F.lit("-")).when(F.char_length(line) <= limit, line).otherwise(shortened)
    )


def with_channel(text: Column, channel: Column) -> Column:
    """Prefix a case text with its source channel, when there is one."""
    name = stripped_or_blank(channel)
    prefixed = F.concat(F.lit("Canal de origem: "), name, F.lit("\nTexto do caso: "), text)
    return F.when(name == "", text).otherwise(prefixed)


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """True where any of the terms occurs as a substring."""
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(text, F.lit(term))
    return found
