"""Text expressions: white space, words, sentences, slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# All characters that count as white space, with those regex engines leave out of \s.
WHITE = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Words a text needs to be taken from a corpus.
LEAST_WORDS = 80
#: Characters of a text that tell it from others when a corpus is read.
KEY_CHARS = 500


def strip(text: Column) -> Column:
    """Text without white space at either end."""
    return F.regexp_replace(text, rf"^[{WHITE}]+|[{WHITE}]+\z", "")


def collapse(text: Column) -> Column:
    """Each run of white space as one blank."""
    return F.regexp_replace(text, rf"[{WHITE}]+", " ")


def words(text: Column) -> Column:
    """Array of the pieces between white space; none for a blank text, null for null."""
    bare = strip(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, rf"[{WHITE}]+"))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def prefix_key(text: Column) -> Column:
    """What makes two corpus texts the same: the first characters, cut before white space is collapsed."""
    return strip(collapse(F.substring(text, 1, KEY_CHARS)))


def sentences(text: Column) -> Column:
    """Array of sentences: cut at white space behind ``.``, ``!`` or ``?``; blank pieces are left out."""
    pieces = F.transform(F.split(strip(text), rf"(?<=[.!?])[{WHITE}]+"), strip)
    return F.filter(pieces, lambda s: s != "")


def join_sentences(pieces: Column) -> Column:
    """Sentences with one blank between them; blank ones are skipped."""
    return F.array_join(F.filter(F.transform(pieces, strip), lambda s: s != ""), " ")


def first_long_text(fields: Sequence[str], least: int = LEAST_WORDS) -> Column:
    """The first field that has enough words; null where none has."""
    return F.coalesce(*(F.when(word_count(F.col(f)) >= least, F.col(f)) for f in fields))


def first_long_field(fields: Sequence[str], least: int = LEAST_WORDS) -> Column:
    """The name of that field."""
    return F.coalesce(*(F.when(word_count(F.col(f)) >= least, F.lit(f)) for f in fields))


def token_slice(tokens: Column, begin: int, end: int) -> Column:
    """Text of the tokens from ``begin`` up to ``end``, counted from 0."""
    return strip(F.array_join(F.slice(tokens, begin + 1, end - begin), " "))
