"""Small text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncated(text: Column, chars: int = 100) -> Column:
    """At most ``chars`` characters, and an ellipsis if some are left out."""
    return F.when(F.char_length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("…"))).otherwise(text)


def estimated_tokens(size: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.floor((size + 3) / 4).cast("long")


def ngram_words(text: Column) -> Column:
    """Words between white space, brackets, colons, commas, semicolons and quotes."""
    return F.array_remove(F.split(text, r"""(?U)[\s\[\](){}:,;"']+""", -1), "")


def ngram_at(words: Column, at: Column, n: int) -> Column:
    """The window of n words that starts at a place from 0, joined by a blank; null where none does.

    Fewer words are one n-gram at the place 0 or null, no words the empty one.
    """
    window = F.concat_ws(" ", *(F.get(words, at + i) for i in range(n)))
    few = F.when(F.coalesce(at, F.lit(0)) == 0, F.array_join(words, " "))
    return F.when(F.size(words) < n, few).when(at <= F.size(words) - n, window)


def is_continuation(line: Column) -> Column:
    """Whether a line looks like a part of the entry before it."""
    return line.rlike(r'^(?:[ \t]|at |File "|Caused by:|\.\.\.)')
