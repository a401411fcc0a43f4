"""Search predicates: fielded, boolean conditions on papers as ordinary columns, which Catalyst pushes and prunes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a condition without a field looks at.
EVERYWHERE = "text"


def term(word: str, column: str | Column = EVERYWHERE) -> Column:
    """Whether the word stands in the column, in any case."""
    return F.array_contains(_words(column), word.lower())


def normal(column: str | Column = EVERYWHERE) -> Column:
    """The words of a column, lowered, each with a blank on both sides of it."""
    return F.concat(F.lit(" "), F.array_join(_words(column), " "), F.lit(" "))


def words_of(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def phrase(text: str, column: str | Column = EVERYWHERE) -> Column:
    """Whether the words stand next to each other; a text without words stands nowhere."""
    return normal(column).contains(f" {' '.join(words_of(text))} ") if words_of(text) else F.lit(False)


def wildcard_regex(pattern: str) -> str:
    """A regular expression on normal() for a pattern in which * is any run of word characters and ? is one; signs part words, as in texts."""
    pieces = re.findall(r"[\w*?]+", pattern.lower())
    return " " + " ".join("".join({"*": "[^ ]*", "?": "[^ ]"}.get(c, c) for c in p) for p in pieces) + " " if pieces else "(?!)"


def wildcard(pattern: str, column: str | Column = EVERYWHERE) -> Column:
    """Whether words fit a pattern in which * is any run of characters and ? is one."""
    return normal(column).rlike(wildcard_regex(pattern))


def years(first: int | None = None, last: int | None = None, column: str = "year") -> Column:
    """Whether the year lies in a range; an end may be open."""
    year = F.col(column).try_cast("int")
    checks = [c for c in (year >= first if first is not None else None, year <= last if last is not None else None) if c is not None]
    out = F.lit(True)
    for c in checks:
        out = out & c
    return F.coalesce(out, F.lit(False))


def between(value: Column, first: Column | None = None, last: Column | None = None) -> Column:
    """Whether a number or date lies in a range; an end may be open, a missing value lies in none."""
    out = value.isNotNull()
    if first is not None:
        out = out & (value >= first)
    if last is not None:
        out = out & (value <= last)
    return F.coalesce(out, F.lit(False))


def one_of(column: str, *values: str) -> Column:
    """Whether the column has one of the values, in any case."""
    return F.coalesce(F.upper(F.col(column)).isin([v.upper() for v in values]), F.lit(False))


def flag(column: str, value: str) -> Column:
    return F.coalesce(F.col(column), F.lit(False)) == (value.upper() == "Y")


def _words(column: str | Column) -> Column:
    text = F.col(column) if isinstance(column, str) else column
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
