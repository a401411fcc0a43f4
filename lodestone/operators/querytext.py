"""Search conditions from the text of a query, as one column that Catalyst sees whole.

Operands side by side are joined by AND, which binds closer than OR; NOT goes before an operand. A field holds for its
value or for all of a group in parentheses. A text with a fault raises a ValueError, as does a bare value of several words.
"""

from __future__ import annotations

import functools
import operator
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import search as S
from lodestone.operators import validation as V
from lodestone.operators.parsing import parse
from lodestone.operators.validation import FLAG_FIELDS

#: How a field is matched and in which columns of the papers; sections are a map from the field's name to text.
FIELDS = {
    "TITLE": ("text", "title"), "ABSTRACT": ("text", "abstract"), "TITLE_ABS": ("text", "title", "abstract"), "BODY": ("text", "text"), "AUTH": ("text", "authors"), "AFF": ("text", "affiliations"), "JOURNAL": ("text", "journal"),
    "PUB_YEAR": ("year", "year"), "CITED": ("number", "cited"), "LANG": ("one", "lang"), "SRC": ("one", "source"), "LICENSE": ("one", "license"), "PUB_TYPE": ("one", "pub_type"),
    "EXT_ID": ("one", "pmid"), "PMCID": ("one", "pmcid"), "DOI": ("one", "doi"), "ISSN": ("one", "issn"), "ISBN": ("one", "isbn"), "BOOK_ID": ("one", "book_id"),
    "OPEN_ACCESS": ("flag", "is_open_access"), "IN_EPMC": ("flag", "in_store"), "HAS_FREE_FULLTEXT": ("flag", "has_free_full_text"),
    **{f: ("date", f.lower()) for f in ("E_PDATE", "P_PDATE", "FIRST_PDATE", "FIRST_IDATE", "UPDATE_DATE", "CREATION_DATE", "EMBARGO_DATE")},
    **{f: ("section", "sections") for f in ("INTRO", "METHODS", "RESULTS", "DISCUSS", "CONCL", "CASE", "ACK_FUND", "AUTH_CON", "COMP_INT", "SUPPL", "APPENDIX", "TABLE", "FIG", "REF", "DATA_AVAILABILITY", "ABBR", "KEYWORD", "OTHER")},
}
FIELDS = {**{f: ("flag", f.lower()) for f in FLAG_FIELDS}, **FIELDS}


class Leaf(NamedTuple):
    """One operand: what is looked for, how, and in which columns of the papers (a section is a key of the map `sections`)."""

    kind: str
    columns: tuple[str, ...]
    #: Words of a phrase joined by blanks, a pattern of a wildcard, a value, or the ends of a range, None where it is open.
    value: str | None = None
    first: str | None = None
    last: str | None = None


def field_columns(field: str) -> tuple[str, ...]:
    """How a field is matched, then its columns: those listed, else the column of its name, as text."""
    if not field:
        return ("text", S.EVERYWHERE)
    if field not in V.FIELDS and field not in FIELDS:
        raise ValueError(f"there is nothing to look for {field} in")
    return FIELDS.get(field, ("text", field.lower()))


def _ends(field: str, kind: str, value: str) -> tuple[str | None, str | None]:
    """Both ends of [first TO last], where * is open, or a value as both."""
    ends = [value, value]
    if value.startswith("["):
        ends = [x.strip() for x in re.split(r"\s+TO\s+", value.strip("[] "), flags=re.IGNORECASE)]
        if len(ends) != 2:
            raise ValueError(f"no range: {value}")
    shape = {"year": r"\d{4}", "number": r"-?\d+", "date": r"\d{4}(-\d\d-\d\d)?"}[kind]
    if not all(re.fullmatch(shape, x) or x == "*" and value.startswith("[") for x in ends):
        raise ValueError(f"no {kind} for {field}: {value}")
    first, last = (None if x == "*" else x for x in ends)
    if kind == "date":  # a year is all of its days
        first, last = first and (first if len(first) > 4 else f"{first}-01-01"), last and (last if len(last) > 4 else f"{last}-12-31")
    return first, last


def leaf(field: str, kind: str, text: str) -> Leaf:
    """The operand that a node of a query's tree stands for."""
    how, *columns = field_columns(field)
    quoted = kind in ("quoted", "single_quoted")
    value = text.strip(text[0]).replace('""', '"') if quoted else text
    if kind == "bare" and re.search(r"\s", value):
        raise ValueError(f"several words for {field} need quotes or parentheses: {text}")
    if how in ("text", "section"):
        columns = [f"sections.{field.lower()}"] if how == "section" else columns
        if not quoted and re.search(r"[*?]", value):
            return Leaf("wildcard", tuple(columns), S.wildcard_regex(value))
        return Leaf("phrase", tuple(columns), " ".join(S.words_of(value)))
    if how in ("flag", "one"):
        return Leaf(how, tuple(columns), value.upper())
    return Leaf(how, tuple(columns), None, *_ends(field, how, value))


def program(query: str) -> list[tuple[str, int, Leaf | None]]:
    """(op, operands, leaf) of a query's tree, operands before operators. A text with a fault, or without terms, raises a ValueError."""
    p = parse(query)
    if p.root is None or p.faults or p.quote_faults:
        raise ValueError(f"{'; '.join([*p.faults, *p.quote_faults]) or 'an empty query'}: {query}")
    return [(op, n, leaf(field, kind, text) if op == "term" else None) for op, n, field, kind, text in p.postfix()]


def _holds(x: Leaf, has: set[str]) -> Column:
    if not has.issuperset(c.split(".")[0] for c in x.columns):
        raise ValueError(f"there is nothing to look for {' and '.join(x.columns)} in")
    columns = [F.element_at(F.col("sections"), c.split(".")[1]) if c.startswith("sections.") else F.col(c) for c in x.columns]
    any_column = lambda check: functools.reduce(operator.or_, map(check, columns))
    if x.kind == "phrase":
        return any_column(lambda c: S.phrase(x.value, c))
    if x.kind == "wildcard":
        return any_column(lambda c: S.normal(c).rlike(x.value))
    if x.kind == "flag":
        return S.flag(x.columns[0], x.value)
    if x.kind == "one":
        return S.one_of(x.columns[0], x.value)
    if x.kind == "year":
        return S.years(x.first and int(x.first), x.last and int(x.last), x.columns[0])
    end = (lambda v: F.lit(int(v))) if x.kind == "number" else (lambda v: F.to_date(F.lit(v)))
    return S.between(columns[0], x.first and end(x.first), x.last and end(x.last))


def condition(query: str, columns: list[str]) -> Column:
    """The condition that query sets on papers with these columns."""
    has, stack = set(columns), []
    for op, n, x in program(query):
        if op == "term":
            stack.append(_holds(x, has))
        elif op == "nothing":
            stack.append(F.lit(False))
        elif op == "not":
            stack.append(~stack.pop())
        else:
            parts = [stack.pop() for _ in range(n)][::-1]
            stack.append(functools.reduce(operator.and_ if op == "and" else operator.or_, parts))
    return stack.pop()


def matching(papers: DataFrame, query: str) -> DataFrame:
    """The papers that query asks for."""
    return papers.where(condition(query, papers.columns))
