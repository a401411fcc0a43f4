"""Words, tokens, sentences and budgets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words that ranking leaves out.
STOPWORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
BLANKS = r"(?U)\s+"


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit("")))).cast("long")


def squeeze(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def all_tokens(text: Column) -> Column:
    """Lowered runs of two letters, digits or underscores or more."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def tokens(text: Column) -> Column:
    """all_tokens without stop words."""
    return F.filter(all_tokens(text), lambda t: ~t.isin(STOPWORDS))


def plain_terms(query: Column) -> Column:
    """A fielded query as ranking sees it: no field tags, quotes, parentheses or operators; the query itself if nothing is left."""
    bare = F.translate(F.regexp_replace(query, r"\b[A-Z_]+:", ""), '"()', "   ")
    kept = F.array_join(F.filter(words(bare), lambda w: ~w.isin("AND", "OR", "NOT")), " ")
    return F.when(kept == "", query).otherwise(kept)


def sentences(text: Column) -> Column:
    """Stretches up to closing marks, trimmed; not empty unless the text is blank."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), lambda s: F.trim(F.regexp_replace(s, r"^[ \n\t\r]+|[ \n\t\r]+$", "")))
    found = F.filter(found, lambda s: s != "")
    return F.when((F.size(found) == 0) & (F.trim(text) != ""), F.array(F.trim(text))).otherwise(found)


def sentence_suffix(index: Column) -> Column:
    """A to Z, then S26, S27 and so on."""
    return F.when(index < 26, F.char(index + 65)).otherwise(F.concat(F.lit("S"), index.cast("string")))


def word_budget(token_limit: int) -> int:
    """Words that a budget of model tokens allows."""
    return max(200, int(token_limit * 0.75))
