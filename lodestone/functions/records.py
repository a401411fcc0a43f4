"""Derivations on bibliographic records, as column expressions. Empty and null mean the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import squeeze


def or_else(*choices: Column) -> Column:
    """The first choice that is neither null nor empty, else the empty string."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in choices), F.lit(""))


def paper_key(pmid: Column, doi: Column, title: Column) -> Column:
    return or_else(pmid, doi, title)


def author_name(first: Column, last: Column, full: Column) -> Column:
    first, last, full = (F.trim(F.coalesce(c, F.lit(""))) for c in (first, last, full))
    return F.when((first != "") & (last != ""), F.concat(first, F.lit(" "), last)).when(last != "", last).otherwise(full)


def affiliation_text(people: Column, most: int = 200) -> Column:
    """`name: affiliation` of each of people (name, affiliation) with an affiliation, which is cut, joined by `; `."""
    known = F.filter(people, lambda p: F.coalesce(p["affiliation"], F.lit("")) != "")
    return F.array_join(F.transform(known, lambda p: F.concat(p["name"], F.lit(": "), F.substring(p["affiliation"], 1, most))), "; ")


def yes(flag: Column) -> Column:
    return F.coalesce(flag == "Y", F.lit(False))


def free_full_text(ids: Column, urls: Column) -> Column:
    """Whether there is any full-text id, or a URL (availabilityCode) that is open."""
    return F.coalesce(F.size(ids) > 0, F.lit(False)) | F.coalesce(F.exists(urls, lambda u: F.upper(u["availabilityCode"]) == "OA"), F.lit(False))


def full_text_id(eligible: Column, ids: Column, pmcid: Column) -> Column:
    """Where to fetch the full text; empty if the record isn't eligible or has no id. Digits alone get the prefix PMC."""
    raw = F.upper(F.trim(or_else(F.get(ids, F.lit(0)), pmcid)))
    return F.when(~eligible, "").when(raw.rlike("^[0-9]+$"), F.concat(F.lit("PMC"), raw)).otherwise(raw)


def percent_encoded(text: Column) -> Column:
    """Percent encoding without safe characters beyond letters, digits, `_`, `.`, `-` and `~`."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def article_url(base: str, source: Column, record_id: Column) -> Column:
    whole = (F.coalesce(source, F.lit("")) != "") & (F.coalesce(record_id, F.lit("")) != "")
    return F.when(whole, F.concat(F.lit(base.rstrip("/") + "/"), percent_encoded(source), F.lit("/"), percent_encoded(record_id))).otherwise("")


def snippets(full_text_spans: Column, abstract_spans: Column, excerpt: Column, abstract: Column) -> Column:
    """Spans of the full text, else of the abstract, else excerpt or abstract whole; trimmed, none empty."""
    chosen = F.when(F.coalesce(F.size(full_text_spans), F.lit(0)) > 0, full_text_spans).when(F.coalesce(F.size(abstract_spans), F.lit(0)) > 0, abstract_spans).otherwise(F.array(or_else(excerpt, abstract)))
    return F.filter(F.transform(chosen, lambda s: F.trim(s)), lambda s: s != "")


def license_code(value: Column) -> Column:
    """One spelling for a license family: upper case, hyphens, CC in front of BY-NC-SA."""
    code = F.regexp_replace(F.regexp_replace(F.upper(squeeze(value)), "[_ ]", "-"), "-+", "-")
    return F.when(code == "BY-NC-SA", "CC-BY-NC-SA").otherwise(code)


def role_name(value: Column) -> Column:
    """One spelling for a contribution role: plain hyphens, single blanks, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(value, "–—", "--"), r"\s+", " ")))


def is_isbn(value: Column) -> Column:
    bare = F.translate(value, "- ", "")
    return bare.rlike(r"^([0-9]{9}[0-9Xx]|[0-9]{13})$")


def is_day(value: Column) -> Column:
    return value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(value, "yyyy-MM-dd").isNotNull()


def day_key(value: Column) -> Column:
    """The day a date stands for when dates are put in order; January 1st for a year."""
    return F.when(value.rlike(r"^[0-9]{4}$"), F.try_to_date(F.concat(value, F.lit("-01-01")), "yyyy-MM-dd")).when(is_day(value), F.try_to_date(value, "yyyy-MM-dd"))


def reply_ids(reply: Column) -> Column:
    """The ids in a model's JSON reply: code fences off, the whole string, else the first to last bracket; null if there is none."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```(json)?\s*", ""), r"\s*```$", ""))
    shape = "relevant_ids array<string>"
    inner = F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.coalesce(F.from_json(bare, shape)["relevant_ids"], F.from_json(inner, shape)["relevant_ids"])
