"""Sub-queries in three tiers without a model: words, alternatives learned from first results, and narrow conditions; and limits of years in questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import plain_terms, tokens
from lodestone.operators import ranking as R
from lodestone.scratch import materialize

#: First results that terms are learned from, terms that are kept of a question, and the part of a question's own terms in their weights.
FEEDBACK, TERMS, OWN = 10, 8, 0.5
#: Tenths of the sub-queries that each tier gets.
TIERS = (4, 4, 2)


def expanded_terms(docs: DataFrame, questions: DataFrame, feedback: int = FEEDBACK, terms: int = TERMS) -> DataFrame:
    """(question_id, place, term, weight): a question's terms by weight, its own and those of the first results for it (a relevance model, RM3).

    A term of results weighs the sum, over the first results, of its share of the document's terms times the document's share of all their scores; a question's own
    terms weigh their share of it. Only documents that are first results for some question are read for their terms. Ties go by the alphabet.
    """
    hits = R.bm25_top(docs.select("doc_id", "text"), questions, feedback).select("question_id", "doc_id", "score")
    whole = F.sum("score").over(Window.partitionBy("question_id"))
    hits = materialize(hits.withColumn("share", F.col("score") / whole), "feedback")
    read = docs.select("doc_id", "text").join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    counted = read.select("doc_id", tokens(F.col("text")).alias("terms")).select("doc_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    shares = counted.groupBy("doc_id", "term").agg((F.count("*") / F.first("n").cast("double")).alias("p"))
    learned = hits.join(shares, "doc_id").groupBy("question_id", "term").agg(F.sum(F.col("share") * F.col("p") * (1 - OWN)).alias("weight"))
    asked = questions.select("question_id", tokens(plain_terms(F.col("text"))).alias("terms")).select("question_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    own = asked.groupBy("question_id", "term").agg((F.lit(OWN) * F.count("*") / F.first("n").cast("double")).alias("weight"))
    both = learned.union(own).groupBy("question_id", "term").agg(F.sum("weight").alias("weight"))
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("weight", 9)), "term")
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= terms).select("question_id", "place", "term", "weight")


def tiered_queries(docs: DataFrame, questions: DataFrame, most: int) -> DataFrame:
    """(question_id, query_idx, text): at most `most` sub-queries, 40 percent words alone, 40 percent alternatives in titles and abstracts, 20 percent two conditions that both hold.

    Words: the question, then its strongest terms, more and more of them. Alternatives: runs of expanded terms joined by OR. Conditions: one term with one of the next two. So no sub-query has more than one AND.
    """
    terms = materialize(expanded_terms(docs, questions), "terms")
    listed = terms.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("t"))
    rows = questions.select("question_id", "text").join(listed, "question_id")
    n1 = max(1, most * TIERS[0] // sum(TIERS))
    n2 = max(1, most * TIERS[1] // sum(TIERS)) if most > 1 else 0
    n3 = max(0, most - n1 - n2)
    term = lambda k: F.get("t", F.lit(k))
    words = [plain_terms(F.col("text")), *(F.array_join(F.slice("t", F.lit(1), F.lit(k + 2)), " ") for k in range(n1 - 1))]
    field = lambda x: F.concat(F.lit('TITLE_ABS:"'), x, F.lit('"'))
    either = [F.array_join(F.transform(F.slice("t", F.lit(2 * k + 1), F.lit(4)), field), " OR ") for k in range(n2)]
    narrow = [F.concat(term(k), F.lit(" AND ("), field(term(k + 1)), F.lit(" OR "), field(term(k + 2)), F.lit(")")) for k in range(n3)]
    made = rows.select("question_id", F.posexplode(F.array(*words, *either, *narrow)).alias("query_idx", "text")).where("trim(text) <> ''")
    first = made.groupBy("question_id", "text").agg(F.min("query_idx").alias("query_idx"))
    return first.select("question_id", "query_idx", "text")


NUMBERS = "two three four five six seven eight nine ten".split()


def year_window(question: Column, this_year: int) -> Column:
    """(first, last): the years that a question limits itself to, both included; null ends are open.

    `last five years`, `past 3 years` and `recent` (three years) count this year; `since 2010`, `after 2010`, `before 2010`, `until 2010`, `between 2001 and 2005`, `2001-2005`, `in 2003`.
    """
    q = F.lower(F.coalesce(question, F.lit("")))
    year = r"((?:19|20)\d{2})"
    found = lambda pattern, k=1: F.nullif(F.regexp_extract(q, pattern, k), F.lit(""))
    number = lambda pattern, k=1: found(pattern, k).cast("int")
    said = found(rf"\b(?:last|past|previous) (\d+|{'|'.join(NUMBERS)}) years?\b")
    n = F.coalesce(said.try_cast("int"), (F.array_position(F.array(*map(F.lit, NUMBERS)), said) + 1).cast("int"))
    n = F.when(q.rlike(r"\b(?:last|past|previous|this) year\b"), F.when(q.rlike(r"\bthis year\b"), 1).otherwise(2)).otherwise(F.coalesce(n, F.when(q.rlike(r"\brecent\b"), 3)))
    between, dash = rf"\b(?:between|from) {year} (?:and|to) {year}\b", rf"\b{year} ?[-–] ?{year}\b"
    first = F.coalesce(number(between), number(dash), number(rf"\bsince {year}\b"), number(rf"\bafter {year}\b") + 1, number(rf"\bin {year}\b"), F.lit(this_year) - n + 1)
    last = F.coalesce(number(between, 2), number(dash, 2), number(rf"\bbefore {year}\b") - 1, number(rf"\b(?:until|up to) {year}\b"), number(rf"\bin {year}\b"), F.when(n.isNotNull(), this_year))
    return F.struct(first.alias("first"), last.alias("last"))


def within_years(rows: DataFrame, questions: DataFrame, this_year: int) -> DataFrame:
    """rows (question_id, year, ...) whose year lies in what the question asks for; a row without a year only where nothing is asked."""
    limits = questions.select("question_id", year_window(F.col("text"), this_year).alias("w")).where("w.first is not null or w.last is not null")
    year = F.col("year").try_cast("int")
    kept = rows.join(limits, "question_id", "left")
    inside = (F.col("w.first").isNull() | (year >= F.col("w.first"))) & (F.col("w.last").isNull() | (year <= F.col("w.last")))
    return kept.where(F.col("w").isNull() | F.coalesce(inside, F.lit(False))).drop("w")
