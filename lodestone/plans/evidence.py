"""From questions to ranked evidence passages, for many questions in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions.records import snippets
from lodestone.functions.text import plain_terms, sentences, tokens, word_budget
from lodestone.operators import evidence as E
from lodestone.operators import ranking as R
from lodestone.operators.validation import usable, validate
from lodestone.plans.judging import JUDGE_PROMPT, PLAN_PROMPT, Model, judge_batches, model_queries, payloads
from lodestone.scratch import materialize, release

#: Columns of papers that passages carry where there are such.
CARRIED = ["authors", "affiliations", "journal", "url", "pmid", "pmcid", "doi", "is_open_access", "has_pdf"]
Stage = Callable[[str], None]


class RunCounts:
    """What a run of passages() counts of its stages as they are written, without further jobs; final_count is there once the passages have been read.

    query_count, candidate_count, excerpt_count, ft_relevant_count, abstract_relevant_count and final_count, over all questions, and model_failures,
    the calls of models that raised.
    """

    def __init__(self, spark: SparkSession):
        self._seen: dict[str, Observation] = {}
        self._failures = spark.sparkContext.accumulator(0)

    def observed(self, df: DataFrame, **counts: Column) -> DataFrame:
        one = Observation()
        self._seen |= dict.fromkeys(counts, one)
        return df.observe(one, *(c.alias(name) for name, c in counts.items()))

    @property
    def failures(self) -> Accumulator:
        return self._failures

    def __getitem__(self, name: str) -> int:
        return self._failures.value if name == "model_failures" else self._seen[name].get[name]

    def all(self) -> dict[str, int]:
        return {name: self[name] for name in [*self._seen, "model_failures"]}


def plan_queries(questions: DataFrame, most: int) -> DataFrame:
    """(question_id, query_idx, text): the whole question, then its first and its last half of terms; blank and repeated ones go."""
    terms = F.array_distinct(tokens(F.col("text")))
    half = F.greatest(F.lit(1), F.ceil(F.size(terms) / 2)).cast("int")
    made = F.array(plain_terms(F.col("text")), F.array_join(F.slice(terms, F.lit(1), half), " "), F.array_join(F.slice(terms, half + 1, F.greatest(F.size(terms) - half, F.lit(0))), " "))
    rows = questions.select("question_id", F.posexplode(made).alias("query_idx", "text")).where("trim(text) <> ''")
    once = E.first_wins(rows, ["question_id", "text"], "query_idx")
    return once.where(F.col("query_idx") < most).select("question_id", "query_idx", "text")


def search(papers: DataFrame, queries: DataFrame, page_size: int) -> DataFrame:
    """(question_id, query_idx, rank, doc_id, score): the best papers for each sub-query.

    Words alone are ranked, whichever of them a paper has. Operators, fields, quotes, parentheses and wildcards make a sub-query a condition
    that its papers meet; positive words rank them. One that names a field without a column finds nothing, and leaves the others alone. See bm25_top().
    """
    keyed = queries.select(F.struct("question_id", "query_idx").alias("question_id"), "text")
    hits = R.bm25_top(papers, keyed, page_size, fielded=True, skip=True)
    return hits.select("question_id.question_id", "question_id.query_idx", "rank", "doc_id", "score")


def sub_queries(questions: DataFrame, most: int, planner: Model | None = None, template: str = PLAN_PROMPT, validator: Callable[[DataFrame], DataFrame] = validate, failures: Accumulator | None = None) -> DataFrame:
    """(question_id, query_idx, text): a planner's queries that are valid, or all of a question's if none is; without a planner those of plan_queries()."""
    if planner is None:
        return plan_queries(questions, most)
    planned = materialize(model_queries(questions, planner, most, template, failures), "planned")  # the model is asked once
    keyed = planned.withColumn("query_id", F.struct("question_id", "query_idx"))
    checked = validator(keyed.select("query_id", F.col("text").alias("query"))).select("query_id", "valid")
    return usable(keyed.join(checked, "query_id"), "question_id").select("question_id", "query_idx", "text")


def _cited_by_words(rows: DataFrame) -> DataFrame:
    """Sentences that hold a term of the question: by the number of terms, then by place. A paper's best sentence places it."""
    cited = E.lexical_judge(rows, F.col("terms"))
    cited = cited.withColumn("judge_pos", F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("hits"), "sent_idx")))
    best = F.max("hits").over(Window.partitionBy("pair"))
    return cited.withColumn("first_by", F.struct((-best).cast("long").alias("x"), F.col("cand_pos").cast("long").alias("y")))


def _cited_by_model(rows: DataFrame, candidates: DataFrame, questions: DataFrame, judge: Model, size: int, template: str, failures: Accumulator | None = None) -> DataFrame:
    """Sentences that a model cites, batch by batch of candidates. Ids it makes up are passed over; a paper's first sentence places it."""
    papers = payloads(candidates.select("pair", "paper_id", *[c for c in ("title", "authors", "affiliations", "journal", "year") if c in candidates.columns]), rows, "pair")
    items = E.batches(candidates.select("question_id", "pair", "cand_pos"), size).join(papers, "pair")
    items = items.join(questions.select("question_id", F.col("text").alias("question")), "question_id")
    ids = judge_batches(items.select("question_id", "batch", "cand_pos", "paper", "question"), judge, template, failures)
    ids = materialize(ids, "cited").select("question_id", "sid", F.struct("batch", "pos").alias("judge_pos"))
    cited = rows.join(ids, ["question_id", "sid"])
    first = F.min("judge_pos").over(Window.partitionBy("pair"))
    return cited.withColumn("first_by", F.struct(first["batch"].alias("x"), first["pos"].alias("y")))


def passages(
    papers: DataFrame, paragraphs: DataFrame, questions: DataFrame, settings: Settings | None = None, on_stage: Stage = lambda name: None,
    planner: Model | None = None, judge: Model | None = None, plan_prompt: str = PLAN_PROMPT, judge_prompt: str = JUDGE_PROMPT,
    split: Callable[[Column], Column] = sentences, validator: Callable[[DataFrame], DataFrame] = validate, counts: RunCounts | None = None,
) -> DataFrame:
    """(question_id, final_pos, doc_id, paper_id, title, year, pool, has_excerpt, has_full_text, evidence, ...): at most top_k passages a question.

    papers (doc_id, paper_id, title, abstract, in_store, year, text[, has_free_full_text, authors, journal, url, ...]), paragraphs
    (doc_id, para_idx, text[, section_title, section_type]), questions (question_id, text). Sub-queries find candidates; the
    first hit of a paper counts. Papers in the store or with free full text get an excerpt: their paragraphs ranked
    for the question, within a word budget. A judge cites sentences of excerpts and of abstracts; cited sentences become
    spans within a budget. Two pools are capped and joined; a question whose pools are empty keeps all its candidates.

    planner and judge are models behind functions from prompt to reply; without them, terms of the question plan
    and judge. split cuts texts into sentences (see segmentation.py for one that learns abbreviations). What several branches read is written once to the scratch folder. on_stage is called as each stage begins.
    validator checks a planner's queries; counts is filled as the stages are written. questions may have prior, an array of evidence that is known.
    """
    s = settings or Settings.load(papers.sparkSession)
    counts = counts or RunCounts(papers.sparkSession)
    free = F.coalesce(F.col("in_store"), F.lit(False)) | (F.coalesce(F.col("has_free_full_text"), F.lit(False)) if "has_free_full_text" in papers.columns else F.lit(False))
    papers = papers.withColumn("has_full_text", free)
    more = [c for c in CARRIED if c in papers.columns]
    on_stage("search")
    queries = sub_queries(questions, s.sub_queries, planner, plan_prompt, validator, counts.failures)
    queries = materialize(counts.observed(queries, query_count=F.count(F.lit(1))), "queries")  # an observation ends with a job that reads all
    hits = search(papers, queries, s.page_size)
    once = E.first_wins(hits.join(papers.select("doc_id", "paper_id"), "doc_id").where("paper_id <> ''"), ["question_id", "paper_id"], "query_idx", "rank")
    found = E.candidate_order(once, "question_id", "query_idx", "rank")
    pair = F.concat_ws(":", "question_id", "doc_id")
    terms = questions.select("question_id", F.array_distinct(tokens(plain_terms(F.col("text")))).alias("terms"))
    found = materialize(found.select("question_id", "doc_id", "paper_id", "cand_pos").join(terms, "question_id").withColumn("pair", pair), "found")

    on_stage("excerpt")
    with_text = papers.where("has_full_text").select("doc_id") if s.full_text_enrichment else papers.limit(0).select("doc_id")
    asked = found.join(with_text, "doc_id").select("pair", "doc_id", "terms")
    excerpt = R.bm25_excerpts(paragraphs, asked, word_budget(s.excerpt_tokens)).where("excerpt <> ''")
    candidates = found.join(papers.select("doc_id", "title", "abstract", "has_full_text", "year", *more), "doc_id").join(excerpt, "pair", "left")
    candidates = candidates.withColumn("has_excerpt", F.col("excerpt").isNotNull())
    candidates = materialize(counts.observed(candidates, candidate_count=F.count(F.lit(1)), excerpt_count=F.count_if("has_excerpt")), "candidates")

    on_stage("judge")

    def judged(text: str, name: str, size: int) -> DataFrame:
        some = candidates.where(f"{text} <> ''")
        rows = E.sentence_rows(some.select("pair", F.col(text).alias("text")), "pair", split).join(found.select("pair", "terms", "question_id", "cand_pos"), "pair")
        cited = _cited_by_words(rows) if judge is None else _cited_by_model(rows, E.candidate_order(some.drop("cand_pos").join(found.select("pair", F.col("cand_pos").alias("at")), "pair"), "question_id", "at"), questions, judge, size, judge_prompt, counts.failures)
        cited = materialize(cited, f"{name}_cited")  # read for spans and for places
        kept = R.within_budget(cited.withColumn("text", F.col("sentence")), s.evidence_words, "pair", "judge_pos")
        spans = E.span_lists(E.truncated(E.spans(E.span_ids(kept, "pair"), "pair"), s.evidence_words, "pair"), "pair").withColumnRenamed("spans", f"{name}_spans")
        best = cited.groupBy("question_id", "pair").agg(F.min("first_by").alias("first_by"))
        placed = best.withColumn(f"{name}_order", F.row_number().over(Window.partitionBy("question_id").orderBy("first_by")).cast("long"))
        relevant = {"full": "ft_relevant_count", "abstract": "abstract_relevant_count"}[name]
        return materialize(counts.observed(placed.select("pair", f"{name}_order").join(spans, "pair", "left"), **{relevant: F.count(F.lit(1))}), name)

    full, brief = judged("excerpt", "full", s.full_text_batch), judged("abstract", "abstract", s.abstract_batch)
    on_stage("merge")
    weighed = materialize(candidates.join(full, "pair", "left").join(brief, "pair", "left"), "weighed")
    release(full, brief, candidates, found)
    merged = E.or_all_candidates(E.two_pools(weighed, "question_id", s.max_full_text, s.max_abstract_only), weighed, "question_id")
    final = counts.observed(E.final_order(merged, "question_id", s.top_k), final_count=F.count(F.lit(1)))
    evidence = snippets(F.col("full_spans"), F.col("abstract_spans"), F.col("excerpt"), F.col("abstract"))
    return final.select("question_id", "final_pos", "doc_id", "paper_id", "title", "year", "pool", "has_excerpt", "has_full_text", evidence.alias("evidence"), *more)
