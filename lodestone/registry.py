"""The registered queries of the library and the SQL that gives the same rows.

Papers, questions, queries and article XML are derived from the documents and benchmark tables by rule, so that all
of them grow with the input.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import records as X
from lodestone.functions import text as T
from lodestone.operators import evidence as E
from lodestone.operators import ranking as R
from lodestone.operators import postings as P
from lodestone.operators import search as S
from lodestone.operators import segmentation as G
from lodestone.operators import validation as V
from lodestone.operators.parsing import parse_column, with_rows
from lodestone.operators.percolate import percolate
from lodestone.operators.querytext import condition
from lodestone.plans import report
from lodestone.plans.expansion import expanded_terms, tiered_queries, within_years
from lodestone.plans.judging import payloads
from lodestone.plans.evidence import passages, plan_queries, search
from lodestone.scratch import materialize, scratch_dir
from lodestone.sources import corpus as C
from lodestone.sources.chat import assistant_text
from lodestone.sources.remote import remote_records
from lodestone.sources.articles import article_paragraphs, store_full_texts, with_full_text, with_sections

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return C.spread(spark.read.parquet(f"{sf}/documents.parquet"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("question_id"), "text")


# The same views in SQL.
STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
TOKENS = r"list_filter(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda t: t NOT IN (" + STOP + "))"
WORDS = r"list_filter(string_split_regex(coalesce({}, ''), '\s+'), lambda w: w <> '')"
N_WORDS = "CAST(len(" + WORDS + ") AS BIGINT)"
PAPERS = """papers AS (
  SELECT *, CASE WHEN pmid <> '' THEN pmid WHEN doi <> '' THEN doi ELSE title END AS paper_id FROM (
    SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS pmid,
           CASE WHEN doc_id % 5 = 0 AND doc_id % 10 <> 0 THEN '10.1000/' || doc_id ELSE '' END AS doi,
           coalesce(string_split(coalesce(text, ''), chr(10))[1], '') AS title, coalesce(string_split(coalesce(text, ''), chr(10))[2], '') AS abstract,
           CAST(2000 + doc_id % 25 AS VARCHAR) AS year, coalesce(n_chars > 2000, false) AS in_store, source, lang, text FROM documents))"""
PARAGRAPHS = """lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS para_idx FROM documents),
paragraphs AS (SELECT doc_id, text, min(para_idx) AS para_idx FROM lines WHERE trim(text) <> '' GROUP BY doc_id, text)"""
RANKED = (
    PARAGRAPHS
    + f""",
asked AS (SELECT doc_id, list_distinct({TOKENS.format("string_split(coalesce(text, ''), chr(10))[1]")}) AS terms FROM documents),
counted AS (SELECT p.*, {TOKENS.format("p.text")} AS t, count(*) OVER (PARTITION BY doc_id) AS n, len({TOKENS.format("p.text")}) AS dl, terms FROM paragraphs p JOIN asked USING (doc_id)),
meaned AS (SELECT *, avg(CAST(dl AS DOUBLE)) OVER (PARTITION BY doc_id) AS mean FROM counted),
hits AS (SELECT doc_id, para_idx, n, dl, mean, unnest(list_filter(t, lambda x: list_contains(terms, x))) AS term FROM meaned),
tf AS (SELECT doc_id, para_idx, n, dl, mean, term, count(*) AS tf FROM hits GROUP BY ALL),
dfs AS (SELECT *, count(*) OVER (PARTITION BY doc_id, term) AS df FROM tf),
scored AS (SELECT doc_id, para_idx, sum(ln(CAST(1 AS DOUBLE) + (CAST(n AS DOUBLE) - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * tf / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / mean))) AS score FROM dfs GROUP BY doc_id, para_idx),
ranked AS (SELECT doc_id, para_idx, text, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY round(coalesce(score, 0), 9) DESC, para_idx) AS rank FROM paragraphs LEFT JOIN scored USING (doc_id, para_idx)),
positive AS (
  SELECT doc_id, para_idx, text, score, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN best > 0 THEN rank ELSE para_idx END) AS rank
  FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best FROM ranked) WHERE score > 0 OR best <= 0)"""
)
SENTENCES = r"""sentence_lists AS (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda s: trim(regexp_replace(s, '^[ \n\t\r]+|[ \n\t\r]+$', '', 'g'))), lambda s: s <> '') AS found, text
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
sentences AS (SELECT doc_id, unnest(s) AS sentence, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sent_idx FROM (SELECT doc_id, CASE WHEN len(found) = 0 AND trim(text) <> '' THEN [trim(text)] ELSE found END AS s FROM sentence_lists)),
sids AS (SELECT *, doc_id || '_' || CASE WHEN sent_idx < 26 THEN chr(65 + sent_idx) ELSE 'S' || sent_idx END AS sid FROM sentences)"""
CITED = (
    SENTENCES
    + f""",
judge AS (SELECT s.*, len(list_intersect(list_distinct({TOKENS.format("s.sentence")}), list_distinct({TOKENS.format("string_split(coalesce(d.text, ''), chr(10))[1]")}))) AS hits FROM sids s JOIN documents d USING (doc_id)),
cited AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, sent_idx) AS judge_pos, {N_WORDS.format("sentence")} AS words FROM judge WHERE hits >= 1),
kept AS (SELECT * FROM (SELECT *, CAST(coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY judge_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS words_before FROM cited) WHERE words_before < 60),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS span
  FROM (SELECT *, CASE WHEN sent_idx = lag(sent_idx) OVER (PARTITION BY doc_id ORDER BY sent_idx) + 1 THEN 0 ELSE 1 END AS opens FROM kept)),
span_texts AS (SELECT doc_id, CAST(span AS BIGINT) AS span, string_agg(sentence, ' ' ORDER BY sent_idx) AS text FROM numbered GROUP BY doc_id, span)"""
)


def _first_line_terms() -> Column:
    return F.array_distinct(T.tokens(F.get(F.split(F.coalesce("text", F.lit("")), "\n", -1), F.lit(0))))


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's paragraphs, ranked for its first line."""
    asked = docs(spark, sf).select("doc_id", _first_line_terms().alias("terms"))
    return R.bm25_within(C.paragraphs(docs(spark, sf)), asked)


def _cited(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's sentences that share a term with its first line, in the judge's order."""
    d = docs(spark, sf)
    terms = d.select("doc_id", _first_line_terms().alias("terms"))
    cited = E.lexical_judge(E.sentence_rows(d).join(terms, "doc_id"), F.col("terms")).drop("terms")
    return cited.withColumn("judge_pos", F.row_number().over(R.Window.partitionBy("doc_id").orderBy(F.desc("hits"), "sent_idx")))


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    return R.within_budget(_cited(spark, sf), 60, "doc_id", "judge_pos", text="sentence")


def _score(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 5))


@query(f"SELECT doc_id, {N_WORDS.format('text')} AS n_words FROM documents")
def word_counts(spark, sf):
    return docs(spark, sf).select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@query(f"SELECT doc_id, CAST(len({TOKENS.format('text')}) AS BIGINT) AS n_tokens FROM documents")
def token_counts(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


FIELDED = """'TITLE:"' || coalesce(string_split(text, ' ')[1], '') || '" AND (AUTH:' || coalesce(string_split(text, ' ')[2], '') || ' OR NOT ' || source || ')'"""


@query(
    rf"""WITH q AS (SELECT doc_id, {FIELDED} AS query FROM documents),
b AS (SELECT *, array_to_string(list_filter({WORDS.format("translate(regexp_replace(query, '\\b[A-Z_]+:', '', 'g'), '\"()', '   ')")}, lambda w: w NOT IN ('AND', 'OR', 'NOT')), ' ') AS bare FROM q)
SELECT doc_id, CASE WHEN bare = '' THEN query ELSE bare END AS bare FROM b"""
)
def strip_operators(spark, sf):
    part = lambda i: F.coalesce(F.get(F.split("text", " ", -1), F.lit(i)), F.lit(""))
    q = F.concat(F.lit('TITLE:"'), part(0), F.lit('" AND (AUTH:'), part(1), F.lit(" OR NOT "), F.col("source"), F.lit(")"))
    return docs(spark, sf).select("doc_id", T.plain_terms(q).alias("bare"))


BM25 = f"""counted AS (SELECT doc_id, {TOKENS.format("text")} AS terms FROM documents),
whole AS (SELECT count(*) AS n, avg(CAST(len(terms) AS DOUBLE)) AS mean FROM counted),
tf AS (SELECT doc_id, len(terms) AS dl, term, count(*) AS tf FROM (SELECT doc_id, terms, unnest(terms) AS term FROM counted) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weighed AS (SELECT doc_id, term, ln(CAST(1 AS DOUBLE) + (CAST(n AS DOUBLE) - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * tf / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / mean)) AS weight FROM tf JOIN dfs USING (term), whole)"""


@query(
    f"""WITH {BM25}, asked AS (SELECT item_id AS question_id, unnest(list_distinct({TOKENS.format("text")})) AS term FROM benchmark),
scored AS (SELECT question_id, doc_id, sum(weight) AS score FROM weighed JOIN asked USING (term) GROUP BY ALL)
SELECT question_id, doc_id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= 10"""
)
def bm25_corpus_topk(spark, sf):
    return _score(R.bm25_top(docs(spark, sf), questions(spark, sf), 10))


@query(_oracles["bm25_corpus_topk"])
def index_topk(spark, sf):
    """The same rows from a written index."""
    return _score(P.ranked(P.build_index(docs(spark, sf)), questions(spark, sf), 10).hits)


@query(
    rf"""WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+'), '  ') || ' ' AS norm FROM documents),
a AS (SELECT item_id AS phrase_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')[1:item_id % 3 + 2] AS w FROM benchmark),
p AS (SELECT phrase_id, ' ' || array_to_string(w, '  ') || ' ' AS p FROM a WHERE len(w) > 0),
t AS (SELECT phrase_id, doc_id, CAST((length(norm) - length(replace(norm, p, ''))) // length(p) AS BIGINT) AS n_places FROM d, p WHERE contains(norm, p))
SELECT * FROM t"""
)
def index_phrases(spark, sf):
    """Documents that hold the first words of each question next to each other."""
    asked = questions(spark, sf).select(F.col("question_id").alias("phrase_id"), F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.lit(1), (F.col("question_id") % 3 + 2).cast("int")), "-").alias("text"))
    return P.phrases(P.build_index(docs(spark, sf)), asked)


@query(f"WITH {RANKED} SELECT doc_id, para_idx, round(score, 5) AS score, rank FROM ranked")
def bm25_paragraph_rank(spark, sf):
    return _score(_ranked(spark, sf)).select("doc_id", "para_idx", "score", "rank")


@query(f"WITH {RANKED} SELECT doc_id, para_idx, rank FROM positive")
def bm25_positive_or_leading(spark, sf):
    return R.positive_or_all(_ranked(spark, sf)).select("doc_id", "para_idx", "rank")


BUDGETED = (
    RANKED
    + f""",
budgeted AS (SELECT * FROM (SELECT *, {N_WORDS.format("text")} AS words, CAST(coalesce(sum({N_WORDS.format("text")}) OVER (PARTITION BY doc_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS words_before FROM positive) WHERE words_before < 200)"""
)


@query(f"WITH {BUDGETED} SELECT doc_id, para_idx, rank, words, words_before FROM budgeted")
def excerpt_word_budget(spark, sf):
    return R.within_budget(R.positive_or_all(_ranked(spark, sf)), 200, "doc_id", "rank").select("doc_id", "para_idx", "rank", "words", "words_before")


@query(f"WITH {BUDGETED} SELECT doc_id, string_agg(text, ' ' ORDER BY para_idx) AS excerpt FROM budgeted GROUP BY doc_id")
def excerpt_text(spark, sf):
    return R.excerpts(R.within_budget(R.positive_or_all(_ranked(spark, sf)), 200, "doc_id", "rank"))


@query(f"WITH {SENTENCES} SELECT doc_id, sent_idx, sentence, sid FROM sids")
def sentence_ids(spark, sf):
    return E.sentence_rows(docs(spark, sf))


# Every seventh source stands as an abbreviation in the texts that are split.
DOTTED = """texts AS (SELECT doc_id, replace(coalesce(text, ''), ' de ', ' ' || CASE WHEN doc_id % 7 < 5 THEN 'cf. ' ELSE 'e.g. 3.5 ' END) AS text FROM documents)"""
LEARNED = (
    DOTTED
    + r""",
pieces AS (SELECT unnest(regexp_extract_all(lower(text), '\S+')) AS piece FROM texts),
cores AS (SELECT regexp_replace(regexp_replace(piece, '^[\"''“‘«(\[{]+', ''), '[\"''”’»)\]},;:]+$', '') AS core FROM pieces),
words AS (SELECT regexp_replace(core, '\.$', '') AS word, ends_with(core, '.') AS dotted FROM cores),
counts AS (SELECT word, CAST(count(*) AS DOUBLE) AS a, CAST(count(*) FILTER (dotted) AS DOUBLE) AS ab FROM words WHERE regexp_full_match(word, '\p{L}+(\.\p{L}+)*') GROUP BY word),
whole AS (SELECT sum(a) AS n, sum(ab) AS b FROM counts),
measured AS (SELECT *, CAST(length(word) - length(replace(word, '.', '')) AS DOUBLE) AS dots, CAST(length(replace(word, '.', '')) AS DOUBLE) AS letters, b / n AS p FROM counts, whole WHERE ab > 0),
learned AS (SELECT word, 2 * (ab * ln(CAST(0.99 AS DOUBLE)) + (a - ab) * ln(1 - CAST(0.99 AS DOUBLE)) - ab * ln(p) - (a - ab) * ln(1 - p)) * exp(-letters) * (dots + 1) * pow(letters, -(a - ab)) AS score FROM measured),
known AS (SELECT word, score FROM learned WHERE score >= 0.3)"""
)


def _dotted(spark, sf):
    d = docs(spark, sf)
    return d.select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit(" de "), F.concat(F.lit(" "), F.when(F.col("doc_id") % 7 < 5, "cf. ").otherwise("e.g. 3.5 "))).alias("text"))


@query(f"WITH {LEARNED} SELECT word, round(score, 4) AS score FROM known")
def learned_abbreviations(spark, sf):
    return G.abbreviations(_dotted(spark, sf)).withColumn("score", F.round("score", 4))


@query(
    f"WITH {LEARNED}"
    + r""", cut AS (SELECT doc_id, regexp_extract_all(text, '\S+\s*') AS t FROM texts),
each AS (SELECT doc_id, unnest(t) AS piece, generate_subscripts(t, 1) AS k, len(t) AS n FROM cut),
beside AS (SELECT *, rtrim(piece, chr(32) || chr(10) || chr(13) || chr(9)) AS core, lead(piece) OVER (PARTITION BY doc_id ORDER BY k) AS after FROM each),
marked AS (SELECT *, regexp_matches(core, '[.!?…]+[\"''”’»)\]}]*$') AS ends, regexp_matches(core, '(^|[^.])\.[\"''”’»)\]}]*$') AS dotted,
  lower(regexp_replace(ltrim(core, '\"''“‘«([{'), '\.[\"''”’»)\]}]*$', '')) AS word, substr(ltrim(after, '\"''“‘«([{'), 1, 1) AS next FROM beside),
judged AS (SELECT m.*, k = n OR contains(substr(piece, length(core) + 1), chr(10)) OR (ends AND NOT (dotted AND (regexp_matches(next, '\p{Ll}') OR known.word IS NOT NULL OR regexp_full_match(m.word, '\p{L}')))) AS last FROM marked m LEFT JOIN known USING (word)),
numbered AS (SELECT *, coalesce(sum(CAST(last AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent_idx FROM judged)
SELECT doc_id, CAST(sent_idx AS INTEGER) AS sent_idx, rtrim(string_agg(piece, '' ORDER BY k), chr(32) || chr(10) || chr(13) || chr(9)) AS sentence FROM numbered GROUP BY doc_id, sent_idx"""
)
def learned_sentences(spark, sf):
    """Sentences of documents into which abbreviations and decimals are put, by what is learned from them."""
    texts = _dotted(spark, sf)
    return E.sentence_rows(texts, split=G.learned(texts)).drop("sid")


@query(f"WITH {CITED} SELECT doc_id, sid, judge_pos, words, words_before FROM kept")
def evidence_budget(spark, sf):
    return _kept(spark, sf).select("doc_id", "sid", "judge_pos", "words", "words_before")


@query(f"WITH {CITED} SELECT doc_id, span, text FROM span_texts")
def contiguous_spans(spark, sf):
    return E.spans(E.span_ids(_kept(spark, sf)))


@query(
    f"""WITH {CITED}, s AS (SELECT *, {N_WORDS.format("text")} AS words FROM span_texts),
l AS (SELECT *, CAST(60 - coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_over FROM s)
SELECT doc_id, string_agg(CASE WHEN words <= left_over THEN text ELSE array_to_string({WORDS.format("text")}[1:left_over], ' ') END, chr(10) ORDER BY span) AS spans FROM l WHERE left_over > 0 GROUP BY doc_id"""
)
def span_truncate(spark, sf):
    return E.span_lists(E.truncated(E.spans(E.span_ids(_kept(spark, sf))), 60)).select("doc_id", F.array_join("spans", "\n").alias("spans"))


@query(f"WITH {CITED} SELECT doc_id, max(hits) AS best, count(*) AS n_cited, min(sid) FILTER (judge_pos = 1) AS first_sid FROM cited GROUP BY doc_id")
def paper_relevance(spark, sf):
    """How the judge places papers: by the best of their cited sentences."""
    return _cited(spark, sf).groupBy("doc_id").agg(F.max("hits").cast("long").alias("best"), F.count("*").alias("n_cited"), F.min_by("sid", "judge_pos").alias("first_sid"))


@query(f"WITH {PAPERS} SELECT paper_id, min(doc_id) AS doc_id, count(*) AS copies FROM papers WHERE paper_id <> '' GROUP BY paper_id")
def dedup_coalesced_key(spark, sf):
    p = C.papers(docs(spark, sf)).where("paper_id <> ''")
    copies = p.groupBy("paper_id").agg(F.count("*").alias("copies"))
    return E.first_wins(p.select("paper_id", "doc_id"), ["paper_id"], "doc_id").join(copies, "paper_id")


@query(
    "WITH t AS (SELECT md5(coalesce(text, '')) AS digest, source AS query_idx, doc_id AS rank FROM documents) "
    "SELECT digest, query_idx, rank FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY query_idx, rank) AS n FROM t) WHERE n = 1"
)
def dedup_first_wins(spark, sf):
    hits = docs(spark, sf).select(F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.col("source").alias("query_idx"), F.col("doc_id").alias("rank"))
    return E.first_wins(hits, ["digest"], "query_idx", "rank")


PLANNED = f"""terms AS (SELECT item_id AS question_id, text, {TOKENS.format("text")} AS t FROM benchmark),
firsts AS (SELECT question_id, text, list_filter(t, lambda x, i: list_position(t, x) = i) AS u FROM terms),
halves AS (SELECT question_id, text, u, CAST(greatest(1, ceil(len(u) / 2)) AS INTEGER) AS h FROM firsts),
bare AS (SELECT *, array_to_string(list_filter({WORDS.format("translate(regexp_replace(text, '\\b[A-Z_]+:', '', 'g'), '\"()', '   ')")}, lambda w: w NOT IN ('AND', 'OR', 'NOT')), ' ') AS b FROM halves),
made AS (SELECT question_id, unnest([CASE WHEN b = '' THEN text ELSE b END, array_to_string(u[1:h], ' '), array_to_string(u[h + 1:], ' ')]) AS text, unnest([0, 1, 2]) AS query_idx FROM bare),
planned AS (SELECT question_id, text, min(query_idx) AS query_idx FROM made WHERE trim(text) <> '' GROUP BY question_id, text),
{BM25}, sub AS (SELECT question_id, query_idx, unnest(list_distinct({TOKENS.format("text")})) AS term FROM planned),
scored AS (SELECT question_id, query_idx, doc_id, sum(weight) AS score FROM weighed JOIN sub USING (term) GROUP BY ALL),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, query_idx ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= 50)"""


@query(f"WITH {PLANNED} SELECT question_id, query_idx, text FROM planned")
def planned_queries(spark, sf):
    return plan_queries(questions(spark, sf), 7)


@query(f"WITH {PLANNED} SELECT question_id, query_idx, rank, doc_id FROM hits")
def per_subquery_cap(spark, sf):
    """The union of all sub-queries' hits, at most 50 of each."""
    return search(docs(spark, sf), plan_queries(questions(spark, sf), 7), 50).drop("score")


EXPANDED = f"""{BM25}, asked AS (SELECT item_id AS question_id, text, {TOKENS.format("text")} AS t FROM benchmark),
sub AS (SELECT question_id, unnest(list_distinct(t)) AS term FROM asked),
scored AS (SELECT question_id, doc_id, sum(weight) AS score FROM weighed JOIN sub USING (term) GROUP BY ALL),
best AS (SELECT question_id, doc_id, score / sum(score) OVER (PARTITION BY question_id) AS share FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= 10),
learned AS (SELECT question_id, term, sum(share * tf / CAST(dl AS DOUBLE)) * CAST(0.5 AS DOUBLE) AS weight FROM best JOIN tf USING (doc_id) GROUP BY ALL),
own AS (SELECT question_id, term, CAST(0.5 AS DOUBLE) * count(*) / CAST(n AS DOUBLE) AS weight FROM (SELECT question_id, len(t) AS n, unnest(t) AS term FROM asked) GROUP BY question_id, term, n),
both_ AS (SELECT question_id, term, sum(weight) AS weight FROM (SELECT * FROM learned UNION ALL SELECT * FROM own) GROUP BY ALL),
expanded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(weight, 9) DESC, term) AS place FROM both_) WHERE place <= 8)"""


@query(f"WITH {EXPANDED} SELECT question_id, CAST(place AS INTEGER) AS place, term, round(weight, 6) AS weight FROM expanded")
def expanded_query_terms(spark, sf):
    """The strongest terms of each question, its own and those of its first results."""
    return expanded_terms(docs(spark, sf), questions(spark, sf)).withColumn("weight", F.round("weight", 6))


@query(
    f"""WITH {EXPANDED}, l AS (SELECT question_id, text, list(term ORDER BY place) AS t FROM expanded JOIN asked USING (question_id) GROUP BY question_id, text),
m AS (SELECT question_id, [array_to_string(list_filter({WORDS.format("translate(regexp_replace(text, '\\b[A-Z_]+:', '', 'g'), '\"()', '   ')")}, lambda w: w NOT IN ('AND', 'OR', 'NOT')), ' '), array_to_string(t[1:2], ' '),
  array_to_string(list_transform(t[1:4], lambda x: 'TITLE_ABS:"' || x || '"'), ' OR '), array_to_string(list_transform(t[3:6], lambda x: 'TITLE_ABS:"' || x || '"'), ' OR ')]
  || list_transform([1, 2, 3], lambda k: t[k] || ' AND (TITLE_ABS:"' || t[k + 1] || '" OR TITLE_ABS:"' || t[k + 2] || '")') AS q FROM l),
e AS (SELECT question_id, unnest(q) AS text, generate_subscripts(q, 1) - 1 AS query_idx FROM m)
SELECT question_id, CAST(min(query_idx) AS INTEGER) AS query_idx, text FROM e WHERE trim(text) <> '' GROUP BY question_id, text"""
)
def expanded_queries(spark, sf):
    """Sub-queries in three tiers, by terms that are learned from first results."""
    return tiered_queries(docs(spark, sf), questions(spark, sf), 7)


#: What questions may say of years, in turn, and the years that this leaves of 2000 to 2024, this year being 2024.
YEARS_SAID = [("", 0, 9999), (" in the last five years", 2020, 2024), (" since 2010", 2010, 9999), (" between 2003 and 2006?", 2003, 2006), (" before 2002", 0, 2001), (" recent work", 2022, 2024), (", 2011-2013", 2011, 2013), (" in 2007.", 2007, 2007)]


@query(
    f"""WITH {PAPERS}, s AS (SELECT * FROM (VALUES {", ".join(f"({k}, {a}, {b})" for k, (_, a, b) in enumerate(YEARS_SAID))}) AS s(k, a, b))
SELECT item_id AS question_id, count(*) AS n, min(doc_id) AS first_id FROM benchmark JOIN s ON s.k = item_id % {len(YEARS_SAID)} JOIN papers ON doc_id % 40 = item_id % 40 AND CAST(year AS INTEGER) BETWEEN a AND b GROUP BY item_id"""
)
def constrained_judge(spark, sf):
    """Papers of questions that name years, relative or not: those outside go."""
    said = F.element_at(F.array(*(F.lit(t) for t, _, _ in YEARS_SAID)), (F.col("question_id") % len(YEARS_SAID) + 1).cast("int"))
    asked = questions(spark, sf).withColumn("text", F.concat(F.lit("What is known"), said))
    rows = C.papers(docs(spark, sf)).select("doc_id", "year", (F.col("doc_id") % 40).alias("k")).join(asked.select("question_id", (F.col("question_id") % 40).alias("k")), "k")
    return within_years(rows, asked, 2024).groupBy("question_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


CANDIDATES = (
    PLANNED
    + f""", {PAPERS},
keyed AS (SELECT question_id, query_idx, rank, doc_id, paper_id FROM hits JOIN papers USING (doc_id) WHERE paper_id <> ''),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, paper_id ORDER BY query_idx, rank, doc_id) AS n FROM keyed) WHERE n = 1),
found AS (SELECT question_id, doc_id, paper_id, query_idx, row_number() OVER (PARTITION BY question_id ORDER BY query_idx, rank) AS cand_pos FROM once)"""
)


def _candidates(spark, sf):
    papers = C.papers(docs(spark, sf))
    hits = search(papers, plan_queries(questions(spark, sf), 7), 50)
    keyed = hits.drop("score").join(papers.select("doc_id", "paper_id"), "doc_id").where("paper_id <> ''")
    once = E.first_wins(keyed, ["question_id", "paper_id"], "query_idx", "rank")
    return materialize(E.candidate_order(once, "question_id", "query_idx", "rank"), "candidates")  # several steps read them


@query(f"WITH {CANDIDATES} SELECT question_id, doc_id, paper_id, cand_pos FROM found")
def candidate_order(spark, sf):
    return _candidates(spark, sf).select("question_id", "doc_id", "paper_id", "cand_pos")


@query(f"WITH {CANDIDATES} SELECT question_id, doc_id, cand_pos, CAST((cand_pos - 1) // 10 AS BIGINT) AS batch FROM found")
def judge_batches(spark, sf):
    return E.batches(_candidates(spark, sf), 10).select("question_id", "doc_id", "cand_pos", "batch")


def _weighed(spark, sf):
    """Candidates with a stand-in for both judges: by ids and places."""
    c = _candidates(spark, sf).join(C.papers(docs(spark, sf)).select("doc_id", "in_store"), "doc_id")
    yes = F.col("question_id") % 5 != 0
    return c.select(
        "question_id", "doc_id", "cand_pos", F.col("in_store").alias("has_excerpt"),
        F.when(yes & F.col("in_store") & (F.col("doc_id") % 3 == 0), F.col("cand_pos").cast("long")).alias("full_order"),
        F.when(yes & (F.col("doc_id") % 4 == 0), 1000 - F.col("cand_pos").cast("long")).alias("abstract_order"),
    )


POOLS = (
    CANDIDATES
    + """,
weighed2 AS (SELECT question_id, doc_id, cand_pos, in_store AS has_excerpt,
  CASE WHEN question_id % 5 <> 0 AND in_store AND doc_id % 3 = 0 THEN cand_pos END AS full_order, CASE WHEN question_id % 5 <> 0 AND doc_id % 4 = 0 THEN 1000 - cand_pos END AS abstract_order FROM found JOIN papers USING (doc_id)),
pools AS (SELECT *, 0 AS pool, full_order AS pool_order FROM weighed2 WHERE full_order IS NOT NULL
  UNION ALL SELECT *, 1, abstract_order FROM weighed2 WHERE NOT has_excerpt AND full_order IS NULL AND abstract_order IS NOT NULL),
merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, pool ORDER BY pool_order, cand_pos) AS pool_rank FROM pools) WHERE pool_rank <= 20),
filled AS (SELECT question_id, doc_id, pool, pool_rank FROM merged UNION ALL SELECT question_id, doc_id, 2, cand_pos FROM weighed2 WHERE question_id NOT IN (SELECT question_id FROM merged)),
final AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pool, pool_rank) AS final_pos FROM filled)"""
)


@query(f"WITH {POOLS} SELECT question_id, doc_id, pool, pool_rank FROM merged")
def two_pool_merge(spark, sf):
    return E.two_pools(_weighed(spark, sf), "question_id", 20, 20).select("question_id", "doc_id", "pool", "pool_rank")


@query(f"WITH {POOLS} SELECT question_id, doc_id, pool, pool_rank FROM filled")
def fallback_all_candidates(spark, sf):
    w = _weighed(spark, sf)
    return E.or_all_candidates(E.two_pools(w, "question_id", 20, 20), w, "question_id").select("question_id", "doc_id", "pool", "pool_rank")


@query(f"WITH {POOLS} SELECT question_id, doc_id, final_pos FROM final WHERE final_pos <= 30")
def final_topk(spark, sf):
    w = _weighed(spark, sf)
    merged = E.or_all_candidates(E.two_pools(w, "question_id", 20, 20), w, "question_id")
    return E.final_order(merged, "question_id", 30).select("question_id", "doc_id", "final_pos")


@query(f"WITH {POOLS} SELECT question_id, (SELECT count(*) FROM found f WHERE f.question_id = g.question_id) AS candidate_count, count(*) FILTER (pool = 0) AS full_text_count, count(*) FILTER (pool = 1) AS abstract_count, count(*) AS final_count FROM (SELECT * FROM final WHERE final_pos <= 30) g GROUP BY question_id")
def pipeline_counters(spark, sf):
    w = _weighed(spark, sf)
    final = E.final_order(E.or_all_candidates(E.two_pools(w, "question_id", 20, 20), w, "question_id"), "question_id", 30)
    found = w.groupBy("question_id").agg(F.count("*").alias("candidate_count"))
    return final.groupBy("question_id").agg(F.count_if(F.col("pool") == 0).alias("full_text_count"), F.count_if(F.col("pool") == 1).alias("abstract_count"), F.count("*").alias("final_count")).join(found, "question_id")


W = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"


@query(f"SELECT doc_id FROM documents WHERE list_contains({W}, 'the') AND (list_contains({W}, 'license') OR list_contains({W}, 'thon')) AND NOT list_contains({W}, 'with')")
def boolean_search(spark, sf):
    return docs(spark, sf).where(S.term("the") & (S.term("license") | S.term("thon")) & ~S.term("with")).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({W}, ' ') || ' ', ' licensed under the ')")
def phrase_search(spark, sf):
    return docs(spark, sf).where(S.phrase("Licensed under the")).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE len(list_filter({W}, lambda w: regexp_full_match(w, 'lic.*ed') OR regexp_full_match(w, '.éa'))) > 0")
def wildcard_search(spark, sf):
    return docs(spark, sf).where(S.wildcard("lic*ed") | S.wildcard("?éa")).select("doc_id")


@query(f"WITH {PAPERS} SELECT doc_id, year FROM papers WHERE lang IN ('de', 'fr') AND CAST(year AS INTEGER) BETWEEN 2010 AND 2015 AND in_store AND list_contains(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+'), 'en')")
def field_search(spark, sf):
    return C.papers(docs(spark, sf)).where(S.one_of("lang", "DE", "FR") & S.years(2010, 2015) & S.flag("in_store", "Y") & S.term("en", "title")).select("doc_id", "year")


@query(f"WITH {PAPERS} SELECT year, count(*) AS n FROM papers WHERE CAST(year AS INTEGER) >= 2020 GROUP BY year")
def year_range_search(spark, sf):
    return C.papers(docs(spark, sf)).where(S.years(first=2020)).groupBy("year").agg(F.count("*").alias("n"))


#: Query texts and the same conditions in SQL, on searched papers.
TITLE_WORDS, ABSTRACT_WORDS = (rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')" for c in ("title", "abstract"))
TEXTS = [
    ('the (license OR "Licensed under") NOT with', f"list_contains({W}, 'the') AND (list_contains({W}, 'license') OR contains(' ' || array_to_string({W}, ' ') || ' ', ' licensed under ')) AND NOT list_contains({W}, 'with')"),
    ("TITLE:(en OR the) AND PUB_YEAR:[2010 TO 2015]", f"len(list_intersect({TITLE_WORDS}, ['en', 'the'])) > 0 AND CAST(year AS INTEGER) BETWEEN 2010 AND 2015"),
    ("CITED:[100 TO *] AND LANG:(DE OR fr) AND IN_EPMC:Y", "cited >= 100 AND lang IN ('de', 'fr') AND in_store"),
    ("FIRST_PDATE:[2005-03-01 TO 2009] lic*", f"first_pdate BETWEEN DATE '2005-03-01' AND DATE '2009-12-31' AND len(list_filter({W}, lambda w: starts_with(w, 'lic'))) > 0"),
    ('EXT_ID:7 OR DOI:"10.1000/15" OR INTRO:the AND NOT METHODS:"of the"', f"pmid = '7' OR doi = '10.1000/15' OR (list_contains({TITLE_WORDS}, 'the') AND NOT contains(' ' || array_to_string({ABSTRACT_WORDS}, ' ') || ' ', ' of the '))"),
    ("NOT (a OR the OR de OR la OR (der AND NOT FIRST_PDATE:2004))", f"NOT (len(list_intersect({W}, ['a', 'the', 'de', 'la'])) > 0 OR (list_contains({W}, 'der') AND NOT first_pdate BETWEEN DATE '2004-01-01' AND DATE '2004-12-31'))"),
]


@query(
    f"WITH {PAPERS}, s AS (SELECT *, doc_id % 300 AS cited, CAST(DATE '2000-01-01' + CAST(doc_id * 7 % 9000 AS INTEGER) AS DATE) AS first_pdate FROM papers) "
    + " UNION ALL ".join(f"SELECT {i} AS query_id, doc_id FROM s WHERE {sql}" for i, (_, sql) in enumerate(TEXTS))
)
def compiled_search(spark, sf):
    """Texts of queries, each compiled to a condition; all of them are asked in one scan."""
    papers = C.papers(docs(spark, sf)).withColumn("cited", F.col("doc_id") % 300).withColumn("first_pdate", F.expr("date_add(date'2000-01-01', cast(doc_id * 7 % 9000 as int))"))
    papers = papers.withColumn("sections", F.create_map(F.lit("intro"), "title", F.lit("methods"), "abstract"))
    asked = F.array(*(F.when(condition(text, papers.columns), i) for i, (text, _) in enumerate(TEXTS)))
    return papers.select(F.explode(F.array_compact(asked)).alias("query_id"), "doc_id")


FAULTS = [
    ("", None), ("AND ", "Unexpected token 'AND'"), ("(", "Unmatched parentheses in query"), ("( ) OR ", "Empty group '()' is not allowed"), ("x NOT NOT ", "Illegal NOT placement"),
    ("x OR AND ", "Operator 'OR' is missing a right-hand operand"), ("y] ", "Unexpected token ']'"), ("TITLE:(a (b OR c)) NOT ", None),
]
FAULT_LIST = ", ".join("NULL" if m is None else "'" + m.replace("'", "''") + "'" for _, m in FAULTS)


@query(f"SELECT doc_id AS query_id, [{FAULT_LIST}][CAST(doc_id % {len(FAULTS)} AS INTEGER) + 1] AS fault FROM documents")
def query_faults(spark, sf):
    """The first fault in the structure of queries that start as listed and go on with a document's source."""
    starts = F.element_at(F.array(*(F.lit(t) for t, _ in FAULTS)), (F.col("doc_id") % len(FAULTS) + 1).cast("int"))
    made = docs(spark, sf).select(F.col("doc_id").alias("query_id"), F.concat(starts, F.col("source"), F.lit(' AND "'), "lang", F.lit('"')).alias("query"))
    return made.select("query_id", F.get(parse_column(F.col("query"))["faults"], F.lit(0)).alias("fault"))


@query(
    rf"""WITH {PAPERS}, d AS (SELECT doc_id, {W} AS w, year, lang, in_store, {TITLE_WORDS} AS tw, ' ' || array_to_string({W}, ' ') || ' ' AS norm FROM papers),
c AS (SELECT doc_id AS query_id, doc_id % 4 = 3 AS other, w[3] AS a, w[4] AS b, w[7] AS c, w[2] AS d, w[10] AS e FROM d WHERE len(w) >= 10),
t AS (SELECT DISTINCT doc_id, unnest(w) AS word FROM d),
pairs AS (SELECT query_id, doc_id FROM c JOIN t ON t.word = c.a)
SELECT query_id, doc_id FROM pairs JOIN c USING (query_id) JOIN d USING (doc_id)
WHERE CASE WHEN other THEN contains(norm, ' ' || a || ' ' || b || ' ') OR (list_contains(w, a) AND lang = 'de' AND NOT in_store)
           ELSE list_contains(w, b) AND (list_contains(w, c) OR list_contains(tw, d)) AND NOT list_contains(w, e) AND CAST(year AS INTEGER) >= 2005 END"""
)
def stored_conditions(spark, sf):
    """A condition made of each document's words, and all papers that meet it."""
    w = lambda i: F.get("w", F.lit(i - 1))
    one = F.concat(w(3), F.lit(" "), w(4), F.lit(" ("), w(7), F.lit(" OR TITLE:"), w(2), F.lit(") NOT "), w(10), F.lit(" AND PUB_YEAR:[2005 TO *]"))
    other = F.concat(F.lit('"'), w(3), F.lit(" "), w(4), F.lit('" OR ('), w(3), F.lit(" AND LANG:de AND NOT IN_EPMC:Y)"), F.substring(w(10), 1, 0))
    d = docs(spark, sf)
    begin = F.regexp_extract(F.lower("text"), r"^(?:[^\p{L}\p{N}_]*+[\p{L}\p{N}_]++){0,10}+", 0)  # ten words are asked of each text
    words = d.select("doc_id", F.regexp_extract_all(begin, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("w")).where("size(w) = 10")
    conditions = words.select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 4 == 3, other).otherwise(one).alias("query"))
    return percolate(C.papers(d), conditions)


#: Query texts made of parts of documents: what they start with, their tokens, their trees and all faults of their structure.
MADE = ["", "AND ", "(", "( ) OR ", "x NOT NOT ", "x OR AND ", "y] ", "TITLE:(a (b OR c)) NOT ", "TITLE:((((((((a OR BOGUS:y))))))) ] ", "KW:(] OR (NOT )) AND ", 'AUTH : "a ""b"" c" PUB_YEAR:[1990 TO [2000 OR ']
MADE_FAULTS = [
    [], ["Unexpected token 'AND'", "Unexpected token '{0}'"], ["Unmatched parentheses in query"], ["Empty group '()' is not allowed"], ["Illegal NOT placement", "Unexpected token 'NOT'"], ["Operator 'OR' is missing a right-hand operand", "Unexpected token 'AND'"],
    ["Unexpected token ']'"], [], ["Unmatched parentheses in query"],
    ["Unexpected closing bracket", "Illegal NOT placement", "Grouped expression is empty"], ["Unmatched brackets in query"],
]


def _made_queries(spark, sf):
    """A start by id, then `source AND "lang"`."""
    starts = F.element_at(F.array(*map(F.lit, MADE)), (F.col("doc_id") % len(MADE) + 1).cast("int"))
    return docs(spark, sf).select(F.col("doc_id").alias("query_id"), F.concat(starts, F.col("source"), F.lit(' AND "'), "lang", F.lit('"')).alias("query"))


def _sql_list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


MADE_SQL = f"made AS (SELECT doc_id AS query_id, source, lang, {_sql_list(MADE)}[CAST(doc_id % {len(MADE)} AS INTEGER) + 1] || source || ' AND \"' || lang || '\"' AS query FROM documents)"


@query(
    rf"""WITH {MADE_SQL}, m AS (SELECT query_id, regexp_extract_all(query, '"(?:[^"]|"")*"?|''[^'']+''?|[()\[\]:]|[^\s()\[\]:"'']+') AS t FROM made)
SELECT query_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, unnest(t) AS text,
       CASE substr(unnest(t), 1, 1) WHEN '"' THEN 'QUOTED' WHEN '(' THEN 'LPAREN' WHEN ')' THEN 'RPAREN' WHEN '[' THEN 'LBRACKET' WHEN ']' THEN 'RBRACKET' WHEN ':' THEN 'COLON' ELSE CASE WHEN unnest(t) IN ('AND', 'OR', 'NOT') THEN unnest(t) ELSE 'WORD' END END AS kind FROM m"""
)
def query_tokens(spark, sf):
    return with_rows(_made_queries(spark, sf), "query_tokens").select("query_id", "pos", "text", "kind")


@query(f"WITH {MADE_SQL} SELECT query_id, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS pos, replace(unnest(f), '{{0}}', source) AS fault FROM (SELECT query_id, source, [{', '.join(map(_sql_list, MADE_FAULTS))}][CAST(query_id % {len(MADE)} AS INTEGER) + 1] AS f FROM made) WHERE len(f) > 0")
def query_all_faults(spark, sf):
    return with_rows(_made_queries(spark, sf), "query_faults").select("query_id", "pos", "fault")


@query(
    """WITH t AS (SELECT doc_id AS query_id, source AS s, lang AS l, n_chars % 7 AS n FROM documents),
r AS (SELECT query_id, [('term', 0, '', 'word', s), ('term', 0, 'TITLE', 'word', l), ('term', 0, 'KW', 'quoted', '"' || s || ' ' || l || '"'), ('not', 1, '', '', ''), ('or', 2, '', '', ''), ('and', 2, '', '', ''), ('term', 0, 'PUB_YEAR', 'range', '[' || n || ' TO *]'), ('or', 2, '', '', '')] AS x FROM t)
SELECT query_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, unnest(x)[1] AS op, unnest(x)[2] AS operands, unnest(x)[3] AS field, unnest(x)[4] AS kind, unnest(x)[5] AS text FROM r"""
)
def query_tree(spark, sf):
    """Trees of `source TITLE:(lang OR NOT KW:"source lang") OR PUB_YEAR:[n TO *]`, operands before operators."""
    made = F.concat("source", F.lit(" TITLE:("), "lang", F.lit(' OR NOT KW:"'), "source", F.lit(" "), "lang", F.lit('") OR PUB_YEAR:['), (F.col("n_chars") % 7).cast("string"), F.lit(" TO *]"))
    rows = docs(spark, sf).select(F.col("doc_id").alias("query_id"), made.alias("query"))
    return with_rows(rows, "query_tree").drop("query")


def _fielded(spark, sf):
    """Queries of documents: a language, a range of years, a flag and a license, some of them wrong."""
    d = F.col("doc_id")
    year = lambda k: (1990 + d * k % 40).cast("string")
    flag = F.element_at(F.array(*map(F.lit, ["Y", "n", "maybe", "?"])), (d % 4 + 1).cast("int"))
    code = F.element_at(F.array(*map(F.lit, ["cc by", "CC_BY-NC", "by-nc-sa", "gpl", "cc0"])), (d % 5 + 1).cast("int"))
    made = F.concat(F.lit("LANG:"), F.when(d % 3 == 0, "eng").otherwise(F.col("lang")), F.lit(" AND PUB_YEAR:["), year(1), F.lit(" TO "), F.when(d % 7 == 0, "*").otherwise(year(3)), F.lit("] AND HAS_PDF:"), flag, F.lit(' AND LICENSE:"'), code, F.lit('" AND '), F.when(d % 2 == 0, "WORDS:x").otherwise("TITLE:x"), F.when(d % 11 == 0, " AND EXT_ID:7").otherwise(""))
    return docs(spark, sf).select(F.col("doc_id").alias("query_id"), made.alias("query"))


FIELDED_CHECKS = """q AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 3 = 0 THEN 'eng' ELSE lang END AS l, CAST(1990 + doc_id % 40 AS VARCHAR) AS y1,
  CASE WHEN doc_id % 7 = 0 THEN '*' ELSE CAST(1990 + doc_id * 3 % 40 AS VARCHAR) END AS y2, ['Y', 'n', 'maybe', '?'][doc_id % 4 + 1] AS f, ['cc by', 'CC_BY-NC', 'by-nc-sa', 'gpl', 'cc0'][doc_id % 5 + 1] AS c FROM documents),
v AS (SELECT query_id, list_filter([
  CASE WHEN l <> 'eng' THEN 'Invalid value for LANG: ''' || l || '''' END,
  CASE WHEN y2 <> '*' AND y1 > y2 THEN 'Invalid range for PUB_YEAR: start ''' || y1 || ''' is after end ''' || y2 || '''' END,
  CASE WHEN f NOT IN ('Y', 'n') THEN 'Invalid value for HAS_PDF: ''' || f || ''' - must use Y or N' END,
  CASE WHEN c = 'gpl' THEN 'Invalid value for LICENSE: ''gpl''' END, CASE WHEN query_id % 2 = 0 THEN 'Invalid field tag ''WORDS''' END], lambda m: m IS NOT NULL) AS reasons,
  CASE WHEN query_id % 11 = 0 THEN ['EXT_ID is usually used together with SRC'] ELSE [] END AS warnings FROM q)"""


@query(f"WITH {FIELDED_CHECKS} SELECT query_id, array_to_string(reasons, '; ') AS reasons, array_to_string(warnings, '; ') AS warnings, len(reasons) = 0 AS valid FROM v")
def validate_queries(spark, sf):
    return V.validate(_fielded(spark, sf)).select("query_id", F.array_join("reasons", "; ").alias("reasons"), F.array_join("warnings", "; ").alias("warnings"), "valid")


@query(f"WITH {FIELDED_CHECKS} SELECT CASE WHEN bool_and(len(reasons) = 0) THEN 'pass' ELSE 'fail' END AS overall_status, count(*) AS total, count(*) FILTER (len(reasons) = 0) AS passed, count(*) FILTER (len(reasons) > 0) AS failed FROM v")
def validate_batch_summary(spark, sf):
    return V.summary(V.validate(_fielded(spark, sf)))


def _one(at: int, *values: str) -> str:
    """One of five values by a character of the digest, as SQL."""
    return f"CASE {' '.join(f"WHEN substr(h, {at}, 1) < '{k}' THEN '{v}'" for k, v in zip('2468', values))} ELSE '{values[-1]}' END"


def _bad(field: str, shown: str = "v") -> str:
    return f"'Invalid value for {field}: ''' || {shown} || ''''"


def _shape(field: str) -> str:
    return f"'Invalid {field} format: ''' || v || ''''"


def _unlike(pattern: str, field: str) -> str:
    return f"CASE WHEN NOT regexp_full_match(v, '{pattern}') THEN {_shape(field)} END"


def _not_in(values, shown: str, message: str) -> str:
    return f"CASE WHEN {shown} NOT IN ({', '.join(f"'{v}'" for v in values)}) THEN {message} END"


#: Rules for clauses. Each has a field (None: the value is the whole query), a value as SQL over h, the digest of a document's text with a quarter of its letters left, and w, a word
#: with its first one; and what is wrong with the value v as SQL, null if nothing is.
RULES = {
    "flag": ("HAS_PDF", _one(1, "Y", "n", "y", "no", "w"), _not_in("YN", "upper(v)", _bad("HAS_PDF") + " || ' - must use Y or N'")),
    "source": ("SRC", _one(2, "med", "PMC", "PPR", "XYZ", "ME"), _not_in(V.SOURCES, "upper(v)", _bad("SRC", "upper(v)"))),
    "accession": ("ACCESSION_TYPE", _one(3, "PDB", "uniprot", "pdx", "doi", "geo1"), _not_in(V.ACCESSION_TYPES, "lower(v)", _bad("ACCESSION_TYPE", "lower(v)"))),
    "annotation": ("ANNOTATION_TYPE", _one(4, "Gene", "gene", "Kit", "Chemicals", "LS"), _not_in(V.ANNOTATION_TYPES, "v", _bad("ANNOTATION_TYPE"))),
    "author id type": ("AUTHORID_TYPE", _one(5, "orcid", "ORCID", "isni", "Orcid", "o"), _not_in(["ORCID"], "upper(v)", _bad("AUTHORID_TYPE", "upper(v)"))),
    "role": ("AUTHOR_ROLES", _one(6, "software", "Validation", "writer", "RESOURCES", "editing"), _not_in([r.lower() for r in V.AUTHOR_ROLES], "lower(v)", _bad("AUTHOR_ROLES"))),
    "language": ("LANG", _one(7, "eng", "ger", "German", "FRENCH", "de"), _not_in([x.lower() for x in [*V.LANGUAGES, *V.LANGUAGE_CODES]], "lower(v)", _bad("LANG"))),
    "license": ("LICENSE", _one(8, "cc-by", "CC_BY__NC", "by-nc-sa", "cc0", "gpl"), _not_in([*V.LICENSES, "BY-NC-SA"], "regexp_replace(upper(v), '[-_]+', '-', 'g')", _bad("LICENSE"))),
    "author id": ("AUTHORID", "substr(h, 1, 4) || '-' || substr(h, 5, 4) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 3) || " + _one(16, "X", "7", "x", "0", "1"), _unlike("[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]", "AUTHORID")),
    "cited": ("CITES", "substr(h, 1, 8) || " + _one(9, "_med", "_PMC", "_x", "-MED", "_AGR"), f"CASE WHEN NOT regexp_full_match(v, '[A-Za-z0-9.-]+_[A-Za-z]+') THEN 'Invalid CITES format: ''' || v || ''' - expected identifier_source' ELSE {_not_in(V.SOURCES, "upper(split_part(v, '_', 2))", "'Invalid source suffix in CITES: ''' || v || ''''")} END"),
    "store id": ("PMCID", _one(1, "PMC", "pmc", "", "PMC", "PM") + " || substr(h, 2, 6)", _unlike("(?i)PMC[0-9]+", "PMCID")),
    "serial": ("ISSN", "substr(h, 1, 4) || '-' || substr(h, 5, 3) || " + _one(8, "X", "x", "1", "y", "0"), _unlike("(?i)[0-9]{4}-[0-9]{3}[0-9X]", "ISSN")),
    "book number": ("ISBN", _one(1, "978-", "978", "", "9", "97-8") + " || substr(h, 2, 10)", f"CASE WHEN NOT regexp_full_match(replace(v, '-', ''), '[0-9]{{9}}[0-9Xx]|[0-9]{{13}}') THEN {_shape('ISBN')} END"),
    "digital id": ("DOI", _one(1, "10.", "11.", "10.", "doi", "10.") + " || substr(h, 2, 6) || '/' || w", _unlike(r"10\.[0-9]{4,9}/[^ ]+", "DOI")),
    "book": ("BOOK_ID", _one(1, "NBK", "nbk", "NB", "", "NBK") + " || substr(h, 2, 6)", _unlike("(?i)NBK[0-9]+", "BOOK_ID")),
    "manuscript": ("AUTH_MAN_ID", "w || substr(h, 2, 1)", _unlike("[A-Za-z]{2,}[A-Za-z0-9._-]*[0-9]+[A-Za-z0-9._-]*", "AUTH_MAN_ID")),
    "several": ("DOI", "'10.1000/' || w || ',' || substr(h, 1, 2)", "'Multiple comma-separated values are not allowed for field ''DOI'''"),
    "wild id": ("BOOK_ID", "'NBK' || substr(h, 1, 2) || " + _one(3, "", "*", "", "?", ""), f"CASE WHEN regexp_matches(v, '[*?]') THEN {_shape('BOOK_ID')} || '; Wildcards are not allowed for field ''BOOK_ID''' WHEN NOT regexp_full_match(v, 'NBK[0-9]+') THEN {_shape('BOOK_ID')} END"),
    "wild date": ("P_PDATE", "'19' || substr(h, 1, 1) || " + _one(2, "*", "1", "?", "7", "*"), f"CASE WHEN NOT regexp_full_match(v, '[0-9]{{4}}') THEN {_bad('P_PDATE')} || ' - expected YYYY or YYYY-MM-DD' || CASE WHEN contains(v, '?') THEN '; Question-mark wildcards are not allowed for field ''P_PDATE''' WHEN contains(v, '*') THEN '; Wildcards are only allowed in date ranges for field ''P_PDATE''' ELSE '' END END"),
    "wild alone": ("MESH", _one(1, "*", "a*", "**", "x", "?"), "CASE WHEN regexp_full_match(v, '[*?]+') THEN 'Wildcard-only presence checks are not allowed for field ''MESH'' - use ANNOTATION_TYPE or HAS_TM when you mean annotation presence' END"),
    "tag": (None, "CASE WHEN substr(h, 1, 1) < '5' THEN 'Methods' ELSE w END || ':x'", _not_in(V.FIELDS, "upper(split_part(v, ':', 1))", "'Invalid field tag ''' || split_part(v, ':', 1) || ''''")),
    "spacing": (None, "'KW' || " + _one(1, "", " ", "", " ", "") + " || ':' || " + _one(2, "", " ", "", "", " ") + " || w", "nullif(concat_ws('; ', CASE WHEN contains(v, ' :') THEN 'Field tag ''KW'' has invalid spacing before colon' END, CASE WHEN contains(v, ': ') THEN 'Field tag ''KW'' has invalid spacing after colon' END), '')"),
    "several words": ("TITLE", "w || " + _one(1, "", " x", "", "_x", " y"), "CASE WHEN contains(v, ' ') THEN 'Invalid syntax: TITLE:' || v || ' - multi-word field values must use quotes or parentheses' END"),
    "wild in quotes": (None, "'\"' || w || " + _one(1, "", "*", "", "?", "") + " || '\"'", "CASE WHEN regexp_matches(v, '[*?]') THEN 'Wildcard not allowed in quotes: ' || v END"),
    "open quotes": (None, "w || " + _one(1, "", " \"", "", " \"", "") + " || w", "CASE WHEN contains(v, '\"') THEN 'Unmatched double quotes in query' END"),
    "blank": (None, _one(1, "", " ", "x", "  ", "y"), "CASE WHEN trim(v) = '' THEN 'Query is empty or None' END"),
    "grant": ("GRANT_ID", "w || " + _one(1, "", " AND GRANT_AGENCY:x", "", " AND ISSUE:1", " OR GRANT_AGENCY:y"), "NULL"),
    "issue": ("ISSUE", "w || " + _one(1, "", " AND JOURNAL:x", " AND JOURNAL:x AND VOLUME:2", " AND EXT_ID:1 AND SRC:med", " AND INVESTIGATOR:x"), "NULL"),
}
RULE_VALUES = ["translate(md5(coalesce(text, '')), 'abcde', '01234') AS h", "'t' || regexp_extract(coalesce(text, ''), '[A-Za-z]+', 0) AS w"]
HINTS_SQL = ", ".join(
    f"CASE WHEN contains(query, '{field}:') AND NOT ({' AND '.join(f"contains(query, '{o}:')" for o in others)}) THEN '{field} is usually used together with {' and '.join(others)}' END"
    for field, others in [("GRANT_ID", ["GRANT_AGENCY"]), ("EXT_ID", ["SRC"]), ("INVESTIGATOR", ["AUTH_COLLECTIVE_LIST"]), ("ISSUE", ["JOURNAL", "VOLUME"])]
)
RULES_SQL = " UNION ALL ".join(f"SELECT doc_id, '{rule}' AS rule, {v} AS v, {f"'{field}:' || " if field else ''}{v} AS query FROM d" for rule, (field, v, _) in RULES.items())


@query(
    f"""WITH d AS (SELECT doc_id, {", ".join(RULE_VALUES)} FROM documents), q AS ({RULES_SQL}),
c AS (SELECT doc_id, rule, query, CASE rule {" ".join(f"WHEN '{rule}' THEN {wrong}" for rule, (_, _, wrong) in RULES.items())} END AS wrong FROM q)
SELECT doc_id, rule, query, coalesce(wrong, '') AS reasons, wrong IS NULL AS valid, concat_ws('; ', {HINTS_SQL}) AS warnings FROM c"""
)
def validate_rules(spark, sf):
    """Every rule for clauses, on values made from the digest and the first word of each document's text."""
    made = F.array(*(F.struct(F.lit(rule).alias("rule"), F.expr(f"'{field}:' || {v}" if field else v).alias("query")) for rule, (field, v, _) in RULES.items()))
    asked = docs(spark, sf).selectExpr("doc_id", *RULE_VALUES).select("doc_id", F.explode(made).alias("q")).select(F.concat_ws("|", "doc_id", "q.rule").alias("query_id"), "q.query")
    key = F.split("query_id", r"\|")
    return V.validate(asked).select(F.get(key, F.lit(0)).cast("long").alias("doc_id"), F.get(key, F.lit(1)).alias("rule"), "query", F.array_join("reasons", "; ").alias("reasons"), "valid", F.array_join("warnings", "; ").alias("warnings"))


@query(
    """WITH d AS (SELECT doc_id, (CASE WHEN doc_id % 6 = 0 THEN CAST(1900 + doc_id % 150 AS VARCHAR) ELSE (1980 + doc_id % 50) || '-' || lpad(CAST(doc_id % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 33 AS VARCHAR), 2, '0') END) AS value FROM documents)
SELECT doc_id, value, CASE WHEN length(value) = 4 OR try_cast(value AS DATE) IS NOT NULL THEN '' ELSE 'Invalid value for FIRST_PDATE: ''' || value || ''' - expected YYYY or YYYY-MM-DD' END AS message FROM d"""
)
def validate_dates(spark, sf):
    d = F.col("doc_id")
    value = F.when(d % 6 == 0, (1900 + d % 150).cast("string")).otherwise(F.concat_ws("-", (1980 + d % 50).cast("string"), F.lpad((d % 14).cast("string"), 2, "0"), F.lpad((d % 33).cast("string"), 2, "0")))
    rows = docs(spark, sf).select("doc_id", F.concat(F.lit("FIRST_PDATE:"), value).alias("query"))
    checked = V.clause_messages(V.clauses(rows))
    return checked.select("doc_id", F.col("bare").alias("value"), F.array_join("messages", "; ").alias("message"))


@query("SELECT doc_id, CASE upper(source) WHEN 'SRC0' THEN 'CC-BY-NC-SA' ELSE 'CC-' || upper(source) || '-X' END AS code FROM documents")
def license_canonical(spark, sf):
    raw = F.when(F.col("source") == "src0", " by_nc sa").otherwise(F.concat(F.lit("cc__"), F.col("source"), F.lit(" - x ")))
    return docs(spark, sf).select("doc_id", X.license_code(raw).alias("code"))


@query(
    """SELECT doc_id, doc_id % 4 < 2 AS valid FROM documents"""
)
def isbn_check(spark, sf):
    d = F.col("doc_id")
    ten, thirteen = F.concat(F.lpad((d % 100000000).cast("string"), 9, "0"), F.lit("-X")), F.concat(F.lit("978 "), F.lpad((d % 100000000).cast("string"), 10, "0"))
    value = F.when(d % 4 == 0, ten).when(d % 4 == 1, thirteen).when(d % 4 == 2, F.concat(F.lit("9"), thirteen)).otherwise(F.concat(F.lit("Z"), ten))
    return docs(spark, sf).select("doc_id", X.is_isbn(value).alias("valid"))


@query("SELECT doc_id AS id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def id_semi_join(spark, sf):
    ids = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    return C.with_ids(docs(spark, sf).select(F.col("doc_id").alias("id"), "text"), ids)


@query("SELECT doc_id * 2 AS id FROM labels WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents) GROUP BY 1")
def id_anti_join(spark, sf):
    ids = spark.read.parquet(f"{sf}/labels.parquet").select((F.col("doc_id") * 2).alias("id")).distinct()
    return C.missing_ids(ids, docs(spark, sf).select(F.col("doc_id").alias("id")))


def _articles(spark, sf):
    """Documents as article XML: a section of their lines, a skipped section and a table."""
    safe = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.concat(F.lit("<p>"), F.replace(safe, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    id_ = F.col("doc_id").cast("string")
    table = F.concat(F.lit("<table-wrap><label>T</label><table><tr><td>a</td><td/><td>"), id_, F.lit("</td></tr><tr><th>b</th></tr></table></table-wrap>"))
    xml = F.concat(F.lit('<article xmlns="urn:a"><front><p>front</p></front><body><sec sec-type="Intro"><title>Lines</title>'), body, table, F.lit('</sec><sec sec-type="Funding"><p>paid by x</p></sec></body></article>'))
    return docs(spark, sf).select("doc_id", xml.alias("xml"))


ARTICLE_PARAGRAPHS = r"""lines AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '\s+', ' ', 'g')) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
every_line AS (SELECT * FROM lines UNION ALL SELECT doc_id, 'T. a | ' || doc_id || ' ; b', 1000000 FROM documents),
first_lines AS (SELECT doc_id, text, min(pos) AS pos FROM every_line WHERE text <> '' GROUP BY doc_id, text),
paragraphs AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS para_idx, text FROM first_lines)"""


@query(f"WITH {ARTICLE_PARAGRAPHS} SELECT doc_id, para_idx, text, 'Lines' AS section_title, 'Intro' AS section_type FROM paragraphs")
def article_xml_paragraphs(spark, sf):
    return article_paragraphs(_articles(spark, sf))


@query(f"""WITH {RANKED.replace(PARAGRAPHS, ARTICLE_PARAGRAPHS).replace(TOKENS.format("p.text"), TOKENS.format("p.text || ' Lines Intro'"))}
SELECT doc_id, para_idx, text, 'Lines' AS section_title, 'Intro' AS section_type, round(score, 5) AS score, rank FROM ranked""")
def article_ranking(spark, sf):
    """Paragraphs of article XML ranked for each document's first line; titles and types of sections count as text."""
    asked = docs(spark, sf).select("doc_id", _first_line_terms().alias("terms"))
    return _score(R.bm25_within(article_paragraphs(_articles(spark, sf)), asked))


@query(f"WITH {ARTICLE_PARAGRAPHS} SELECT doc_id, CAST(count(*) AS INTEGER) AS n FROM paragraphs WHERE doc_id % 3 <> 0 GROUP BY doc_id")
def malformed_xml_empty(spark, sf):
    """Raw web pages and every third article, which is cut, can't be parsed and give nothing; the others do."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select((-1 - F.col("page_id")).alias("doc_id"), F.col("html").alias("xml"))
    cut = F.when(F.col("doc_id") % 3 == 0, F.expr("left(xml, length(xml) - 9)")).otherwise(F.col("xml"))
    return article_paragraphs(_articles(spark, sf).withColumn("xml", cut).union(pages)).groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))


#: Types and titles of the sections that lines of a document go to in turn, and searches in them.
PARTS = [("Intro", ""), ("", "Materials and methods"), ("results|discussion", "Results"), ("", "Remarks")]
SECTION_TEXTS = [
    ("INTRO:the AND NOT METHODS:the", "contains(i, ' the ') AND NOT contains(m, ' the ')"), ('RESULTS:"of the" OR DISCUSS:"in the"', "contains(r, ' of the ') OR contains(r, ' in the ')"),
    ("OTHER:(license OR de) IN_EPMC:Y", "(contains(o, ' license ') OR contains(o, ' de ')) AND in_store"), ("CONCL:the", "false"),
]


def _section_sql(k: int) -> str:
    own = f"string_agg(line, chr(10) ORDER BY pos) FILTER (pos % 4 = {k})"
    return f"' ' || array_to_string(regexp_extract_all(lower(coalesce({own}, '')), '[\\p{{L}}\\p{{N}}_]+'), ' ') || ' '"


@query(
    f"""WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, coalesce(n_chars > 2000, false) AS in_store FROM documents),
once AS (SELECT doc_id, in_store, line, min((pos + 3) % 4 * 1000000 + pos) % 1000000 AS pos FROM (SELECT doc_id, in_store, pos, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM lines) WHERE line <> '' GROUP BY ALL),
s AS (SELECT doc_id, in_store, {_section_sql(1)} AS i, {_section_sql(2)} AS m, {_section_sql(3)} AS r, {_section_sql(0)} AS o FROM once WHERE doc_id % 5 <> 1 GROUP BY doc_id, in_store)
"""
    + " UNION ALL ".join(f"SELECT {k} AS query_id, doc_id FROM s WHERE {sql}" for k, (_, sql) in enumerate(SECTION_TEXTS))
)
def section_search(spark, sf):
    """Searches in sections of full texts, which lie in a bucketed table and are fetched by id; every fifth paper has none."""
    d = docs(spark, sf)
    safe = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.transform(F.split(safe, "\n", -1), lambda x, k: F.struct(x.alias("line"), ((k + 1) % 4).alias("part")))
    part = lambda k, kind, title: F.concat(F.lit(f'<sec sec-type="{kind}"><title>{title}</title>'), F.array_join(F.transform(F.filter(lines, lambda x: x["part"] == k), lambda x: F.concat(F.lit("<p>"), x["line"], F.lit("</p>"))), ""), F.lit("</sec>"))
    xml = F.concat(F.lit("<article><body>"), *(part((k + 1) % 4, *PARTS[k]) for k in range(4)), F.lit("</body></article>"))
    full = d.where("doc_id % 5 <> 1").select(F.concat(F.lit("PMC"), F.col("doc_id").cast("string")).alias("pmcid"), xml.alias("xml"))
    table = f"full_texts_{uuid.uuid4().hex}"
    store_full_texts(full, table, 8, path=f"{scratch_dir(spark)}/{table}")
    papers = C.papers(d).drop("text").withColumn("full_text_id", X.full_text_id(F.lit(True), F.array().cast("array<string>"), F.col("doc_id").cast("string")))
    found = with_sections(with_full_text(papers, spark.table(table)))
    asked = F.array(*(F.when(condition(text, found.columns), k) for k, (text, _) in enumerate(SECTION_TEXTS)))
    return found.select(F.explode(F.array_compact(asked)).alias("query_id"), "doc_id")


def _raw_records(spark, sf):
    """Documents as raw search records, with what is missing or wrong in real ones."""
    d, s = F.col("doc_id"), F.col("doc_id").cast("string")
    author = F.struct(F.when(d % 3 == 0, " Ann ").alias("firstName"), F.when(d % 3 < 2, F.concat(F.lit("L"), s)).alias("lastName"), F.concat(F.lit("Full "), s).alias("fullName"), F.struct(F.when(d % 2 == 0, F.array(F.struct(F.col("source").alias("affiliation")))).alias("authorAffiliationDetailsList0")).alias("x"))
    made = F.array(F.struct(author["firstName"].alias("firstName"), author["lastName"].alias("lastName"), author["fullName"].alias("fullName"), F.struct(author["x"]["authorAffiliationDetailsList0"].alias("authorAffiliation")).alias("authorAffiliationDetailsList")))
    null = F.lit(None).cast("string")
    return docs(spark, sf).select(
        F.concat(F.lit("A/"), s, F.lit(" *~")).alias("id"), F.when(d % 9 != 0, F.col("source")).alias("source"), F.when(d % 5 != 0, F.col("lang")).alias("title"), null.alias("authorString"), s.alias("pmid"), F.concat(F.lit("PMC"), s).alias("pmcid"), null.alias("doi"), null.alias("abstractText"), null.alias("pubYear"),
        F.when(d % 2 == 0, "Y").otherwise("y").alias("isOpenAccess"), F.when(d % 3 == 0, "Y").alias("hasPDF"), F.lit("N").alias("inEPMC"), F.struct(made.alias("author")).alias("authorList"),
        F.struct(F.when(d % 4 == 0, F.concat(F.lit('["P'), s, F.lit('"]'))).when(d % 4 == 1, F.concat(F.lit("P"), s)).alias("fullTextId")).alias("fullTextIdList"),
        F.struct(F.when(d % 4 == 2, '{"availabilityCode": "oa"}').when(d % 8 == 3, '[{"availabilityCode": "S"}]').alias("fullTextUrl")).alias("fullTextUrlList"), F.struct(F.struct(null.alias("title")).alias("journal")).alias("journalInfo"),
    )


@query(
    """WITH d AS (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents)
SELECT s AS pmid, CASE WHEN doc_id % 5 <> 0 THEN lang ELSE 'No title' END AS title, 'Unknown authors' AS authors, doc_id % 2 = 0 AS is_open_access, doc_id % 3 = 0 AS has_pdf, false AS in_store,
  CASE doc_id % 3 WHEN 0 THEN 'Ann L' || s WHEN 1 THEN 'L' || s ELSE 'Full ' || s END AS author,
  CASE WHEN doc_id % 2 = 0 THEN CASE doc_id % 3 WHEN 0 THEN 'Ann L' || s WHEN 1 THEN 'L' || s ELSE 'Full ' || s END || ': ' || source ELSE '' END AS affiliations,
  CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'https://example.org/article/' || source || '/A%2F' || s || '%20%2A~' END AS url,
  doc_id % 4 < 3 AS has_free_full_text, CASE WHEN doc_id % 4 < 2 THEN 'P' || s WHEN doc_id % 4 = 2 THEN 'PMC' || s ELSE '' END AS full_text_id FROM d"""
)
def record_projection(spark, sf):
    p = C.records_to_papers(_raw_records(spark, sf))
    wanted = X.full_text_id(F.col("in_store") | F.col("has_free_full_text"), F.col("full_text_ids"), F.col("pmcid"))
    return p.select("pmid", "title", "authors", "is_open_access", "has_pdf", "in_store", F.get("author_names", F.lit(0)).alias("author"), "affiliations", "url", "has_free_full_text", wanted.alias("full_text_id"))


@query(
    """WITH r AS (SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents WHERE source IS NOT NULL),
q AS (SELECT source, CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS query_idx FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))
SELECT query_idx, source AS query, CAST(rank AS INTEGER) AS rank, CAST(doc_id AS VARCHAR) AS pmid, lang AS title FROM r JOIN q USING (source) WHERE rank <= 20 AND query_idx % 5 <> 2"""
)
def remote_search(spark, sf):
    """Pages of answers, one a source of the documents, read by the data source for searches; every fifth answer is cut and gives nothing."""
    d = docs(spark, sf).where("source is not null")
    first = d.withColumn("rank", F.row_number().over(R.Window.partitionBy("source").orderBy("doc_id"))).where("rank <= 20")
    record = F.to_json(F.struct(F.col("doc_id").cast("string").alias("pmid"), F.col("lang").alias("title")))
    pages = first.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", record.alias("r")))), lambda x: x["r"]), ",").alias("records")).orderBy("source").collect()  # 20 records a source
    folder = f"{scratch_dir(spark)}/answers-{uuid.uuid4().hex}"
    path, files = spark._jvm.org.apache.hadoop.fs.Path, spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for k, page in enumerate(pages):
        out = files.create(path(f"{folder}/{k}.json"))
        out.write(bytearray(('{"resultList": {"result": [' + page.records + "]}}")[: None if k % 5 != 2 else -9].encode()))
        out.close()
    found = remote_records(spark, folder.removeprefix("file:").replace("///", "/", 1), [p.source for p in pages])
    return found.select("query_idx", "query", "rank", "pmid", "title")


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 5 THEN NULL WHEN 4 THEN '' ELSE doc_id || ',' || (doc_id + 1) END AS ids FROM documents"""
)
def lenient_replies(spark, sf):
    d, s = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    plain = F.concat(F.lit('{"relevant_ids": ["'), s, F.lit('", '), (F.col("doc_id") + 1).cast("string"), F.lit("]}"))
    reply = F.when(d == 0, plain).when(d == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).when(d == 2, F.concat(F.lit("Here you are: "), plain, F.lit(" Done."))).when(d == 3, F.concat(F.lit("```\n"), plain, F.lit("```"))).when(d == 4, '{"relevant_ids": []}').otherwise("none of them")
    return docs(spark, sf).select("doc_id", F.array_join(X.reply_ids(reply), ",").alias("ids"))


@query(
    r"""SELECT doc_id, coalesce(CASE doc_id % 5 WHEN 1 THEN array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10)) WHEN 4 THEN '' ELSE text END, '') AS reply FROM documents"""
)
def assistant_texts(spark, sf):
    """The texts in logged answers of a chat model: a string, a block a line, reasoning without content, an old form, and a cut answer."""
    d, text = F.col("doc_id") % 5, F.coalesce("text", F.lit(""))
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.struct(F.lit("text").alias("type"), x.alias("text")))
    message = lambda *c: F.to_json(F.struct(F.array(F.struct(F.struct(*c).alias("message"))).alias("choices")))
    old = F.to_json(F.struct(F.array(F.struct(text.alias("text"))).alias("choices")))
    body = F.when(d == 0, message(text.alias("content"))).when(d == 1, message(lines.alias("content"))).when(d == 2, message(F.lit("").alias("content"), text.alias("reasoning_content"))).when(d == 3, old).otherwise(F.expr("'{' || left(text, 10)"))
    return docs(spark, sf).select("doc_id", assistant_text(body).alias("reply"))


@query(
    f"""WITH {PAPERS}, {SENTENCES}, items AS (SELECT doc_id, string_agg('{{"id":' || to_json(sid) || ',"text":' || to_json(sentence) || '}}', ',' ORDER BY sent_idx) AS items FROM sids GROUP BY doc_id)
SELECT doc_id, '{{"id":' || to_json(paper_id) || ',"title":' || to_json(CASE WHEN title = '' THEN 'N/A' ELSE title END) || ',"authors":"N/A","affiliations":"N/A","journal":"N/A","year":"' || year || '","abstract":[' || coalesce(items, '') || ']}}' AS paper FROM papers LEFT JOIN items USING (doc_id)"""
)
def judge_payloads(spark, sf):
    d = docs(spark, sf)
    return payloads(C.papers(d), E.sentence_rows(d))


def _passages_sql(cites: str = "hits >= 1", order: str = "hits DESC, sent_idx", place: str = "best DESC, cand_pos", candidates: str = CANDIDATES) -> str:
    """SQL of passages(), for a judge that cites sentences where cites holds and orders them and papers so."""
    return (
    candidates
    + f""", {PARAGRAPHS},
qterms AS (SELECT question_id, list_distinct({TOKENS.format("CASE WHEN b = '' THEN text ELSE b END")}) AS terms FROM bare),
pairs AS (SELECT question_id || ':' || doc_id AS pair, question_id, doc_id, paper_id, cand_pos, terms FROM found JOIN qterms USING (question_id)),
p_counted AS (SELECT pair, para_idx, p.text, terms, {TOKENS.format("p.text")} AS t FROM pairs JOIN papers USING (doc_id) JOIN paragraphs p USING (doc_id) WHERE in_store),
p_meaned AS (SELECT *, len(t) AS dl, count(*) OVER (PARTITION BY pair) AS n, avg(CAST(len(t) AS DOUBLE)) OVER (PARTITION BY pair) AS mean FROM p_counted),
p_tf AS (SELECT pair, para_idx, n, dl, mean, term, count(*) AS tf FROM (SELECT pair, para_idx, n, dl, mean, unnest(list_filter(t, lambda x: list_contains(terms, x))) AS term FROM p_meaned) GROUP BY ALL),
p_dfs AS (SELECT *, count(*) OVER (PARTITION BY pair, term) AS df FROM p_tf),
p_scored AS (SELECT pair, para_idx, sum(ln(CAST(1 AS DOUBLE) + (CAST(n AS DOUBLE) - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * tf / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / mean))) AS score FROM p_dfs GROUP BY ALL),
p_ranked AS (SELECT pair, para_idx, text, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY pair ORDER BY round(coalesce(score, 0), 9) DESC, para_idx) AS rank FROM p_counted LEFT JOIN p_scored USING (pair, para_idx)),
p_positive AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY CASE WHEN best > 0 THEN rank ELSE para_idx END) AS place FROM (SELECT *, max(score) OVER (PARTITION BY pair) AS best FROM p_ranked) WHERE score > 0 OR best <= 0),
p_kept AS (SELECT * FROM (SELECT *, coalesce(sum({N_WORDS.format("text")}) OVER (PARTITION BY pair ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p_positive) WHERE before < 2304),
excerpts AS (SELECT pair, string_agg(text, ' ' ORDER BY para_idx) AS excerpt FROM p_kept GROUP BY pair),
cands AS (SELECT pairs.*, title, abstract, year, in_store, pmid, doi, excerpt FROM pairs JOIN papers USING (doc_id) LEFT JOIN excerpts USING (pair)),
full_lists AS (SELECT pair, list_filter(list_transform(regexp_extract_all(excerpt, '[^.!?]+[.!?]*'), lambda s: trim(regexp_replace(s, '^[ \\n\\t\\r]+|[ \\n\\t\\r]+$', '', 'g'))), lambda s: s <> '') AS found, excerpt AS whole FROM cands WHERE excerpt <> ''),
full_rows AS (SELECT pair, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sent_idx FROM (SELECT pair, CASE WHEN len(found) = 0 AND trim(whole) <> '' THEN [trim(whole)] ELSE found END AS s FROM full_lists)),
full_hits AS (SELECT r.*, question_id, cand_pos, len(list_intersect(list_distinct({TOKENS.format("sentence")}), terms)) AS hits FROM full_rows r JOIN pairs USING (pair)),
full_cited AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY {order}) AS judge_pos, {N_WORDS.format("sentence")} AS words FROM full_hits WHERE {cites}),
full_kept AS (SELECT * FROM (SELECT *, coalesce(sum(words) OVER (PARTITION BY pair ORDER BY judge_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM full_cited) WHERE before < 250),
full_numbered AS (SELECT *, sum(opens) OVER (PARTITION BY pair ORDER BY sent_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS span FROM (SELECT *, CASE WHEN sent_idx = lag(sent_idx) OVER (PARTITION BY pair ORDER BY sent_idx) + 1 THEN 0 ELSE 1 END AS opens FROM full_kept)),
full_texts AS (SELECT pair, span, string_agg(sentence, ' ' ORDER BY sent_idx) AS text FROM full_numbered GROUP BY pair, span),
full_left AS (SELECT *, {N_WORDS.format("text")} AS words, CAST(250 - coalesce(sum({N_WORDS.format("text")}) OVER (PARTITION BY pair ORDER BY span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest FROM full_texts),
full_spans AS (SELECT pair, list(CASE WHEN words <= rest THEN text ELSE array_to_string({WORDS.format("text")}[1:rest], ' ') END ORDER BY span) AS spans FROM full_left WHERE rest > 0 GROUP BY pair),
full_order AS (SELECT pair, row_number() OVER (PARTITION BY question_id ORDER BY {place}) AS place FROM (SELECT pair, question_id, cand_pos, max(hits) AS best FROM full_cited GROUP BY ALL)),
brief_lists AS (SELECT pair, list_filter(list_transform(regexp_extract_all(abstract, '[^.!?]+[.!?]*'), lambda s: trim(regexp_replace(s, '^[ \\n\\t\\r]+|[ \\n\\t\\r]+$', '', 'g'))), lambda s: s <> '') AS found, abstract AS whole FROM cands WHERE abstract <> ''),
brief_rows AS (SELECT pair, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sent_idx FROM (SELECT pair, CASE WHEN len(found) = 0 AND trim(whole) <> '' THEN [trim(whole)] ELSE found END AS s FROM brief_lists)),
brief_hits AS (SELECT r.*, question_id, cand_pos, len(list_intersect(list_distinct({TOKENS.format("sentence")}), terms)) AS hits FROM brief_rows r JOIN pairs USING (pair)),
brief_cited AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY {order}) AS judge_pos, {N_WORDS.format("sentence")} AS words FROM brief_hits WHERE {cites}),
brief_kept AS (SELECT * FROM (SELECT *, coalesce(sum(words) OVER (PARTITION BY pair ORDER BY judge_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM brief_cited) WHERE before < 250),
brief_numbered AS (SELECT *, sum(opens) OVER (PARTITION BY pair ORDER BY sent_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS span FROM (SELECT *, CASE WHEN sent_idx = lag(sent_idx) OVER (PARTITION BY pair ORDER BY sent_idx) + 1 THEN 0 ELSE 1 END AS opens FROM brief_kept)),
brief_texts AS (SELECT pair, span, string_agg(sentence, ' ' ORDER BY sent_idx) AS text FROM brief_numbered GROUP BY pair, span),
brief_left AS (SELECT *, {N_WORDS.format("text")} AS words, CAST(250 - coalesce(sum({N_WORDS.format("text")}) OVER (PARTITION BY pair ORDER BY span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest FROM brief_texts),
brief_spans AS (SELECT pair, list(CASE WHEN words <= rest THEN text ELSE array_to_string({WORDS.format("text")}[1:rest], ' ') END ORDER BY span) AS spans FROM brief_left WHERE rest > 0 GROUP BY pair),
brief_order AS (SELECT pair, row_number() OVER (PARTITION BY question_id ORDER BY {place}) AS place FROM (SELECT pair, question_id, cand_pos, max(hits) AS best FROM brief_cited GROUP BY ALL)),
w AS (SELECT cands.*, excerpt IS NOT NULL AS has_excerpt, f.place AS full_order, b.place AS abstract_order, fs.spans AS full_spans, bs.spans AS abstract_spans FROM cands
  LEFT JOIN full_order f USING (pair) LEFT JOIN brief_order b USING (pair) LEFT JOIN full_spans fs USING (pair) LEFT JOIN brief_spans bs USING (pair)),
two AS (SELECT *, 0 AS pool, full_order AS pool_order FROM w WHERE full_order IS NOT NULL UNION ALL SELECT *, 1, abstract_order FROM w WHERE NOT has_excerpt AND full_order IS NULL AND abstract_order IS NOT NULL),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, pool ORDER BY pool_order, cand_pos) AS pool_rank FROM two) WHERE pool_rank <= 30),
every AS (SELECT * FROM capped UNION ALL SELECT *, 2, cand_pos, cand_pos FROM w WHERE question_id NOT IN (SELECT question_id FROM capped)),
placed AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pool, pool_rank) AS final_pos FROM every),
chosen AS (SELECT *, CASE WHEN len(full_spans) > 0 THEN full_spans WHEN len(abstract_spans) > 0 THEN abstract_spans ELSE [CASE WHEN coalesce(excerpt, '') <> '' THEN excerpt ELSE abstract END] END AS e FROM placed WHERE final_pos <= 60)
SELECT question_id, final_pos, doc_id, paper_id, title, year, pool, has_excerpt, in_store AS has_full_text, pmid, doi, array_to_string(list_filter(list_transform(e, lambda s: trim(s)), lambda s: s <> ''), chr(10)) AS evidence FROM chosen"""
)


PASSAGES = _passages_sql()


@query("WITH " + PASSAGES)
def evidence_pipeline(spark, sf):
    """Ranked evidence passages for every question of the benchmark."""
    d = docs(spark, sf)
    return passages(C.papers(d), C.paragraphs(d), questions(spark, sf)).withColumn("evidence", F.array_join("evidence", "\n"))


@query(
    "WITH " + PASSAGES.rsplit("SELECT question_id, final_pos, doc_id", 1)[0]
    + """SELECT question_id, final_pos, '[' || final_pos || '] ' || title || ' (' || year || ') ' || paper_id
  || array_to_string(list_transform(list_filter(list_transform(e, lambda s: trim(s)), lambda s: s <> ''), lambda s: chr(10) || '    ' || s), '') AS line FROM chosen"""
)
def evidence_report(spark, sf):
    """The same as text for people."""
    d = docs(spark, sf)
    return report.lines(passages(C.papers(d), C.paragraphs(d), questions(spark, sf)))


def _planner(prompt: str) -> str:
    """A stand-in for a model: two plain queries of the question's words and one that isn't valid."""
    words = re.findall(r"[^\W\d_]+", prompt.split("\n\n", 1)[1])
    return "```json\n" + json.dumps({"queries": [" ".join(words[:3]), f"NOPE:{words[0]}", " ".join(words[3:8])]}) + "\n```"


def _judge(prompt: str) -> str:
    """A stand-in for a model: cites every third sentence, and one that isn't there."""
    papers = json.loads(prompt.split("Papers:\n", 1)[1])
    return "Here: " + json.dumps({"relevant_ids": [x["id"] for p in papers for x in p["abstract"][1::3]] + ["none_A"]})


MODEL_PLANNED = r"""planned AS (SELECT question_id, text, min(query_idx) AS query_idx FROM (
  SELECT item_id AS question_id, unnest([array_to_string(w[1:3], ' '), array_to_string(w[4:8], ' ')]) AS text, unnest([0, 2]) AS query_idx FROM (SELECT item_id, regexp_extract_all(text, '\p{L}+') AS w FROM benchmark)) WHERE text <> '' GROUP BY question_id, text)"""
LEXICAL_PLANNED = "planned AS (SELECT question_id, text, min(query_idx) AS query_idx FROM made WHERE trim(text) <> '' GROUP BY question_id, text)"


@query("WITH " + _passages_sql("sent_idx % 3 = 1", "sent_idx", "cand_pos", CANDIDATES.replace(LEXICAL_PLANNED, MODEL_PLANNED)))
def model_judged_pipeline(spark, sf):
    """The same with functions in place of a planning and a judging model: replies are parsed, invalid queries and unknown ids go."""
    d = docs(spark, sf)
    found = passages(C.papers(d), C.paragraphs(d), questions(spark, sf), planner=_planner, judge=_judge)
    return found.withColumn("evidence", F.array_join("evidence", "\n"))


def _fielded_planner(prompt: str) -> str:
    """A stand-in for a model: loose words, alternatives without a word, a title or a word in some years, and a field that papers don't have."""
    w = re.findall(r"[^\W\d_]+", prompt.split("\n\n", 1)[1])
    w += ["none"] * (6 - len(w))
    return json.dumps({"queries": [f"{w[0]} {w[1]} {w[2]}", f"({w[0]} OR {w[1]}) NOT {w[3]}", f"TITLE:{w[0]} OR ({w[1]} AND PUB_YEAR:[2005 TO 2015])", f"MESH:{w[2]}", f'"{w[4]} {w[5]}"']})


FIELDED_PLANNED = r"""qw AS (SELECT item_id AS question_id, list_concat(w, list_transform(range(6 - len(w)), lambda i: 'none')) AS w FROM (SELECT item_id, regexp_extract_all(text, '\p{L}+') AS w FROM benchmark)),
ql AS (SELECT question_id, w, list_transform(w, lambda x: lower(x)) AS l FROM qw),
planned AS (SELECT question_id, unnest([0, 1, 2, 4]) AS query_idx, unnest([array_to_string(w[1:3], ' '), w[1] || ' ' || w[2], w[1] || ' ' || w[2], w[5] || ' ' || w[6]]) AS text FROM qw)"""
FIELDED_SCORED = rf"""loose AS (SELECT question_id, query_idx, doc_id, sum(weight) AS score FROM weighed JOIN sub USING (term) GROUP BY ALL),
d AS (SELECT doc_id, year, {W} AS dw, {TITLE_WORDS} AS tw, ' ' || array_to_string({W}, ' ') || ' ' AS norm FROM papers),
met AS (SELECT question_id, doc_id, unnest([1, 2, 4]) AS query_idx, unnest([(list_contains(dw, l[1]) OR list_contains(dw, l[2])) AND NOT list_contains(dw, l[4]),
    list_contains(tw, l[1]) OR (list_contains(dw, l[2]) AND CAST(year AS INTEGER) BETWEEN 2005 AND 2015), contains(norm, ' ' || l[5] || ' ' || l[6] || ' ')]) AS holds FROM ql, d),
scored AS (SELECT * FROM loose WHERE query_idx = 0 UNION ALL SELECT question_id, query_idx, doc_id, coalesce(score, 0) FROM met LEFT JOIN loose USING (question_id, query_idx, doc_id) WHERE holds)"""
LOOSE_SCORED = "scored AS (SELECT question_id, query_idx, doc_id, sum(weight) AS score FROM weighed JOIN sub USING (term) GROUP BY ALL)"
FIELDED_CANDIDATES = f"{PAPERS}, " + CANDIDATES.replace(LEXICAL_PLANNED, FIELDED_PLANNED).replace(LOOSE_SCORED, FIELDED_SCORED).replace(f", {PAPERS}", "")


@query("WITH " + _passages_sql(candidates=FIELDED_CANDIDATES))
def fielded_pipeline(spark, sf):
    """Passages for sub-queries with operators, fields, ranges of years and phrases, which papers have to meet."""
    d = docs(spark, sf)
    return passages(C.papers(d), C.paragraphs(d), questions(spark, sf), planner=_fielded_planner).withColumn("evidence", F.array_join("evidence", "\n"))
