"""BM25 over a corpus and within documents, and budgets on ranked rows."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, StructField, StructType

from lodestone.functions.batches import pieces
from lodestone.functions.text import STOPWORDS, plain_terms, tokens, word_count
from lodestone.operators.parsing import parse
from lodestone.operators.percolate import Steps, answerable, percolator, positive_words, read_columns
from lodestone.operators.querytext import program
from lodestone.operators.search import normal
from lodestone.scratch import materialize, release

K1, B = 1.5, 0.75
#: Questions that are answered in one pass over the corpus, and documents that a task scores at once.
QUESTION_BLOCK, DOC_BLOCK = 4096, 4096
#: Bytes of texts whose words are counted, and of counts that are scored, at once.
DOC_BYTES, COUNT_BYTES = 1 << 20, 4 << 20
#: Decimals of a score that decide an order; beyond them ties go to the smaller id.
DECIMALS = 9


def bm25_weight(tf: Column, df: Column, n: Column, length: Column, mean: Column, k1: float = K1, b: float = B) -> Column:
    """A term's share of a document's score; doubles throughout, and above zero for every term that occurs."""
    d = lambda c: c.cast("double")
    idf = F.log(F.lit(1.0) + (d(n) - d(df) + 0.5) / (d(df) + 0.5))
    return idf * d(tf) / (d(tf) + k1 * (F.lit(1.0 - b) + b * d(length) / d(mean)))


def _token_lists(normal: pa.Array) -> pa.ListArray:
    """text.tokens() of texts, given as search.normal() has them."""
    split = pc.split_pattern(normal, " ")
    words = split.flatten()
    kept = pc.and_(pc.greater(pc.utf8_length(words), 1), pc.invert(pc.is_in(words, pa.array(STOPWORDS))))
    before = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
    ends = split.offsets.to_numpy() - split.offsets[0].as_py()
    return pa.ListArray.from_arrays(pa.array(before[ends], pa.int32()), words.filter(kept))


def _term_counts(asked: pa.Array, stored=None, names: list[str] = (), at: int = 2):
    """doc_id, length, the numbers and counts of the asked terms that occur, and the conditions that the document meets.

    The second column has the documents' tokens, or their texts as search.normal() has them. What the conditions read begins at column number at.
    """
    listed = lambda ends, x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32()))

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1) if pa.types.is_list(batch.column(1).type) else _token_lists(batch.column(1))
        length = pc.fill_null(pc.list_value_length(lists), 0)
        term = pc.index_in(lists.flatten(), asked)
        doc = pc.list_parent_indices(lists)
        hit = pc.is_valid(term)
        key = doc.filter(hit).to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(asked)) + term.filter(hit).to_numpy(zero_copy_only=False)
        key, times = np.unique(key, return_counts=True)
        ends = np.searchsorted(key, np.arange(len(batch) + 1) * max(1, len(asked)))
        met = np.zeros((2, 0), np.int64)  # documents and conditions that they meet
        if stored is not None:
            parts = [np.stack([places, np.full(len(places), k)]) for k, places in stored.meeting(read_columns(batch, names, at), len(batch))]
            met = np.concatenate([met, *parts], axis=1)
            met = met[:, np.argsort(met[0], kind="stable")]
        met_ends = np.searchsorted(met[0], np.arange(len(batch) + 1))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), length.cast(pa.int64()), listed(ends, key % max(1, len(asked))), listed(ends, times), listed(met_ends, met[1])],
            names=["doc_id", "length", "ids", "times", "met"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(counted, pieces(batch, DOC_BLOCK, DOC_BYTES))

    return run


def _best_of_task(questions: list[list[int]], gated: set[int], idf: np.ndarray, mean: float, k: int):
    """(question, doc_id, score): the k best documents of a task for each question, given as term numbers; gated ones take all that meet their condition, and no others."""

    def cut(question: np.ndarray, doc: np.ndarray, score: np.ndarray) -> np.ndarray:
        order = np.lexsort((doc, -np.round(score, DECIMALS), question))
        question = question[order]
        return order[np.arange(len(order)) - np.searchsorted(question, question) < k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        docs: list = []  # ids of the documents that held counts by number
        for whole in batches:
            for batch in pieces(whole, DOC_BLOCK, COUNT_BYTES):
                ids, times = batch.column(2), batch.column(3)
                doc = pc.list_parent_indices(ids).to_numpy(zero_copy_only=False).astype(np.int64)
                term, tf = ids.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                length = batch.column(1).to_numpy(zero_copy_only=False)[doc]
                weight = idf[term] * tf / (tf + K1 * (1.0 - B + B * length / mean)) if len(term) else np.zeros(0)
                order = np.argsort(term, kind="stable")
                term, doc, weight = term[order], doc[order], weight[order]
                bounds = np.searchsorted(term, np.arange(len(idf) + 1))
                names = docs + batch.column(0).to_pylist()
                meeting = batch.column(4)
                met, met_doc = meeting.flatten().to_numpy(zero_copy_only=False), pc.list_parent_indices(meeting).to_numpy(zero_copy_only=False).astype(np.int64)
                order = np.argsort(met, kind="stable")
                met, met_doc = met[order], met_doc[order]
                found = [held]
                for q, terms in enumerate(questions):
                    score = np.zeros(len(batch))
                    for t in terms:
                        a, b = bounds[t], bounds[t + 1]
                        score[doc[a:b]] += weight[a:b]  # a document has a term once
                    some = met_doc[np.searchsorted(met, q) : np.searchsorted(met, q, "right")] if q in gated else np.flatnonzero(score > 0)
                    if len(some) > k:
                        rounded = np.round(score[some], DECIMALS)
                        some = some[rounded >= np.partition(rounded, len(some) - k)[len(some) - k]]
                    found.append((np.full(len(some), q), some + len(docs), score[some]))
                question, number, score = (np.concatenate(x) for x in zip(*found, strict=True))
                place = np.empty(len(names), np.int64)
                place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
                keep = cut(question, place[number], score)
                used, number = np.unique(number[keep], return_inverse=True)
                docs = [names[i] for i in used]
                held = question[keep], number, score[keep]
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int32()), pa.array([docs[i] for i in held[1]], batch.schema.field(0).type), pa.array(held[2])], names=["question", "doc_id", "score"])

    return run


class _Asked(NamedTuple):
    """A question by its terms and, if it sets one, its condition."""

    question_id: object
    terms: list[str]
    steps: Steps | None


def _asked(row: Row, fielded: bool) -> _Asked:
    """A question as it is ranked. A text with a fault, and one of words alone, is a list of loose words; else positive operands rank what meets the condition."""
    # a question mark at the end of a word is one
    if not fielded or all(t.kind == "WORD" and not re.search(r"[*]|[?]\w", t.text) for t in parse(row["text"] or "").tokens):
        return _Asked(row["question_id"], row["terms"], None)
    try:
        steps = program(row["text"])
    except ValueError:
        return _Asked(row["question_id"], row["terms"], None)
    return _Asked(row["question_id"], [w for w in positive_words(steps) if len(w) > 1 and w not in STOPWORDS], steps)


def _answered(docs: DataFrame, block: list[_Asked], question_type: DataType, k: int) -> DataFrame:
    """bm25_top for one block of questions."""
    spark = docs.sparkSession
    asked = sorted({t for q in block for t in q.terms})
    number = {t: i for i, t in enumerate(asked)}
    id_type = docs.schema["doc_id"].dataType.simpleString()
    some = docs.where("doc_id is not null")
    gated = {i: q.steps for i, q in enumerate(block) if q.steps is not None}
    stored, columns = percolator(some, gated) if gated else (None, {})
    columns = {"text text": normal("text")} | columns  # tokens are some of these words, so texts are cut into words once
    counted = some.select("doc_id", *(c.alias(name) for name, c in columns.items()))
    counted = materialize(counted.mapInArrow(_term_counts(pa.array(asked, pa.string()), stored, list(columns), 1), f"doc_id {id_type}, length long, ids array<int>, times array<int>, met array<int>"), "counted")
    n, mean = counted.agg(F.count("*"), F.avg(F.col("length").cast("double"))).first()
    df = np.zeros(len(asked))
    for r in counted.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # a row a term of this block
        df[r["id"]] = r["count"]
    idf = np.log(1.0 + (n - df + 0.5) / (df + 0.5))
    best = counted.mapInArrow(_best_of_task([[number[t] for t in q.terms] for q in block], set(gated), idf, mean or 1.0, k), f"question int, doc_id {id_type}, score double")
    best = materialize(best, "best")
    release(counted)
    names = spark.createDataFrame([(i, q.question_id) for i, q in enumerate(block)], StructType([StructField("question", best.schema["question"].dataType), StructField("question_id", question_type)]))
    names = names.coalesce(1)  # a few rows, which a worker on each core would read
    return best.join(names, "question").select("question_id", "doc_id", "score")


def bm25_top(docs: DataFrame, questions: DataFrame, k: int, fielded: bool = False, skip: bool = False) -> DataFrame:
    """(question_id, doc_id, score, rank): the k best of docs (doc_id, text) for each of questions (question_id, text), of those that share a term.

    The same scores as bm25_corpus. The corpus is tokenised once for a block of questions, whose terms go to all
    tasks; each task scores its documents, one block after another, and passes on its k best of each question. So
    neither postings nor pairs of questions and documents are shuffled. Ties, to nine decimals, go to the smaller id. Rows without an id are passed over.

    fielded: texts with operators, quotes, parentheses, wildcards or fields are conditions (see querytext.py) on docs, whose columns they may
    name. The documents that meet one are found in the same pass (see percolate.py), and ranked by the words of its positive operands; they
    need not share any. A text with a fault is ranked by its words, without tags and operators, as is one of words alone. A
    field without a column raises a ValueError, or, with skip, its question finds nothing.
    """
    plain = plain_terms(F.col("text")) if fielded else F.col("text")
    asked = questions.select("question_id", "text", F.array_distinct(tokens(plain)).alias("terms"))
    rows = (q for q in (_asked(row, fielded) for row in (asked if fielded else asked.where(F.size("terms") > 0)).toLocalIterator()) if q.terms or q.steps)
    rows = (q for q in rows if q.steps is None or not skip or answerable([q.steps], docs.columns))
    out = None
    while block := list(itertools.islice(rows, QUESTION_BLOCK)):
        part = _answered(docs if fielded else docs.select("doc_id", "text"), block, asked.schema["question_id"].dataType, k)
        out = part if out is None else out.union(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], StructType([asked.schema["question_id"], docs.schema["doc_id"], StructField("score", DoubleType())]))
    return top_k(out, k, "question_id", F.desc(F.round("score", DECIMALS)), "doc_id")


def bm25_corpus(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, doc_id, score) of docs (doc_id, text) for questions (question_id, text), where they share a term.

    All pairs; bm25_top() gives the best ones of each question without making the others. Only tokens that some
    question has leave a document. The terms' counts are written to the scratch folder, as two steps read them.
    """
    counted = docs.select("doc_id", tokens(F.col("text")).alias("terms")).withColumn("length", F.size("terms"))
    asked = questions.select("question_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    whole = counted.agg(F.struct(F.count("*").alias("n"), F.avg(F.col("length").cast("double")).alias("mean"))).scalar()
    hits = counted.select("doc_id", "length", F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    tf = materialize(hits.groupBy("doc_id", "term", "length").agg(F.count("*").alias("tf")), "tf")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighed = tf.join(df, "term").withColumn("whole", whole).select("doc_id", "term", bm25_weight(F.col("tf"), F.col("df"), F.col("whole.n"), F.col("length"), F.col("whole.mean")).alias("weight"))
    return weighed.join(asked, "term").groupBy("question_id", "doc_id").agg(F.sum("weight").alias("score"))


def top_k(scored: DataFrame, k: int, group: str, *order: Column | str) -> DataFrame:
    """The first k rows of each group with their rank from 1; Spark cuts before it shuffles."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def ranked_text(paragraphs: DataFrame) -> Column:
    """What ranking reads of a paragraph: its text and, where there are such columns, its section's title and type."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("text", "section_title", "section_type") if c in paragraphs.columns]
    return F.concat_ws(" ", *parts)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is found once: inside a lambda a column's expression would be found again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bm25_within(paragraphs: DataFrame, queries: DataFrame) -> DataFrame:
    """paragraphs (doc_id, para_idx, text, ...) with score and rank: each document is a corpus of its own paragraphs.

    queries (doc_id, terms) gives each document's query terms, once. A document's paragraphs meet in one row, where counts, scores
    and ranks are taken from arrays; so the texts are shuffled once. Ties, to nine decimals, go to the earlier
    paragraph; without a shared term the score is 0. Columns of paragraphs stay.
    """
    rest = [c for c in paragraphs.columns if c not in ("doc_id", "para_idx")]
    read = paragraphs.join(queries, "doc_id").withColumn("all", tokens(ranked_text(paragraphs))).withColumn("length", F.size("all"))
    times = lambda hits: F.transform("terms", lambda t: F.size(F.filter(hits, lambda x: x == t)))
    read = read.withColumn("times", _let(F.filter("all", lambda t: F.array_contains("terms", t)), times))
    listed = read.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para_idx", "times", "length", *rest))).alias("listed"), F.first("terms").alias("terms"))
    df = F.transform("terms", lambda _, k: F.size(F.filter("listed", lambda p: F.get(p["times"], k) > 0)))
    mean = F.aggregate("listed", F.lit(0).cast("long"), lambda s, p: s + p["length"]).cast("double") / F.size("listed")

    def score(p: Column, whole: Column) -> Column:
        each = F.zip_with(p["times"], whole["df"], lambda t, d: F.when(t > 0, bm25_weight(t, d, whole["n"], p["length"], whole["mean"])).otherwise(0.0))
        return F.aggregate(each, F.lit(0.0), lambda s, w: s + w)

    whole = F.struct(df.alias("df"), F.size("listed").alias("n"), mean.alias("mean"))
    listed = listed.select("doc_id", _let(whole, lambda w: F.transform("listed", lambda p: F.struct(score(p, w).alias("score"), p.alias("p")))).alias("scored"))
    order = F.array_sort(F.transform("scored", lambda s: F.struct((-F.round(s["score"], DECIMALS)).alias("by"), s["p"]["para_idx"].alias("para_idx"), s["score"].alias("score"), s["p"].alias("p"))))
    rows = listed.select("doc_id", F.posexplode(order).alias("rank", "s"))
    return rows.select("doc_id", F.col("s.para_idx").alias("para_idx"), *(F.col(f"s.p.{c}").alias(c) for c in rest), F.col("s.score").alias("score"), (F.col("rank") + 1).alias("rank"))


def positive_or_all(ranked: DataFrame) -> DataFrame:
    """Rows with a score above zero; for documents without any, all rows, ranked in document order."""
    doc = Window.partitionBy("doc_id")
    best = F.max("score").over(doc)
    kept = ranked.withColumn("best", best).where((F.col("score") > 0) | (F.col("best") <= 0))
    order = F.when(F.col("best") > 0, F.col("rank")).otherwise(F.col("para_idx"))
    return kept.withColumn("rank", F.row_number().over(doc.orderBy(order))).drop("best")


def within_budget(rows: DataFrame, limit: int, group: str, *order: Column | str, text: str = "text") -> DataFrame:
    """Rows while the words of those before them stay below limit; the row that crosses it is kept. words and words_before are added."""
    before = F.sum("words").over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("words", word_count(F.col(text))).withColumn("words_before", F.coalesce(before, F.lit(0))).where(F.col("words_before") < limit)


def excerpts(kept: DataFrame) -> DataFrame:
    """(doc_id, excerpt): the texts kept, in document order, joined by blanks."""
    ordered = F.array_sort(F.collect_list(F.struct("para_idx", "text")))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), " ").alias("excerpt"))


def bm25_excerpts(paragraphs: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(pair, excerpt) of queries (pair, doc_id, terms): what bm25_within, positive_or_all, within_budget and excerpts give one after the other.

    Many queries ask the same documents, so words are counted and weighed once for a document and term, and only terms that
    some query asks of the document. Queries meet weights, not texts; the texts of the paragraphs that are kept are read at the end.
    """
    doc = Window.partitionBy("doc_id")
    asked = materialize(queries.select("pair", "doc_id", F.explode("terms").alias("term")), "asked")
    some = paragraphs.join(queries.select("doc_id").distinct(), "doc_id", "left_semi")
    read = some.select("doc_id", "para_idx", "text", tokens(ranked_text(paragraphs)).alias("all"), word_count(F.col("text")).alias("words"))
    read = materialize(read.withColumn("length", F.size("all")), "read")
    sizes = read.groupBy("doc_id").agg(F.count("*").alias("n"), F.avg(F.col("length").cast("double")).alias("mean"))
    hits = read.select("doc_id", "para_idx", "length", F.explode("all").alias("term")).join(asked.select("doc_id", "term").distinct(), ["doc_id", "term"], "left_semi")
    tf = hits.groupBy("doc_id", "term", "para_idx", "length").agg(F.count("*").alias("tf")).withColumn("df", F.count("*").over(Window.partitionBy("doc_id", "term")))
    weights = tf.join(sizes, "doc_id").select("doc_id", "term", "para_idx", bm25_weight(F.col("tf"), F.col("df"), F.col("n"), F.col("length"), F.col("mean")).alias("weight"))
    scores = materialize(weights.join(asked, ["doc_id", "term"]).groupBy("pair", "doc_id", "para_idx").agg(F.sum("weight").alias("score")), "scores")
    without = queries.select("pair", "doc_id").join(scores.select("pair").distinct(), "pair", "left_anti")
    light = read.select("doc_id", "para_idx", "words")
    rows = scores.join(light, ["doc_id", "para_idx"]).unionByName(without.join(light, "doc_id").withColumn("score", F.lit(0.0)))
    before = Window.partitionBy("pair").orderBy(F.desc(F.round("score", DECIMALS)), "para_idx").rowsBetween(Window.unboundedPreceding, -1)
    kept = rows.withColumn("words_before", F.coalesce(F.sum("words").over(before), F.lit(0))).where(F.col("words_before") < limit)
    texts = kept.select("pair", "doc_id", "para_idx").join(read.select("doc_id", "para_idx", "text"), ["doc_id", "para_idx"])
    return excerpts(texts.select(F.col("pair").alias("doc_id"), "para_idx", "text")).withColumnRenamed("doc_id", "pair")
