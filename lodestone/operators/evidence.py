"""Candidates, sentences, evidence spans and the final merge. Every order is an explicit column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import all_tokens, sentence_suffix, sentences, word_count, words


def first_wins(hits: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each combination of keys, by order. It is an aggregate, so copies meet before the shuffle."""
    rest = [c for c in hits.columns if c not in (*keys, *order)]
    best = hits.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("best"))
    return best.select(*keys, "best.*")


def candidate_order(hits: DataFrame, group: str, *order: str) -> DataFrame:
    """hits with cand_pos, their place from 1 within the group."""
    return hits.withColumn("cand_pos", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def batches(candidates: DataFrame, size: int) -> DataFrame:
    """candidates with batch, runs of size in their order."""
    return candidates.withColumn("batch", F.floor((F.col("cand_pos") - 1) / size).cast("long"))


def sentence_rows(texts: DataFrame, key: str = "doc_id", split: Callable[[Column], Column] = sentences) -> DataFrame:
    """(key, sent_idx, sentence, sid) of texts (key, text)."""
    rows = texts.select(key, F.posexplode(split(F.coalesce(F.col("text"), F.lit("")))).alias("sent_idx", "sentence"))
    return rows.withColumn("sid", F.concat(F.col(key).cast("string"), F.lit("_"), sentence_suffix(F.col("sent_idx"))))


def lexical_judge(rows: DataFrame, terms: Column, least: int = 1) -> DataFrame:
    """Sentences that hold `least` distinct query terms or more, with their count as hits: the default for a relevance judge.

    terms has no stop words, so sentences needn't lose theirs.
    """
    return rows.withColumn("hits", F.size(F.array_intersect(all_tokens(F.col("sentence")), terms))).where(F.col("hits") >= least)


def span_ids(cited: DataFrame, group: str = "doc_id") -> DataFrame:
    """cited (group, sent_idx, sentence) with span: sentences whose places follow on one another share one.

    A repeated place opens a span as a gap does.
    """
    order = Window.partitionBy(group).orderBy("sent_idx")
    follows = F.coalesce(F.col("sent_idx") == F.lag("sent_idx").over(order) + 1, F.lit(False))
    return cited.withColumn("opens", F.when(follows, 0).otherwise(1)).withColumn("span", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def spans(numbered: DataFrame, group: str = "doc_id") -> DataFrame:
    """(group, span, text) of the sentences of each span, joined by blanks."""
    ordered = F.array_sort(F.collect_list(F.struct("sent_idx", "sentence")))
    return numbered.groupBy(group, "span").agg(F.array_join(F.transform(ordered, lambda s: s["sentence"]), " ").alias("text"))


def truncated(texts: DataFrame, limit: int, group: str = "doc_id") -> DataFrame:
    """Spans cut to limit words a group: whole ones first, the one that crosses to the words left, later ones dropped."""
    order = Window.partitionBy(group).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    rows = texts.withColumn("words", word_count(F.col("text"))).withColumn("left", F.lit(limit) - F.coalesce(F.sum("words").over(order), F.lit(0)))
    cut = F.when(F.col("words") <= F.col("left"), F.col("text")).otherwise(F.array_join(F.slice(words(F.col("text")), F.lit(1), F.greatest(F.col("left"), F.lit(0)).cast("int")), " "))
    return rows.where("left > 0").select(group, "span", cut.alias("text"))


def span_lists(texts: DataFrame, group: str = "doc_id") -> DataFrame:
    """(group, spans): the texts in order as one array."""
    return texts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda s: s["text"]).alias("spans"))


def two_pools(candidates: DataFrame, group: str, full_cap: int = 30, abstract_cap: int = 30) -> DataFrame:
    """candidates with pool and pool_rank: 0 those that full_text accepts, 1 those without an excerpt that abstract accepts, each capped in order.

    full_order and abstract_order are the places that the two judges give, null where they reject.
    """
    full = candidates.where("full_order is not null").withColumn("pool", F.lit(0)).withColumn("pool_order", F.col("full_order"))
    brief = candidates.where("not has_excerpt and full_order is null and abstract_order is not null").withColumn("pool", F.lit(1)).withColumn("pool_order", F.col("abstract_order"))
    rank = F.row_number().over(Window.partitionBy(group, "pool").orderBy("pool_order", "cand_pos"))
    return full.unionByName(brief).withColumn("pool_rank", rank).where((F.col("pool_rank") <= full_cap) & (F.col("pool") == 0) | (F.col("pool_rank") <= abstract_cap) & (F.col("pool") == 1))


def or_all_candidates(merged: DataFrame, candidates: DataFrame, group: str) -> DataFrame:
    """merged, and for groups of which nothing is left all their candidates as pool 2, so that a filter never empties a result."""
    lost = candidates.join(merged.select(group).distinct(), group, "left_anti").withColumn("pool", F.lit(2)).withColumn("pool_order", F.col("cand_pos").cast("long")).withColumn("pool_rank", F.col("cand_pos"))
    return merged.unionByName(lost)


def final_order(merged: DataFrame, group: str, k: int) -> DataFrame:
    """The first k of each group with final_pos: pool by pool."""
    return merged.withColumn("final_pos", F.row_number().over(Window.partitionBy(group).orderBy("pool", "pool_rank"))).where(F.col("final_pos") <= k)
