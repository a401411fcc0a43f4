"""The same checks and rankings on documents and queries as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.validation import clause_messages, clauses
from lodestone.sources.articles import article_paragraphs


def checked_clauses(queries: DataFrame) -> DataFrame:
    """Clauses of a stream of queries (query_id, query) with what is wrong with each; no state is held."""
    return clause_messages(clauses(queries)).select("query_id", "pos", "field", "bare", "messages")


def arriving_paragraphs(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Appends paragraphs of article XML files (doc_id, xml as Parquet) in folder to a table, each file once."""
    articles = spark.readStream.schema("doc_id long, xml string").parquet(folder)
    rows = article_paragraphs(articles)
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table)


def first_hits(hits: DataFrame, wait_seconds: int) -> DataFrame:
    """(question_id, paper_id, query_idx, rank) of a stream of hits (question_id, paper_id, query_idx, rank, seen: timestamp): each paper's first hit by (query_idx, rank).

    evidence.first_wins() on arriving hits. What is known of a paper is kept until wait_seconds behind its first hit are over for all of the stream, then it is put
    out, once, and forgotten. Hits that come later than that are dropped.
    """
    kinds = {c: hits.schema[c].dataType.simpleString() for c in ("question_id", "paper_id")}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            query_idx, rank, _ = state.get
            state.remove()
            yield pd.DataFrame({"question_id": [key[0]], "paper_id": [key[1]], "query_idx": [query_idx], "rank": [rank]})
            return
        best = tuple(state.get) if state.exists else None
        for f in frames:
            for query_idx, rank, seen in zip(f.query_idx, f["rank"], f.seen):
                at = int(seen.timestamp() * 1000)
                if at < state.getCurrentWatermarkMs():
                    continue
                first = (int(query_idx), int(rank))
                best = (*min(first, best[:2] if best else first), min(at, best[2]) if best else at)
        if best is None:
            return
        state.update(best)
        state.setTimeoutTimestamp(max(best[2] + wait_seconds * 1000, state.getCurrentWatermarkMs() + 1))

    rows = hits.withWatermark("seen", f"{wait_seconds} seconds").groupBy("question_id", "paper_id")
    return rows.applyInPandasWithState(step, f"question_id {kinds['question_id']}, paper_id {kinds['paper_id']}, query_idx int, rank int", "query_idx int, rank int, at long", "append", GroupStateTimeout.EventTimeTimeout)
