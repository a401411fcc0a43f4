"""Passages for people and for programs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(passages: DataFrame) -> DataFrame:
    """(question_id, final_pos, line): `[position] title (year) id` and the evidence, indented."""
    head = F.format_string("[%d] %s (%s) %s", F.col("final_pos").cast("int"), "title", "year", "paper_id")
    body = F.array_join(F.transform("evidence", lambda e: F.concat(F.lit("\n    "), e)), "")
    return passages.select("question_id", "final_pos", F.concat(head, body).alias("line"))


def as_json(passages: DataFrame) -> DataFrame:
    """(question_id, passages): the passages of each question as one JSON array, in order."""
    rest = [c for c in passages.columns if c not in ("question_id", "final_pos")]
    ordered = F.array_sort(F.collect_list(F.struct("final_pos", *rest)))
    return passages.groupBy("question_id").agg(F.to_json(ordered).alias("passages"))
