"""Sentences by abbreviations that are learned from the corpus.

A word that a period follows far more often than chance is an abbreviation: the log-likelihood of word and period as a collocation,
weighted for short words, inner periods and uses without a period (Kiss and Strunk, Unsupervised multilingual sentence boundary detection, 2006).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Score from which on a word is an abbreviation, and how often one is followed by a period.
LEAST, FOLLOWED = 0.3, 0.99
# Signs that may stand before and behind a word, and those that end a sentence.
OPENING, CLOSING, ENDING = "\"'“‘«([{", "\"'”’»)\\]}", ".!?…"
#: Texts that a task holds as sentences before they are columns.
TEXTS = 256
_WORD = r"^\p{L}+(\.\p{L}+)*$"


def abbreviations(texts: DataFrame, least: float = LEAST, text_col: str = "text") -> DataFrame:
    """(word, score) of the abbreviations in a column of texts, lowered and without their last period.

    Pieces between blanks are counted before they are shuffled, and signs are taken off different ones only; a vocabulary's rows are
    compared with the corpus' totals.
    """
    pieces = texts.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+")).alias("piece")).where("piece <> ''").groupBy("piece").agg(F.count("*").alias("times"))
    core = F.regexp_replace(F.regexp_replace("piece", f"^[{re.escape(OPENING)}]+", ""), f"[{CLOSING},;:]+$", "")
    rows = pieces.select(core.alias("core"), "times").select("times", F.regexp_replace("core", r"\.$", "").alias("word"), F.col("core").endswith(".").alias("dotted")).where(F.col("word").rlike(_WORD))
    counts = rows.groupBy("word").agg(F.sum("times").cast("double").alias("a"), F.sum(F.when(F.col("dotted"), F.col("times")).otherwise(0)).cast("double").alias("ab"))
    whole = counts.agg(F.struct(F.sum("a").alias("n"), F.sum("ab").alias("b"))).scalar()
    chance = F.col("whole.b") / F.col("whole.n")
    likely = lambda p: F.col("ab") * F.log(p) + (F.col("a") - F.col("ab")) * F.log(1 - p)
    dots = F.length("word") - F.length(F.translate("word", ".", ""))
    letters = (F.length("word") - dots).cast("double")
    score = 2 * (likely(F.lit(FOLLOWED)) - likely(chance)) * F.exp(-letters) * (dots + 1) * F.pow(letters, -(F.col("a") - F.col("ab")))
    return counts.where("ab > 0").withColumn("whole", whole).where("whole.b < whole.n").select("word", score.alias("score")).where(F.col("score") >= least)


#: Signs that may end a sentence, and line ends, with the white space behind them.
_STOPS = re.compile(f"[{re.escape(ENDING)}{CLOSING}\n]\\s*")
_ENDS = re.compile(f"[{re.escape(ENDING)}]+[{CLOSING}]*$")
_DOTTED = re.compile(rf"(?<!\.)\.[{CLOSING}]*$")


def _word_at(text: str, end: int, start: int) -> str:
    at = end
    while at > start and not text[at - 1].isspace():
        at -= 1
    return text[at:end]


def split(text: str, known: frozenset[str]) -> list[str]:
    """The sentences of a text as they stand, trimmed.

    A sentence ends at a sign that ends sentences, with white space behind it, and at a line's end; not behind a period of a known
    abbreviation or of a single letter, nor where small letters go on.
    """
    start = len(text) - len(text.lstrip())
    out = []
    for gap in _STOPS.finditer(text, start):
        here, behind = gap.span()
        if gap[0][0] == "\n":
            here = start + len(text[start:here].rstrip())
        elif here + 1 == behind:
            continue
        else:
            here += 1
        if behind == len(text):
            break
        if "\n" not in gap[0]:
            core = _word_at(text, here, start)
            if not _ENDS.search(core):
                continue
            if dotted := _DOTTED.search(core):
                word = core.lstrip(OPENING)[: -len(dotted[0])].lower()
                at = behind
                while text[at : at + 1] and text[at] in OPENING:
                    at += 1
                if text[at : at + 1].islower() or word in known or len(word) == 1 and word.isalpha():
                    continue
        out.append(text[start:here])
        start = behind
    return [*out, text[start:].rstrip()] if start < len(text) else out


def splitter(known: Iterable[str]) -> Callable[[Column], Column]:
    """A function from a column of texts to their sentences, for sentence_rows() and passages(). Abbreviations go to all tasks: some thousand words."""
    words = frozenset(known)

    @F.arrow_udf(ArrayType(StringType()))
    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array([split(t or "", words) for t in texts.slice(at, TEXTS).to_pylist()], pa.list_(pa.string())) for at in range(0, len(texts), TEXTS)]
        return pa.concat_arrays(parts or [pa.array([], pa.list_(pa.string()))])

    return run


def learned(texts: DataFrame, least: float = LEAST) -> Callable[[Column], Column]:
    """A splitter by the abbreviations of texts (text)."""
    return splitter(r.word for r in abbreviations(texts, least).select("word").toLocalIterator())
