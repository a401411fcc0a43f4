"""Repeated passages, found by winnowing over line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.scratch import materialize, release

MIN_WORDS = 50
#: Rows of a batch that go back to Spark at once.
ROWS = 20_000

POSITIONS = "doc_id long, text_hash long, line int, mark long, starts int, place int, around binary, lines binary, words binary"
_POSITIONS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("line", pa.int32()), ("mark", pa.int64()), ("starts", pa.int32()), ("place", pa.int32()), ("around", pa.binary()), ("lines", pa.binary()), ("words", pa.binary())])
RUNS = "doc_id long, text_hash long, lo int, hi int, mark long, digest long"
_RUNS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("mark", pa.int64()), ("digest", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _first_starts(total: np.ndarray, min_words: int) -> np.ndarray:
    """For each line, the last line from which min_words words are reached with it; -1 if none is."""
    return np.searchsorted(total, total[1:] - min_words, "right") - 1


def _minima(value: list[int], stop: list[int]) -> list[int]:
    """The least line hash of each window i to stop[i] - 1, the last one of equals."""
    out, at, seen = [], -1, 0
    for i, e in enumerate(stop):
        if at < i:
            at, seen = i, i + 1
        for k in range(seen, e):
            if value[k] <= value[at]:
                at = k
        seen = max(seen, e)
        out.append(at)
    return out


def _positions(min_words: int):
    """One row for each line that is the least of some window: a text's fingerprints.

    A window is the fewest lines from a line on that hold min_words words. mark is the hash of the least line, line its number, starts
    how many windows, one line further on each, have it. around holds the hashes of the lines from the first of these
    windows' starts (place lines before) to the end of the last run of interest: of these windows and of the shortest runs
    backwards to their starts. lines and words are these lines' numbers and word counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), strict=True):
                number, count, hashed = [], [], []
                for k, line in enumerate(text.as_py().split(b"\n")):
                    if words := line.split():
                        number.append(k)
                        count.append(len(words))
                        hashed.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
                if sum(count) < min_words:
                    continue
                total = np.concatenate([[0], np.cumsum(count)])
                stop = np.searchsorted(total, total[:-1] + min_words)  # words of lines i to stop - 1 reach min_words
                stop = stop[stop <= len(count)]
                back = _first_starts(total, min_words)
                reach = np.maximum(stop, np.searchsorted(back, np.arange(len(stop)), "right"))  # end of the longest run from each start
                least = np.array(_minima(hashed, stop.tolist()))
                value, where, size = np.array(hashed, np.uint64), np.array(number, np.int32), np.array(count, np.int32)
                opens = np.flatnonzero(np.diff(least, prepend=-1)).tolist()
                for i, j in zip(opens, [*opens[1:], len(least)], strict=True):
                    p, e = int(least[i]), int(reach[j - 1])
                    rows.append((doc_id, text_hash, number[p], int(value[p].astype(np.int64)), j - i, p - i, value[i:e].tobytes(), where[i:e].tobytes(), size[i:e].tobytes()))
                if len(rows) >= ROWS:
                    yield _batch(rows, _POSITIONS)
                    rows = []
        yield _batch(rows, _POSITIONS)

    return run


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the first numbers are equal."""
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    return int(apart[0]) if len(apart) else n


def _extend(min_words: int):
    """Extends each position both ways along the first one with its mark.

    A run of min_words words or more that is equal around both gives a row with a null digest. The runs of interest that
    stick out of it, which other positions may share, each give a row with their digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for doc_id, text_hash, mark, starts, place, around, lines, words, first, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, other = np.frombuffer(around, np.uint64), np.frombuffer(first, np.uint64)
                line, total = np.frombuffer(lines, np.int32), np.concatenate([[0], np.cumsum(np.frombuffer(words, np.int32), dtype=np.int64)])
                lo = place - _same(own[:place][::-1], other[:at][::-1])
                hi = place + _same(own[place:], other[at:])
                if total[hi] - total[lo] >= min_words:
                    rows.append((doc_id, text_hash, int(line[lo]), int(line[hi - 1]), mark, None))
                else:
                    lo = hi = -1
                if lo == 0 and hi == len(own):
                    continue
                back = _first_starts(total, min_words)
                for i, e in enumerate(np.searchsorted(total, total[:starts] + min_words).tolist()):
                    a, b = np.searchsorted(back, [i, i + 1])
                    for end in {e, *range(int(a) + 1, int(b) + 1)}:
                        if not lo <= i < end <= hi:
                            rows.append((doc_id, text_hash, int(line[i]), int(line[end - 1]), mark, xxhash.xxh3_64_intdigest(around[8 * i : 8 * end]) - (1 << 63)))
                if len(rows) >= ROWS:
                    yield _batch(rows, _RUNS)
                    rows = []
        yield _batch(rows, _RUNS)

    return run


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with later copies of repeated passages cut out of the text, and n_lines, removed_lines, removed_words.

    A passage is a run of whole lines with min_words words or more. Lines are equal when their words are;
    lines without words are passed over. A line goes if it lies in a passage that also stands earlier, in order of id, hash of the
    text and line. A passage that repeats within one document leaves its first period.

    Winnowing: a window is the fewest lines from a line on that hold min_words words, and its least line hash is a
    fingerprint. Two equal passages share a window and so a fingerprint at the same place; only lines that are the
    least of a window are stored. Positions are joined by fingerprint, each with the first of all, and the match
    is extended both ways. Where runs around a position go beyond that match, as a common line stands in many
    contexts, they are looked up by their digest among the others with this fingerprint, so that every earlier copy
    counts and no pairs are made. The runs that can matter are windows and, for ends of passages, the shortest runs backwards.

    Null text stays null, with zero counts. Rows with a null id stay as they are and are not compared.
    Rows with one id and the same text are one document and lose the same lines; different texts of one id are
    different documents. All columns of docs are kept in order; three columns are added, and take the place of
    columns of the same names.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "removed_lines", "removed_words")]
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    known = F.col(f"`{id_col}`").cast("long")
    texts = docs.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    positions = materialize(texts.select(known, F.xxhash64(f"`{text_col}`"), F.col(f"`{text_col}`")).mapInArrow(_positions(min_words), POSITIONS), "positions")
    at = F.struct("doc_id", "text_hash", "line")
    first = positions.groupBy("mark").agg(F.min(at).alias("first"), F.min_by(F.struct("around", "place"), at).alias("there"), F.count("*").alias("times"))
    first = materialize(first.where("times > 1").select("mark", "first", F.col("there.around").alias("first_around"), F.col("there.place").alias("first_place")), "first")
    # merge joins at any size: neither side is one to broadcast, as both grow with the input
    later = positions.join(first.hint("merge"), "mark").where(at > F.col("first"))
    later = later.select("doc_id", "text_hash", "mark", "starts", "place", "around", "lines", "words", "first_around", "first_place")
    extended = materialize(later.mapInArrow(_extend(min_words), RUNS), "extended")
    open_runs, at = extended.where("digest is not null"), F.struct("doc_id", "text_hash", "lo")
    again = open_runs.groupBy("mark", "digest").agg(F.min(at).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    found = open_runs.join(again.hint("merge"), ["mark", "digest"]).where(at > F.col("first"))
    runs = extended.where("digest is null").union(found.select(extended.columns)).groupBy("doc_id", "text_hash", "lo").agg(F.max("hi").alias("hi"))
    # runs that overlap or touch become one span
    order = Window.partitionBy("doc_id", "text_hash").orderBy("lo")
    opens = F.when(F.col("lo") > F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 1, 1).otherwise(0)
    islands = runs.withColumn("opens", opens).withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("doc_id", "text_hash", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spans = spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("__spans"))
    spans = materialize(spans.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__spans"), "spans")
    release(positions, first, extended)

    cut = docs.join(spans.hint("merge"), (known == F.col("__id")) & (F.xxhash64(f"`{text_col}`") == F.col("__hash")), "left")
    text, whole = F.col(f"`{text_col}`"), F.col("__spans").isNull()
    lines = F.split(text, "\n", -1)
    opens = F.concat(F.array(F.lit(0)), F.transform("__spans", lambda s: s["hi"] + 1))
    closes = F.concat(F.transform("__spans", lambda s: s["lo"]), F.array(F.size(lines)))
    stay = F.flatten(F.zip_with(opens, closes, lambda a, b: F.slice(lines, a + 1, F.greatest(b - a, F.lit(0)))))
    gone = F.flatten(F.transform("__spans", lambda s: F.slice(lines, s["lo"] + 1, s["hi"] - s["lo"] + 1)))
    words = F.size(F.filter(F.split(F.array_join(F.col("__gone"), " "), r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))
    cut = cut.withColumn("__gone", F.when(whole, F.array().cast("array<string>")).otherwise(gone)).withColumn("__left", F.when(whole, text).otherwise(F.array_join(stay, "\n")))
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    return cut.select(
        *(F.col("__left").alias(c) if c == text_col else F.col(f"`{c}`") for c in names),
        n_lines.cast("long").alias("n_lines"),
        F.size("__gone").cast("long").alias("removed_lines"),
        F.when(F.size("__gone") > 0, words).otherwise(0).cast("long").alias("removed_words"),
    )

