"""Ranked lexical search by branch and bound over document FP-trees.

Documents become vectors of the terms that some item asks, most frequent term first. Range-sorted by these vectors, documents that
begin alike are neighbours: a run of neighbours with a common prefix is a node of a trie, so a task builds its tries from
sorted rows alone, a block at a time. The largest tf of each term and the least m below a node bound every score below it, and
items whose k-th best score lies above the bound skip the node.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lodestone.llm.words import text_chunks, word_bounds, word_hashes
from lodestone.scratch import materialize, release

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Items for which the corpus is read once; of these, items that are looked up together in one pass over the vectors.
ITEM_BLOCK, TOGETHER = 4096, 256
#: Bytes of texts that are cut into words at once.
AT_ONCE = 1 << 18
#: Documents of a trie, and of a node below which documents are scored one by one.
TRIE, LEAF = 8192, 4
#: Bytes of a path by which documents are dealt over tasks (four a term), so that what Spark samples of them stays small.
DEALT = 32

_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


class Asked:
    """Terms that can be found in texts: by hash, then byte for byte."""

    def __init__(self, terms: list[str]):
        self.size = len(terms)
        data, offsets = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        if terms:
            data = np.frombuffer("".join(terms).encode(), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in terms])])
        hashes = word_hashes(data, offsets[:-1], offsets[1:])
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        if len(np.unique(self.hashes)) < len(terms):
            raise RuntimeError("two terms have one hash")
        self.data, self.first, self.length = data, offsets[:-1], np.diff(offsets)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are asked, and as which term."""
        if not self.size or not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = word_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.size - 1)
        word = np.flatnonzero(self.hashes[at] == hashes)
        term = self.order[at[word]]
        same = ends[word] - starts[word] == self.length[term]
        word, term = word[same], term[same]
        size = self.length[term]
        equal = _FOLD[data[_ranges(starts[word], size)]] == self.data[_ranges(self.first[term], size)]
        if not equal.all():
            wrong = np.unique(np.repeat(np.arange(len(word)), size)[~equal])
            word, term = np.delete(word, wrong), np.delete(term, wrong)
        return word, term


def _term_counts(asked: Asked):
    """doc_id, n (all terms) and the asked terms' numbers and counts, of documents that have a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max(1, asked.size)
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column(1), AT_ONCE):
                starts, ends, at = word_bounds(data, offsets, _IN_TERM)
                word, term = asked.find(data, starts, ends)
                key, times = np.unique((np.searchsorted(at, word, "right") - 1) * width + term, return_counts=True)
                n = np.diff(at)
                some = np.flatnonzero(n)
                bounds = np.searchsorted(key, some * width)  # rows without a term have no keys between
                bounds = np.append(bounds, len(key)).astype(np.int32)
                listed = lambda x: pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + some)), pa.array(n[some].astype(np.int64)), listed(key % width), listed(times)], names=["doc_id", "n", "ids", "times"])

    return run


def _vectors(place: np.ndarray, n_docs: int, n_terms: int):
    """doc_id, m, path (places of the terms, ascending, as big-endian bytes) and times, of documents that have a term with a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            row = pc.list_parent_indices(ids).to_numpy(zero_copy_only=False).astype(np.int64)
            at = place[ids.flatten().to_numpy(zero_copy_only=False)]
            times = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            order = np.lexsort((at, row))
            order = order[at[order] >= 0]
            row, at, times = row[order], at[order], times[order]
            some, first = np.unique(row, return_index=True)
            bounds = np.append(first, len(row)).astype(np.int32) * 4
            binary = lambda x: pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(x.tobytes())])
            m = 50 + 50 * batch.column(1).to_numpy(zero_copy_only=False)[some] * n_docs // n_terms
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(m), binary(at.astype(">u4")), binary(times.astype("<u4"))], names=["doc_id", "m", "path", "times"])

    return run


class _Last:
    """An id in reverse order, null before all, so that a heap gives up the last id among equal scores first."""

    __slots__ = ("id",)

    def __init__(self, id_):
        self.id = id_

    def __lt__(self, other: _Last) -> bool:
        if self.id is None or other.id is None:
            return self.id is None and other.id is not None
        return other.id < self.id


@dataclass
class Best:
    """The k best documents of each item so far, and the score that a document needs to be one of them."""

    items: int
    k: int
    heaps: list = field(init=False)
    least: np.ndarray = field(init=False)
    #: Documents scored and nodes skipped for all items, for tests.
    scored: int = 0
    skipped: int = 0

    def __post_init__(self):
        self.heaps = [[] for _ in range(self.items)]
        self.least = np.ones(self.items, np.int64)

    def offer(self, item: int, score: int, id_) -> None:
        heap = self.heaps[item]
        if len(heap) < self.k:
            heapq.heappush(heap, (score, _Last(id_)))
        elif heap[0] < (entry := (score, _Last(id_))):
            heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.least[item] = heap[0][0]


def _shares(tf: np.ndarray, m) -> np.ndarray:
    """What a term adds to a score for each unit of its weight; grows with tf, falls with m."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def search_trie(weights: np.ndarray, ids: list, m: np.ndarray, bounds: np.ndarray, term: np.ndarray, tf: np.ndarray, best: Best) -> None:
    """Offer best all documents of a trie that may be among an item's best.

    weights: terms by items. Document i has terms term[bounds[i]:bounds[i + 1]], ascending; documents are sorted by
    them. A node is a range of documents with a common prefix; its children part where prefixes are shortest.
    """
    lists = [term[a:b] for a, b in itertools.pairwise(bounds)]
    common = np.zeros(max(0, len(lists) - 1), np.int64)
    for i, (a, b) in enumerate(itertools.pairwise(lists)):
        n = min(len(a), len(b))
        differ = a[:n] != b[:n]
        common[i] = differ.argmax() if differ.any() else n
    top = np.zeros(len(weights), np.int64)
    waiting = [(0, len(lists), np.arange(best.items))]
    while waiting:
        lo, hi, items = waiting.pop()
        a, b = bounds[lo], bounds[hi]
        if hi - lo > 1:
            np.maximum.at(top, term[a:b], tf[a:b])
            some = np.flatnonzero(top)
            bound = _shares(top[some], m[lo:hi].min()) @ weights[np.ix_(some, items)]
            top[some] = 0
            items = items[bound >= best.least[items]]
            if not len(items):
                best.skipped += 1
                continue
        if hi - lo <= LEAF:
            for i in range(lo, hi):
                best.scored += 1
                a, b = bounds[i], bounds[i + 1]
                score = _shares(tf[a:b], m[i]) @ weights[np.ix_(term[a:b], items)]
                for j in np.flatnonzero(score >= best.least[items]):
                    best.offer(int(items[j]), int(score[j]), ids[i])
            continue
        inner = common[lo : hi - 1]
        cuts = [lo, *(lo + 1 + np.flatnonzero(inner == inner.min())), hi]
        waiting += [(x, y, items) for x, y in reversed([*itertools.pairwise(cuts)])]


def _best_of_task(items: list[np.ndarray], weight: np.ndarray, k: int):
    """(item, doc_id, score): the k best documents of a task for each item, given as places of its terms."""
    used = np.unique(np.concatenate(items)) if items else np.zeros(0, np.int64)
    row_of = np.full(len(weight), -1)
    row_of[used] = np.arange(len(used))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((len(used), len(items)), np.int64)
        for j, places in enumerate(items):
            weights[row_of[places], j] = weight[places]
        best, kind = Best(len(items), k), None
        for whole in batches:
            kind = whole.schema.field(0).type
            for at in range(0, len(whole), TRIE):
                batch = whole.slice(at, TRIE)
                paths = batch.column(2).to_pylist()
                order = sorted(range(len(paths)), key=paths.__getitem__)  # read from several files, rows may lie out of order
                batch = batch.take(pa.array(order))
                size = np.array([len(paths[i]) // 4 for i in order])
                term = row_of[np.frombuffer(b"".join(paths[i] for i in order), ">u4").astype(np.int64)]
                tf = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u4").astype(np.int64)
                doc = np.repeat(np.arange(len(order)), size)[term >= 0]
                bounds = np.searchsorted(doc, np.arange(len(order) + 1))
                search_trie(weights, batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False), bounds, term[term >= 0], tf[term >= 0], best)
        rows = [(j, entry[1].id, entry[0]) for j, heap in enumerate(best.heaps) for entry in heap]
        if rows:
            item, doc_id, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc_id, kind), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return run


def _answered(docs: DataFrame, block: list[Row], k: int) -> DataFrame:
    """(item, doc_id, score) of the best documents of each task, for a block of items (item_id, terms) by number."""
    asked = sorted({t for r in block for t in r.terms})
    number = {t: i for i, t in enumerate(asked)}
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.mapInArrow(_term_counts(Asked(asked)), f"doc_id {kind}, n long, ids array<int>, times array<int>")
    counted = materialize(counted, "term_counts")
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(asked), np.int64)
    for r in counted.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # a row a term of this block
        df[r["id"]] = r["count"]
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    # most frequent first; terms in no document, and those that weigh nothing, have no place
    order = np.argsort(-df, kind="stable")
    order = order[(df[order] > 0) & (weight[order] > 0)]
    place = np.full(len(asked), -1)
    place[order] = np.arange(len(order))
    vectors = counted.mapInArrow(_vectors(place, n_docs, max(1, n_terms)), f"doc_id {kind}, m long, path binary, times binary")
    # by path, then id: a path that many documents share is spread over tasks
    vectors = materialize(vectors.repartitionByRange(F.substring("path", 1, DEALT), "doc_id").sortWithinPartitions("path"), "vectors")
    release(counted)
    out = None
    for first in range(0, len(block), TOGETHER):
        items = [place[[number[t] for t in r.terms]] for r in block[first : first + TOGETHER]]
        items = [x[x >= 0] for x in items]
        found = vectors.mapInArrow(_best_of_task(items, weight[order], k), f"item int, doc_id {kind}, score long")
        found = found.withColumn("item", F.col("item") + first)
        out = found if out is None else out.union(found)
    return out


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of docs (doc_id, text) for each row of items (item_id, text), of those that score.

    Terms are the maximal runs of digits, letters and characters beyond ASCII in whole texts, A-Z lowered. With N documents that
    have a term, L terms in them with repeats, n those of a document and df documents that hold a term, a term weighs
    w = floor(1000 ln((2N + 2) / (2df + 1))), a document has m = 50 + 50nN div L, and its score is the sum of
    w * (10^9 tf div (1000 tf + 20m)) over an item's distinct terms. Equal scores go to the smaller doc_id, null last.

    The corpus is tokenised once for 4,096 items. Their terms go to all tasks, and one number a term comes to the driver. A
    task returns its k best documents of each item. Null or empty texts have no terms: such documents don't count, such
    items get no rows. Repeated rows are documents of their own, and items of their own. Other columns are ignored.
    """
    spark = docs.sparkSession
    lowered = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = items.select("item_id", F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("terms")).where(F.size("terms") > 0).toLocalIterator()
    out = None
    id_field = items.schema["item_id"]
    while block := list(itertools.islice(rows, ITEM_BLOCK)):
        found = _answered(docs.select("doc_id", "text"), block, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(block)], StructType([StructField("item", ranked.schema["item"].dataType), StructField("item_id", id_field.dataType)]))
        part = ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], StructType([id_field, StructField("rank", IntegerType()), docs.schema["doc_id"], StructField("score", LongType())]))
    return out
