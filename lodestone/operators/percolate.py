"""Many stored conditions over many papers: which paper meets which condition.

A condition that asks for words can only hold where one of a few of its words stands: of operands that must all hold the rarest one's,
of alternatives each one's. These words are a hash table that the words of a paper look themselves up in, and only the conditions found there are
evaluated. Conditions go to all tasks a block at a time; papers are never shuffled. A task evaluates thousands of conditions for thousands of papers at once:
those papers that have a word, or two next to each other, are the bits of a row of numbers, and an operator that many conditions share is one on many such rows.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lodestone.functions.batches import pieces
from lodestone.operators import search as S
from lodestone.operators.querytext import Leaf, program
from lodestone.scratch import materialize

Steps = list[tuple[str, int, Leaf | None]]
#: Different conditions that are looked up in one pass over the papers, and rows of them with equal ones.
BLOCK, ROWS = 65_536, 131_072
#: Papers that conditions are evaluated for at once, the bytes of their texts, of sets of papers at once, and pairs of a part of the result.
PAPERS, PAPER_BYTES, PART, PAIRS = 8192, 16 << 20, 1 << 20, 1 << 20
#: Kinds of operands that look at texts.
TEXTS = ("phrase", "wildcard")
#: One of so many papers is read for how common words are, which decides what is looked up, not what is found.
SAMPLED = 64


def positive_words(steps: Steps) -> list[str]:
    """The words of text operands that are not negated, each once, in order."""
    found: list[str] = []
    sign, waiting = True, []
    # backwards, each operator comes before its operands
    for op, n, leaf in reversed(steps):
        while waiting and not waiting[-1][0]:
            waiting.pop()
        if waiting:
            waiting[-1][0] -= 1
            sign = waiting[-1][1]
        if op == "term":
            if sign and leaf.kind == "phrase":
                found.append(leaf.value)
        elif n:
            waiting.append([n, sign if op != "not" else not sign])
    return list(dict.fromkeys(w for value in reversed(found) for w in value.split()))


def needed_words(steps: Steps, common: Counter) -> set[str] | None:
    """Words of which every paper that meets the condition has one, the rarest choice; None if it can be met without any."""
    stack: list[tuple[float, set[str] | None]] = []
    for op, n, leaf in steps:
        parts = [stack.pop() for _ in range(n)]
        if op == "term" and leaf.kind == "phrase":
            stack.append(min(((common[w] + 1, {w}) for w in leaf.value.split()), key=lambda x: x[0], default=(0, set())))
        elif op == "nothing":
            stack.append((0, set()))
        elif op == "and":
            stack.append(min(parts, key=lambda x: x[0]))
        elif op == "or" and all(p[1] is not None for p in parts):
            stack.append((sum(p[0] for p in parts), set().union(*(p[1] for p in parts))))
        else:
            stack.append((math.inf, None))
    return stack[0][1]


def answerable(programs: Iterable[Steps], has: list[str]) -> bool:
    """Whether papers with these columns have one for each field."""
    return all(c.partition(".")[0] in has for _, _, leaf in itertools.chain.from_iterable(programs) if leaf for c in leaf.columns)


def columns_of(programs: Iterable[Steps], has: list[str]) -> dict[str, Column]:
    """What the conditions read of papers with these columns, by name: texts as search.normal() has them, other values as they are compared."""
    out: dict[str, Column] = {}
    # a column for each of what is read, not for each of many operands
    for kind, c in dict.fromkeys((leaf.kind, c) for _, _, leaf in itertools.chain.from_iterable(programs) if leaf for c in leaf.columns):
        key, _, section = c.partition(".")
        if key not in has:
            raise ValueError(f"there is nothing to look for {c} in")
        value = F.element_at(F.col(key), section) if section else F.col(key)
        if kind in TEXTS:
            out[f"text {c}"] = S.normal(value)
        elif kind in ("flag", "one", "year"):
            out[f"{kind} {c}"] = {"flag": F.coalesce(value, F.lit(False)), "one": F.upper(value.cast("string")), "year": value.try_cast("int")}[kind]
        else:
            out[f"{kind} {c}"] = value.cast("date").cast("string") if kind == "date" else value
    return out


def _holds(leaf: Leaf, paper: dict) -> bool:
    if leaf.kind == "phrase":
        return bool(leaf.value) and any(f" {leaf.value} " in paper[f"text {c}"] for c in leaf.columns)
    if leaf.kind == "wildcard":
        return any(re.search(leaf.value, paper[f"text {c}"]) for c in leaf.columns)
    value = paper[f"{leaf.kind} {leaf.columns[0]}"]
    if leaf.kind == "flag":
        return value == (leaf.value == "Y")
    if value is None:
        return False
    if leaf.kind == "one":
        return value == leaf.value
    end = str if leaf.kind == "date" else int
    return (leaf.first is None or value >= end(leaf.first)) and (leaf.last is None or value <= end(leaf.last))


def _bits(places: np.ndarray | list[int], n: int) -> np.ndarray:
    """A set of papers as a row of numbers, of whose n bits those at places are set."""
    flags = np.zeros(-(-n // 64) * 64, bool)
    flags[places] = True
    return np.packbits(flags, bitorder="little").view("<u8")


def _members(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each bit that is set in rows of sets, in order."""
    width = rows.shape[1]
    some = np.flatnonzero(rows)
    bits = np.unpackbits(rows.ravel()[some].view(np.uint8), bitorder="little")
    at = np.flatnonzero(bits.view(bool))
    row, word = np.divmod(some, max(1, width))
    number = at >> 6
    return row[number], word[number] * 64 + (at & 63)


class _AskedOf:
    """Words, and pairs of words next to each other, that are looked for in a column of texts, numbered from first on."""

    def __init__(self, words: set[str], pairs: set[tuple[str, str]], first: int):
        self.first = first
        words = sorted(words)
        number = {w: i for i, w in enumerate(words)}
        self.known = pa.array(words, pa.string())
        #: Pairs as one number each, in order.
        self.pairs = np.array(sorted(number[a] * len(words) + number[b] for a, b in pairs), np.int64)
        self.leading, self.following = (np.isin(np.arange(len(words)), part) for part in np.divmod(self.pairs, max(1, len(words))))
        self.end = first + len(words) + len(self.pairs)

    def numbers(self) -> dict[str | tuple[str, str], int]:
        """The numbers of all words and pairs."""
        words = self.known.to_pylist()
        pairs = ((words[k // len(words)], words[k % len(words)]) for k in self.pairs.tolist())
        return {x: self.first + i for i, x in enumerate(itertools.chain(words, pairs))}

    def standing_in(self, texts: list | pa.Array, n: int) -> np.ndarray:
        """number * n + place of each word and pair that one of the n texts has, in order, texts as search.normal() has them: the blanks at their ends part them."""
        split = pc.split_pattern(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, " ")
        found = pc.index_in(split.flatten(), self.known)
        at = np.flatnonzero(pc.is_valid(found).to_numpy(zero_copy_only=False))
        word = pc.drop_null(found).to_numpy(zero_copy_only=False).astype(np.int64)
        text = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)[at]
        out = [_different((word + self.first) * n + text)]
        if len(self.pairs):
            near = np.flatnonzero((np.diff(at) == 1) & self.leading[word[:-1]] & self.following[word[1:]])
            key = word[near] * len(self.known) + word[near + 1]
            pair = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            asked = self.pairs[pair] == key
            out.append(_different((pair[asked] + self.first + len(self.known)) * n + text[near[asked]]))
        return np.concatenate(out)


def _different(keys: np.ndarray) -> np.ndarray:
    """Each of the keys once, in order."""
    keys = np.sort(keys)
    return keys[np.diff(keys, prepend=-1) != 0]


class _Shape:
    """Conditions of the same operators, side by side: their numbers, the sets that each operand stands for, and those of which a paper needs one."""

    def __init__(self, ops: tuple[tuple[str, int], ...], rows: list[tuple[int, list[int], list[int]]]):
        self.ops = ops
        self.numbers = np.array([k for k, _, _ in rows], np.int64)
        self.operands = np.array([operands for _, operands, _ in rows], np.int32).reshape(len(rows), -1)
        self.needed = np.array(list(itertools.chain.from_iterable(needed for _, _, needed in rows)), np.int32)
        self.ends = np.cumsum([0, *(len(needed) for _, _, needed in rows)])

    def parts(self, row_of: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Which conditions have a needed word at all, a part of at most PART bytes of sets at a time, and the rows of the words that each needs one of, listed with where those of a condition begin."""
        rows = row_of[self.needed]
        alive = np.flatnonzero(np.logical_or.reduceat(rows > 0, self.ends[:-1]))
        step = max(1, PART // (8 * width))
        for some in (alive[i : i + step] for i in range(0, len(alive), step)):
            yield some, rows

    def some(self, which: np.ndarray, rows: np.ndarray, sets: np.ndarray) -> np.ndarray:
        """For each of these conditions the papers that have a word it needs."""
        out = sets[rows[self.ends[which]]]
        more = np.diff(self.ends)[which]
        for i in range(1, int(more.max(initial=0))):
            left = np.flatnonzero(more > i)
            out[left] |= sets[rows[self.ends[which[left]] + i]]
        return out


class Percolator:
    """Conditions by number, ready to be looked up by papers."""

    def __init__(self, programs: dict[int, Steps], common: Counter):
        leaves: dict[Leaf, int] = {leaf: 0 for steps in programs.values() for _, _, leaf in steps if leaf}
        asked: dict[str, tuple[set, set]] = defaultdict(lambda: (set(), set()))
        for leaf in leaves:
            if leaf.kind == "phrase":
                words = leaf.value.split()
                for c in leaf.columns:
                    words_of, pairs_of = asked[f"text {c}"]
                    words_of.update(words)
                    pairs_of.update(itertools.pairwise(words))
        #: Words, and pairs of words, that are looked for in each column of texts. Each has a number, as has each other operand; set 0 is empty, 1 has all papers.
        self.asked: dict[str, _AskedOf] = {}
        n = 2
        for name, some in asked.items():
            self.asked[name] = _AskedOf(*some, n)
            n = self.asked[name].end
        numbers = {name: some.numbers() for name, some in self.asked.items()}
        #: Operands that are not a word or a pair of words in one column, from number first on: the words and pairs of each column that they can't do without, and whether these are enough.
        self.others: list[tuple[Leaf, list[list[int]] | None, bool]] = []
        self.first_other = n
        for leaf in leaves:
            words = leaf.value.split() if leaf.kind == "phrase" else []
            parts = words if len(words) < 2 else list(itertools.pairwise(words))
            if leaf.kind == "phrase" and not words:
                continue
            within = [[numbers[f"text {c}"][x] for x in parts] for c in leaf.columns] if leaf.kind == "phrase" else None
            if within and len(within) == len(within[0]) == 1:
                leaves[leaf] = within[0][0]
            else:
                leaves[leaf] = n + len(self.others)
                self.others.append((leaf, within, 0 < len(words) < 3))
        self.n_sets = n + len(self.others)
        shapes: dict[tuple, list] = defaultdict(list)
        for k, steps in programs.items():
            #: Words of which a paper that meets a condition has one; None if it can do without.
            needed = needed_words(steps, common)
            sets = [1] if needed is None else [known[w] for w in sorted(needed) for known in numbers.values() if w in known]
            shapes[tuple((op, n) for op, n, _ in steps)].append((k, [leaves[leaf] for _, _, leaf in steps if leaf], sets or [0]))
        self.shapes = [_Shape(ops, rows) for ops, rows in shapes.items()]
        #: How often a condition was evaluated for a paper.
        self.evaluated = 0

    def _sets(self, columns: dict[str, list | pa.Array], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of n papers the sets that have each word and pair, and the row of each number's set; row 0 is empty, and row 1 has all. The last rows are left for other operands."""
        width = -(-n // 64)
        keys = np.concatenate([np.zeros(0, np.int64), *(some.standing_in(columns[name], n) for name, some in self.asked.items())])
        number, place = np.divmod(keys, n)
        begins = np.diff(number, prepend=-1) != 0
        found = number[begins]
        row_of = np.zeros(self.n_sets, np.int32)
        row_of[1] = 1
        row_of[found] = np.arange(2, 2 + len(found))
        row_of[self.first_other :] = np.arange(2 + len(found), 2 + len(found) + len(self.others))
        sets = np.zeros((2 + len(found) + len(self.others), width), "<u8")
        sets[1] = _bits(np.arange(n), n)
        at = row_of[number].astype(np.int64) * width + (place >> 6)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        if len(first):
            sets.ravel()[at[first]] = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (place & 63).astype(np.uint64)), first)
        return sets, row_of

    def _hold(self, columns: dict[str, list | pa.Array], n: int, sets: np.ndarray, row_of: np.ndarray) -> None:
        """Fills the rows of other operands, for the papers that a condition with such an operand may still be met by."""
        may = np.zeros((len(self.others), sets.shape[1]), "<u8")
        for shape in self.shapes:
            special = [j for j in range(shape.operands.shape[1]) if shape.operands[:, j].max() >= self.first_other]
            for which, rows in shape.parts(row_of, sets.shape[1]) if special else ():
                some = shape.some(which, rows, sets)
                for j in special:
                    other = shape.operands[which, j] - self.first_other
                    for k in np.unique(other[other >= 0]):
                        may[k] |= np.bitwise_or.reduce(some[other == k], axis=0)
        for k, (leaf, within, enough) in enumerate(self.others):
            row = row_of[self.first_other + k]
            if within is not None:
                may[k] &= functools.reduce(operator.or_, (functools.reduce(operator.and_, (sets[row_of[x]] for x in parts)) for parts in within))
            if enough or not may[k].any():
                sets[row] = may[k]
                continue
            read = [(name, columns[name]) for name in (f"{'text' if leaf.kind in TEXTS else leaf.kind} {c}" for c in leaf.columns)]
            places = _members(may[k : k + 1])[1]
            sets[row] = _bits([i for i in places.tolist() if _holds(leaf, {name: c[i].as_py() if isinstance(c, pa.Array) else c[i] for name, c in read})], n)

    def found(self, columns: dict[str, list | pa.Array], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(conditions, the sets of papers that meet each), a part at a time, of n papers whose columns (see columns_of) are given."""
        if not n or not self.shapes:
            return
        sets, row_of = self._sets(columns, n)
        self._hold(columns, n, sets, row_of)
        for shape in self.shapes:
            for which, rows in shape.parts(row_of, sets.shape[1]):
                some = shape.some(which, rows, sets)
                self.evaluated += int(np.bitwise_count(some).sum())
                stack: list[np.ndarray] = []
                operands = iter(row_of[shape.operands[which]].T)
                for op, n_parts in shape.ops:
                    if op == "term":
                        stack.append(sets[next(operands)])
                    elif op == "nothing":
                        stack.append(np.zeros_like(some))
                    elif op == "not":
                        stack[-1] ^= sets[1]
                    else:
                        parts, stack = stack[-n_parts:], stack[:-n_parts]
                        for other in parts[1:]:
                            (np.bitwise_and if op == "and" else np.bitwise_or)(parts[0], other, out=parts[0])
                        stack.append(parts[0])
                some &= stack[0]
                yield shape.numbers[which], some

    def meeting(self, columns: dict[str, list | pa.Array], n: int) -> Iterator[tuple[int, np.ndarray]]:
        """(condition, places of the papers that meet it) in order, of n papers whose columns (see columns_of) are given. Conditions that none meets are passed over."""
        met = []
        for numbers, sets in self.found(columns, n):
            some = np.flatnonzero(sets.any(axis=1))
            met += zip(numbers[some].tolist(), sets[some], strict=True)
        yield from ((k, _members(bits[None, :])[1]) for k, bits in sorted(met, key=lambda x: x[0]))

    def matches(self, paper: dict) -> list[int]:
        """The conditions that a paper (see columns_of) meets, in order."""
        return [k for k, _ in self.meeting({name: [value] for name, value in paper.items()}, 1)]


def read_columns(batch: pa.RecordBatch, names: Sequence[str], at: int) -> dict[str, list | pa.Array]:
    """What conditions read of a batch, from column number at: values as Python's, texts as they are, since few are looked at one by one."""
    columns = {name: batch.column(at + i) for i, name in enumerate(names)}
    return {name: c if name.startswith("text ") else c.to_pylist() for name, c in columns.items()}


def sampled(papers: DataFrame) -> DataFrame:
    return papers.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0)


def common_words(papers: DataFrame, columns: dict[str, Column], asked: set[str]) -> Counter:
    """In how many of a sample of papers each asked word stands, for conditions that read these columns."""
    texts = [c for name, c in columns.items() if name.startswith("text ")]
    if not texts or not asked:
        return Counter()
    words = F.array_distinct(F.split(F.concat(*texts), " +"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            counts.update(w for row in batch.column(0).to_pylist() for w in asked.intersection(row))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    some = sampled(papers).select(words.alias("words"))
    return Counter({r.word: r.n for r in some.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()})  # a row an asked word of this block


def asked_words(programs: dict[int, Steps]) -> set[str]:
    return {w for steps in programs.values() for _, _, leaf in steps if leaf and leaf.kind == "phrase" for w in leaf.value.split()}


def percolator(papers: DataFrame, programs: dict[int, Steps]) -> tuple[Percolator, dict[str, Column]]:
    """The conditions, and what they read of papers."""
    columns = columns_of(programs.values(), papers.columns)
    return Percolator(programs, common_words(papers, columns, asked_words(programs))), columns


def _blocks(rows: Iterable[Row]) -> Iterator[dict[str, list]]:
    """Ids by query text, of rows whose equal texts follow on one another."""
    block: dict[str, list] = {}
    n = 0
    for r in rows:
        text = r["query"] or ""
        if n == ROWS or len(block) == BLOCK and text not in block:
            yield block
            block, n = {}, 0
        block.setdefault(text, []).append(r["query_id"])
        n += 1
    if block:
        yield block


def _cut(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of parts of at most that size together, or of one."""
    total = np.cumsum(sizes)
    a = 0
    while a < len(total):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _pairs(found: Iterable[tuple[np.ndarray, np.ndarray]], ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of conditions' rows, of papers) in parts of at most PAIRS, of sets of papers (see Percolator.found); the rows of condition k end at ends[k + 1]."""
    waiting, held = [], 0
    for numbers, sets in found:
        for a, b in _cut(np.bitwise_count(sets).sum(axis=1, dtype=np.int64), PAIRS):
            row, place = _members(sets[a:b])
            first = ends[numbers[a:b]]
            same = ends[numbers[a:b] + 1] - first
            for c, d in _cut(same[row], PAIRS) if (same > 1).any() else [(0, len(row))]:
                n = same[row[c:d]]
                begin = np.cumsum(n) - n
                query = np.repeat(first[row[c:d]] - begin, n) + np.arange(n.sum()) if (n > 1).any() else first[row[c:d]]
                if held and held + len(query) > PAIRS:
                    yield tuple(map(np.concatenate, zip(*waiting, strict=True)))
                    waiting, held = [], 0
                waiting.append((query, np.repeat(place[c:d], n)))
                held += len(query)
    if held:
        yield tuple(map(np.concatenate, zip(*waiting, strict=True)))


def percolate(papers: DataFrame, conditions: DataFrame) -> DataFrame:
    """(query_id, doc_id) for each of papers (doc_id, ...) that meets one of conditions (query_id, query).

    Query texts as in querytext.py; one with a fault or with a field that papers have no column for raises a ValueError. Conditions come to the
    driver and go to the tasks in blocks of BLOCK texts, with one pass over the papers for each block; equal texts are evaluated once.
    What several blocks read of papers is written once, as is the sample of them, and pairs leave a task in parts of at most PAIRS.
    """
    spark = papers.sparkSession
    key, doc = conditions.schema["query_id"].dataType, papers.schema["doc_id"].dataType
    blocks = _blocks(conditions.select("query_id", "query").repartition("query").sortWithinPartitions("query").toLocalIterator(prefetchPartitions=True))
    written: dict[tuple[str, ...], tuple[DataFrame, DataFrame]] = {}
    out, block = None, next(blocks, None)
    while block:
        after = next(blocks, None)
        programs = {k: program(text) for k, text in enumerate(block)}
        columns = dict(sorted(columns_of(programs.values(), papers.columns).items()))
        names = tuple(columns)
        if names not in written and not (wider := [x for x in written if set(names) <= set(x)]):
            read = papers.select("doc_id", *(c.alias(name) for name, c in columns.items()))
            read = materialize(read, "percolated") if after else read
            written[names] = read, materialize(sampled(read), "sampled") if after else read
        read, some = (x.select("doc_id", *(F.col(f"`{name}`") for name in names)) for x in written[names if names in written else wider[0]])
        ids = spark.createDataFrame([(i,) for same in block.values() for i in same], StructType([StructField("query_id", key)])).toArrow().column(0).combine_chunks()
        ends = np.cumsum([0, *map(len, block.values())])
        stored = Percolator(programs, common_words(some, {name: F.col(f"`{name}`") for name in names}, asked_words(programs)))

        def run(batches: Iterator[pa.RecordBatch], stored=stored, names=names, ids=ids, ends=ends) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in pieces(whole, PAPERS, PAPER_BYTES):
                    for query, place in _pairs(stored.found(read_columns(batch, names, 1), len(batch)), ends):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), batch.column(0).take(pa.array(place))], names=["query_id", "doc_id"])

        part = read.mapInArrow(run, StructType([StructField("query_id", key), StructField("doc_id", doc)]))
        out = part if out is None else out.union(part)
        block = after
    return out if out is not None else spark.createDataFrame([], StructType([StructField("query_id", key), StructField("doc_id", doc)]))
