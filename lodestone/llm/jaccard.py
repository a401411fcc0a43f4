"""Exact Jaccard self-join of documents on five-word shingles.

Documents with one shingle set form a class. A class is listed under the shingles of its prefix: the
rarest quarter in a global order, so that two sets similar enough must share one. Lists are in order of size and cut where
sizes are too far apart; those that have one
first member are put together as a tile. Within a tile, a member is compared with those in the size band that
the threshold leaves: hashed bitmaps of a width that follows the band bound the overlap from above, and
sorted shingle arrays are intersected where the bound allows a link.

Small bitmaps come first and rule out members that can link to no other of their tile; only the rest have
their texts read again. A tile then decides every link of its members and returns their numbers, and of the links themselves those
that join its members, at most one a member: a large group of near copies makes no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components
from lodestone.scratch import materialize, release
from lodestone.llm.words import shingle_sets

#: Shingles that go to the end of the global order, at most. Any order gives the same links.
COMMON_SHINGLES = 1 << 16
#: Shingles that a task counts together, and the count that makes one a candidate for the list above.
COUNT_SPAN, COUNT_LEAST = 2_000_000, 3
#: Members and shingles of a tile that are held together; a larger tile is cut into pairs of blocks.
BLOCK_MEMBERS, BLOCK_SHINGLES = 4096, 2_000_000
#: Bits a shingle of the bitmaps that travel, and of those made from the texts in a task.
SMALL_BITS, LARGE_BITS = 2, 16


def _set_id(grams: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh3_64_digest(grams.tobytes()), ">i8")[0])


def _bitmap(grams: np.ndarray, per_shingle: int) -> bytes:
    """Bits at the hashes' low bits; per_shingle bits a shingle or up to twice as many, so that the size is a power of two."""
    bits = max(64, 1 << int(per_shingle * len(grams) - 1).bit_length())
    hit = np.zeros(bits, bool)
    hit[grams & np.uint64(bits - 1)] = True
    return np.packbits(hit, bitorder="little").tobytes()


#: Bits of the filter that keeps texts which can't be asked for out of the shuffle; it is no more than that, whatever the input.
FILTER_BITS = 1 << 24

SUMMARY = "kind int, doc_id long, n_shingles long, cls long, bitmap binary, gram long, cnt long"


def _summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: a document's set size, class and bitmap; kind 1: shingles that this task sees again and again."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64()), ("bitmap", pa.binary()), ("gram", pa.int64()), ("cnt", pa.int64())])
    held: list[np.ndarray] = []
    seen: set[int] = set()
    total = 0

    def flush() -> pa.RecordBatch:
        grams, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= COUNT_LEAST
        grams, counts = grams[often], counts[often]
        none = pa.nulls(len(grams), pa.int64())
        held.clear()
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(grams), np.int32)), none, none, none, pa.nulls(len(grams), pa.binary()), pa.array(grams.view(np.int64)), pa.array(counts)], schema=schema)

    for batch in batches:
        sizes, ids, maps = [], [], []
        for _, grams in shingle_sets(batch.column(1)):
            sizes.append(len(grams))
            ids.append(_set_id(grams) if len(grams) else None)
            maps.append(_bitmap(grams, SMALL_BITS) if len(grams) else None)
            if len(grams) and ids[-1] not in seen:
                seen.add(ids[-1])
                held.append(grams)
                total += len(grams)
                if total >= COUNT_SPAN:
                    yield flush()
                    total = 0
        n = len(sizes)
        none = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(maps, pa.binary()), none, none], schema=schema)
    if held:
        yield flush()


LISTED = "gram long, size int, cls long"


def _prefixes(common: np.ndarray, percent: int):
    """(gram, size, cls): each class listed under the shingles of its prefix, once for some million rows of a task."""
    common_sorted = np.sort(common)
    place = np.argsort(common)  # of each sorted shingle in the list, which goes from most to least common

    def prefix(grams: np.ndarray) -> np.ndarray:
        n = len(grams)
        keep = n - -(-percent * n // 100) + 1
        if not len(common_sorted):
            return grams[:keep]
        at = np.minimum(np.searchsorted(common_sorted, grams), len(common_sorted) - 1)
        hot = common_sorted[at] == grams
        rare = grams[~hot]
        if len(rare) >= keep:
            return rare[:keep]
        late = grams[hot][np.argsort(-place[at[hot]])]
        return np.concatenate([rare, late[: keep - len(rare)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, set()
        for batch in batches:
            held = []
            for _, grams in shingle_sets(batch.column(0)):
                if not len(grams):
                    continue
                cls = _set_id(grams)
                if cls not in seen:
                    seen.add(cls)
                    held.append((cls, len(grams), prefix(grams)))
            if held:
                count = [len(x[2]) for x in held]
                gram = np.concatenate([x[2] for x in held]).view(np.int64)
                size, cls = (np.repeat(np.array([x[k] for x in held], t), count) for k, t in ((1, np.int32), (0, np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(size), pa.array(cls)], names=["gram", "size", "cls"])
                total += len(gram)
            if total >= 4_000_000:
                total, seen = 0, set()

    return run


def _listed(percent: int):
    """(tile, cls) of list members that have another one in their size band. Rows come sorted by gram, size and cls.

    A list is cut where a size is too small for the next one; a tile is named by the first member of such a stretch.
    Of a list of any length only the last row is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # gram, size, cls, tile and whether the row before belongs to it

        def rows(tile: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((cls, tile))
            tile, cls = tile[order], cls[order]
            new = np.append(True, (tile[1:] != tile[:-1]) | (cls[1:] != cls[:-1])) if len(tile) else np.zeros(0, bool)
            return pa.RecordBatch.from_arrays([pa.array(tile[new]), pa.array(cls[new])], names=["tile", "cls"])

        for batch in batches:
            gram, size, cls = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            if not len(gram):
                continue
            if last:
                gram, size, cls = (np.append(x, y) for x, y in zip(last[:3], (gram, size, cls), strict=True))
            same = gram[1:] == gram[:-1]
            new = np.append(True, ~(same & (cls[1:] == cls[:-1])))  # else a copy of the class before
            gram, size, cls = gram[new], size[new], cls[new]
            joins = np.append(False, (gram[1:] == gram[:-1]) & (100 * size[:-1] >= percent * size[1:]))
            name = cls.copy()
            if last:
                joins[0], name[0] = last[4], last[3]
            starts = ~joins
            starts[0] = True
            tile = name[np.maximum.accumulate(np.where(starts, np.arange(len(cls)), 0))]
            keep = joins[:-1] | joins[1:]
            yield rows(tile[:-1][keep], cls[:-1][keep])
            last = gram[-1], size[-1], cls[-1], tile[-1], bool(joins[-1])
        if last and last[4]:
            yield rows(np.array([last[3]], np.int64), np.array([last[2]], np.int64))

    return run


def _apart(maps: list[np.ndarray], percent: int, sizes: np.ndarray):
    """For members sorted by size: a function of i that gives the later members which may link to it.

    maps are the members' bitmaps as 64-bit words. Members within the size band of i have bitmaps of i's
    width or a multiple of it; wider ones are folded. The bits in which two bitmaps differ come from as many
    elements of one set alone, or more.
    """
    widths = np.array([len(m) for m in maps])
    stop = np.searchsorted(sizes, 100 * sizes // percent, "right")
    tables: dict[int, tuple[int, np.ndarray]] = {}

    def later(i: int) -> np.ndarray:
        w = int(widths[i])
        if w not in tables:
            tables.clear()
            a, b = int(np.searchsorted(widths, w)), int(stop[np.searchsorted(widths, w, "right") - 1])
            tables[w] = a, np.stack([m if len(m) == w else np.bitwise_or.reduce(m.reshape(-1, w), axis=0) for m in maps[a:b]])
        a, table = tables[w]
        if stop[i] <= i + 1:
            return np.zeros(0, np.int64)
        apart = np.bitwise_count(table[i + 1 - a : stop[i] - a] ^ table[i - a]).sum(axis=1, dtype=np.int64)
        most = (sizes[i] + sizes[i + 1 : stop[i]] - apart) // 2
        return i + 1 + np.flatnonzero(100 * most >= percent * (sizes[i] + sizes[i + 1 : stop[i]] - most))

    return later


def _by_tile(work, schema: pa.Schema):
    """Runs work on the rows of each tile and pair of blocks; rows come sorted by these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def done():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(work(pa.Table.from_batches(held)), schema.types, strict=True)], schema=schema)

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b == a:
                    continue
                if held and key != tuple(keys[a]):
                    yield done()
                    held.clear()
                key = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield done()

    return run


def _hopeful(percent: int):
    """Members that may link to another one of the tile, by their small bitmaps."""

    def work(t: pa.Table) -> tuple:
        t = t.sort_by("n_shingles")
        sizes, block = t["n_shingles"].to_numpy(), t["block"].to_numpy()
        later = _apart([np.frombuffer(m, np.uint64) for m in t["bitmap"].to_pylist()], percent, sizes)
        across = t["i_block"][0].as_py() != t["j_block"][0].as_py()
        hope = np.zeros(len(sizes), bool)
        for i in range(len(sizes)):
            j = later(i)
            if across:
                j = j[block[j] != block[i]]
            if len(j):
                hope[i] = hope[j] = True
        return tuple(t[k].combine_chunks().filter(pa.array(hope)) for k in ("tile", "i_block", "j_block", "block", "cls", "rep", "copies"))

    return _by_tile(work, pa.schema([("tile", pa.int64()), ("i_block", pa.int32()), ("j_block", pa.int32()), ("block", pa.int32()), ("cls", pa.int64()), ("rep", pa.int64()), ("copies", pa.int64())]))


def _overlaps(sets: list[np.ndarray]):
    """A function of i and members j that gives the sizes of i's intersections with them."""
    ends = np.cumsum([len(x) for x in sets])
    starts = ends - [len(x) for x in sets]
    distinct, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(distinct), np.int32)

    def overlaps(i: int, j: np.ndarray) -> np.ndarray:
        mark[flat[starts[i] : ends[i]]] = 1
        a, b = j[0], j[-1] + 1
        if 4 * len(j) >= b - a:  # most of a stretch: all of it at once
            both = np.add.reduceat(mark[flat[starts[a] : ends[b - 1]]], starts[a:b] - starts[a])[j - a]
        else:
            both = np.array([mark[flat[starts[k] : ends[k]]].sum() for k in j])
        mark[flat[starts[i] : ends[i]]] = 0
        return both

    return overlaps


def _joined(percent: int, count_links: bool):
    """Decides on the texts which members of a tile link.

    Rows with b are links (a, b) that join all that are joined, at most one a member. Rows without b, if asked for, hold how many other
    classes and documents a links with. Two classes may meet in several tiles; the one of the least name counts their link.
    """

    def work(t: pa.Table) -> tuple:
        sets = [next(shingle_sets(pa.array([zstandard.decompress(x)], pa.binary())))[1] for x in t["packed"].to_pylist()]
        order = np.argsort([len(s) for s in sets], kind="stable")
        sets = [sets[k] for k in order]
        sizes, cls, block, copies = np.array([len(s) for s in sets]), *(t[k].to_numpy()[order] for k in ("cls", "block", "copies"))
        later = _apart([np.frombuffer(_bitmap(s, LARGE_BITS), np.uint64) for s in sets], percent, sizes)
        overlaps = _overlaps(sets)
        across, tile = t["i_block"][0].as_py() != t["j_block"][0].as_py(), t["tile"][0].as_py()
        tiles = t["tiles"].to_pylist()
        before = [[x for x in tiles[k] if x < tile] for k in order]  # other tiles that count first
        having: dict[int, list[int]] = {}
        for i, names in enumerate(before):
            for x in names:
                having.setdefault(x, []).append(i)
        having = {x: np.array(i) for x, i in having.items()}
        root = np.arange(len(sets))
        a, b, n, docs = [], [], np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
        for i in range(len(sets)):
            j = later(i)
            if across:
                j = j[block[j] != block[i]]
            if not count_links:
                j = j[root[j] != root[i]]
            if not len(j):
                continue
            both = overlaps(i, j)
            j = j[100 * both >= percent * (sizes[i] + sizes[j] - both)]
            for r, k in zip(*np.unique(root[j], return_index=True), strict=True):
                if r != root[i]:
                    a.append(cls[i])
                    b.append(cls[j[k]])
                    root[root == r] = root[i]
            if count_links:
                mine = np.zeros(len(sets), bool)
                mine[j] = True
                for x in before[i]:
                    mine[having[x]] = False
                j = np.flatnonzero(mine)
                n[i] += len(j)
                docs[i] += copies[j].sum()
                n[j] += 1
                docs[j] += copies[i]
        some = np.flatnonzero(n)
        none = len(a) * [None]
        return [*a, *cls[some].tolist()], [*b, *len(some) * [None]], [*none, *n[some].tolist()], [*none, *docs[some].tolist()]

    return _by_tile(work, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("docs", pa.int64())]))


def _asked_for(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(cls, packed): the compressed texts of the classes and ids in needed (cls, doc_id), once for each row.

    One bit of a filter of a fixed size stands for each id, so most other texts are dropped in the scan. The class is found from the text, as
    an id may stand for several texts. All in one step of Python, so that a task keeps one worker.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    marks = needed.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {FILTER_BITS}) % 64 as int))").alias("bit"))
    words = np.zeros(FILTER_BITS // 64, np.int64)
    for r in marks.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        words[r.word] = r.bits
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value.view(np.uint8)
        for batch in batches:
            at = batch.column(2).to_numpy()
            some = batch.filter(pa.array(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1))
            cls = [_set_id(g) if len(g) else None for _, g in shingle_sets(some.column(1))]
            packed = [zstandard.compress(x, 3) for x in some.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), some.column(0), pa.array(packed, pa.binary())], names=["cls", "doc_id", "packed"])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), place.alias("place")).where("doc_id is not null")
    return texts.mapInArrow(run, "cls long, doc_id long, packed binary").join(needed, ["cls", "doc_id"], "left_semi").select("cls", "packed")


def _common_shingles(seen: DataFrame) -> np.ndarray:
    """The most common shingles, from most to least: all with counts from some step of a logarithmic scale on, COMMON_SHINGLES at most.

    One row a step comes to the driver, then the chosen shingles.
    """
    counts = materialize(seen.groupBy("gram").agg(F.sum("cnt").alias("cnt")).withColumn("step", F.floor(F.log2("cnt") * 8)), "common")
    total, least = 0, None
    for step, n in counts.groupBy("step").count().orderBy(F.desc("step")).collect():
        total += n
        if total > COMMON_SHINGLES:
            break
        least = step
    chosen = [] if least is None else counts.where(F.col("step") >= least).select("cnt", "gram").collect()
    release(counts)
    return np.array([r.gram for r in sorted(chosen, key=lambda r: (-r.cnt, r.gram))], np.int64).view(np.uint64)


def jaccard_components(docs: DataFrame, percent: int = 75, count_links: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate components of documents: (doc_id, n_shingles, class_id, component_id, class_links, n_links), one row per input row.

    Words are runs of anything but blanks and the controls 9 to 13, with A-Z lowered. A text of one to
    four words has its whole word sequence as its only shingle. Two documents link when
    100 * |A and B| >= percent * |A or B|. component_id is the smallest id reachable by links, the
    document's own included; class_id is the smallest id with the document's shingle set. class_links is the number of other sets that link with
    the document's, n_links that of other rows: those of these sets and of its own. Without count_links both are
    null, and sets that are joined already are not compared.

    percent is 1 to 100, else a ValueError is raised.
    Null or blank text: an empty set, linked with nothing, component_id and class_id are the own id. Null id: the row
    is returned with its size, null for both ids, and links nothing. Repeated rows are returned as
    often as they come. Other columns are ignored. An empty table gives an empty result.

    Shingles and classes are 64-bit hashes; at 10**11 texts a few unrelated classes of one size could meet.
    """
    if not 1 <= percent <= 100:
        raise ValueError(f"percent must be 1 to 100, not {percent}")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    summary = materialize(docs.mapInArrow(_summarize, SUMMARY), "summary")
    light = summary.where("kind = 0")
    named = light.where("cls is not null and doc_id is not null")
    classes = materialize(named.groupBy("cls", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("bitmap").alias("bitmap")), "classes")
    common = _common_shingles(summary.where("kind = 1"))

    lists = docs.where("doc_id is not null").select("text").mapInArrow(_prefixes(common, percent), LISTED)
    listed = materialize(lists.repartition("gram").sortWithinPartitions("gram", "size", "cls").mapInArrow(_listed(percent), "tile long, cls long"), "listed")
    tiles = listed.distinct().join(classes, "cls")
    large = tiles.groupBy("tile").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("total")).where(f"members > {BLOCK_MEMBERS} or total > {BLOCK_SHINGLES}")
    blocks = F.expr(f"cast(ceil(greatest(members / {BLOCK_MEMBERS}, total / {BLOCK_SHINGLES})) as int)")
    large = materialize(large.select("tile", blocks.alias("blocks")), "large")
    members = tiles.join(large, "tile", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = members.withColumn("block", F.expr("cast(pmod(xxhash64(cls), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    members = members.select("tile", F.least("block", "other").alias("i_block"), F.greatest("block", "other").alias("j_block"), "block", "cls", "rep", "copies", "n_shingles", "bitmap")
    keys = ["tile", "i_block", "j_block"]
    dealt = lambda df: df.repartition(*keys).sortWithinPartitions(*keys)
    hopeful = materialize(dealt(members).mapInArrow(_hopeful(percent), "tile long, i_block int, j_block int, block int, cls long, rep long, copies long"), "hopeful")

    needed = materialize(hopeful.select("cls", F.col("rep").alias("doc_id")).distinct(), "needed")
    texts = materialize(_asked_for(docs, needed), "texts")
    one_text = texts.groupBy("cls").agg(F.min("packed").alias("packed"))  # an id may come again with a text of its class
    read = hopeful.drop("rep").join(one_text.hint("merge"), "cls")  # texts are never broadcast
    tiles_of = hopeful.groupBy("cls").agg(F.collect_set("tile").alias("tiles"))
    read = read.join(tiles_of.hint("merge"), "cls").select(*keys, "block", "cls", "copies", "tiles", "packed")
    joins = materialize(dealt(read).mapInArrow(_joined(percent, count_links), "a long, b long, n long, docs long"), "joins")
    release(listed, large, hopeful, needed, texts)

    roots = connected_components(joins.where("b is not null"))
    found = classes.select("cls", "rep", "copies").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = found.groupBy("root").agg(F.min("rep").alias("component_id"))
    counts = joins.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    groups = found.join(least, "root").join(counts, "cls", "left").select("cls", "rep", "component_id", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("docs"))
    groups = materialize(groups, "groups")
    release(classes, joins, roots)
    out = light.select("doc_id", "n_shingles", "cls").join(groups, "cls", "left")
    id_of = lambda c: F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce(c, "doc_id"))
    links = lambda c: F.when(F.lit(count_links), F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce(c, F.lit(0)))).cast("long")
    return out.select("doc_id", "n_shingles", id_of("rep").alias("class_id"), id_of("component_id").alias("component_id"), links("n").alias("class_links"), links("docs").alias("n_links"))
