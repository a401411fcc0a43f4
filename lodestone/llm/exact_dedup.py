"""Exact duplicates by progressive refinement: length, then a prefix hash, then the hash of the whole text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import materialize

PREFIX_BYTES = 64
BLANKS = b" \t\n\x0b\x0c\r"
ROWS = "uid long, doc_id long, n_points long, size long, prefix long, sha string"


def _keys(whole: bool):
    """Sizes and prefix hashes of the texts without blanks; with `whole` their SHA-256 as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            text = batch.column(1).fill_null("")
            sizes, prefixes, digests = [], [], []
            for raw in text.cast(pa.binary()).to_pylist():
                bare = raw.translate(None, BLANKS)
                sizes.append(len(bare))
                prefixes.append(xxhash.xxh3_64_intdigest(bare[:PREFIX_BYTES]) - (1 << 63))
                digests.append(hashlib.sha256(bare).hexdigest() if whole else None)
            ids = pa.array(range(uid, uid + len(sizes)), pa.int64())
            uid += len(sizes)
            yield pa.RecordBatch.from_arrays([ids, batch.column(0).cast(pa.int64()), pc.utf8_length(text).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.int64()), pa.array(digests, pa.string())], names=["uid", "doc_id", "n_points", "size", "prefix", "sha"])

    return run


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return materialize(rows.groupBy(*keys).count().where("count > 1").select(*keys), "repeated")


def exact_duplicates(docs: DataFrame, digest_all: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Texts are equal when identical without blanks and the controls 9 to 13. Of equal texts the row with
    the most code points stays, then the smallest id; of repeated rows with one id, one stays. The first
    scan takes only lengths and prefix hashes; rows whose length and prefix no other row has are done.
    Only the others' texts are read again and hashed whole. With digest_all, for callers that want every
    text's SHA-256, the first scan hashes all texts and no second one is needed; else text_sha256 is null
    where refinement ended earlier.

    Null text counts as empty, so null and blank texts are one group. A null id sorts last among ids; if
    such a row stays, keep_id is null. Other columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(docs.mapInArrow(_keys(digest_all), ROWS), "rows")
    sizes = _repeated(rows, "size")
    prefixes = _repeated(rows.join(sizes, "size", "left_semi"), "size", "prefix")
    single = rows.join(prefixes, ["size", "prefix"], "left_anti")
    if digest_all:
        full = rows.join(prefixes, ["size", "prefix"])
    else:
        again = materialize(rows.join(prefixes, ["size", "prefix"]).select(F.coalesce("doc_id", F.lit(-(1 << 62))).alias("again")).distinct(), "again")
        read = docs.join(again, F.coalesce(docs.doc_id, F.lit(-(1 << 62))) == again.again).select("doc_id", "text")
        full = materialize(read.mapInArrow(_keys(True), ROWS), "full").join(prefixes, ["size", "prefix"])
    rank = F.struct("n_points", (-F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("late"), (-F.col("uid")).alias("last"))
    best = materialize(full.groupBy("size", "prefix", "sha").agg(F.max(rank).alias("best"), F.count("*").alias("group_size"), F.max_by("doc_id", rank).alias("keep_id")), "best")
    grouped = full.join(best, ["size", "prefix", "sha"]).select("doc_id", "keep_id", "group_size", (F.col("best.last") == -F.col("uid")).alias("kept"), F.col("sha").alias("text_sha256"))
    alone = single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    return grouped.union(alone)
