"""Packing documents into token sequences along a space-filling curve."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.scratch import materialize, release
from lodestone.llm.tokens import WordEncoder

END_ID = 2
LENGTH = 4096
#: A document vector has this many hashed dimensions; the curve has AXES axes of 2**LEVELS cells.
HASHED, AXES, LEVELS = 256, 3, 10
SEED = 20_011


def hilbert_keys(cells: np.ndarray, levels: int) -> np.ndarray:
    """Place of each row's cell on the Hilbert curve. cells: one integer below 2**levels for each axis.

    From the top bit down, an axis whose bit is set mirrors the first axis below that bit, and one whose bit
    is clear swaps these bits with it; the result, taken as a Gray code, is undone and its bits interlaced.
    """
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for level in range(levels - 1, 0, -1):
        low = (1 << level) - 1
        for k in range(axes):
            ones = (x[k] >> level) & 1 == 1
            swap = np.where(ones, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(ones, low, swap)
            x[k] ^= swap
    for k in range(1, axes):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    for level in range(levels - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(levels - 1, -1, -1):
        for k in range(axes):
            key = (key << 1) | ((x[k] >> level) & 1)
    return key


def _projection() -> np.ndarray:
    """Fixed signs that carry hashed counts to the axes."""
    return np.random.default_rng(SEED).choice([-1.0, 1.0], size=(HASHED, AXES))


def curve_key(counts: np.ndarray) -> np.ndarray:
    """Hilbert keys of rows of hashed token counts: square roots, unit length, projected, cells of equal shares if normal."""
    v = np.sqrt(counts)
    v -= v.mean(axis=1, keepdims=True)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    z = (v @ _projection()) / np.where(norm == 0, 1, norm)  # about standard normal
    share = 1 / (1 + np.exp(-1.702 * z))
    return hilbert_keys(np.minimum((share * (1 << LEVELS)).astype(np.int64), (1 << LEVELS) - 1), LEVELS)


def _encode(path: str):
    """uid, id, ids and curve key of every document, the end id included."""
    bucket = (np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.intp)
    end = np.array([END_ID], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path)
        uid = TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                ids = [encoder.encode(t or "") + end for t in batch.column(1).to_pylist()]
                counts = np.stack([np.bincount(bucket[np.frombuffer(x, "<u2")], minlength=HASHED) for x in ids]).astype(np.float64)
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(range(uid, uid + n), pa.int64()), batch.column(0).cast(pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(curve_key(counts)), pa.array(ids, pa.binary())], names=["uid", "doc_id", "n", "key", "ids"])
                uid += n

    return run


def _places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens before each document in its range of the curve; rows come in curve order."""
    part, before = TaskContext.get().partitionId(), 0
    for f in frames:
        ends = before + f.n.cumsum()
        yield pd.DataFrame({"uid": f.uid, "part": part, "before": ends - f.n, "n": f.n})
        before = int(ends.iloc[-1]) if len(f) else before


def _pieces(length: int, with_ids: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, at, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(n - start, length - offset)
                    piece = ids[start : start + size].tobytes()
                    rows.append((doc_id, start, size, zlib.crc32(piece), n, sequence, offset, piece if with_ids else None))
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, schema.types, strict=True)], schema=schema)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of token sequences: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    A document's ids are the tokenizer's and an end id. Its hashed token counts are projected to a few
    axes; documents are sorted by range along the Hilbert curve of these and laid end to end, so that
    neighbours share a sequence. Sequences are cut from that line every `length` ids, also through
    documents; only the last one of all is short. tokenizer_path is opened on the executors.

    A sequence's pieces have offsets without gaps. ids_crc32 is over little-endian unsigned 32-bit ids; ids
    holds these bytes. Null text counts as empty and gives the end id alone. A null id is carried on.
    Repeated rows are packed as often as they come, equal keys in order of a hash of the row's number.
    Other columns are ignored. An empty table gives no pieces.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = materialize(docs.mapInArrow(_encode(tokenizer_path), "uid long, doc_id long, n long, key long, ids binary"), "encoded")
    curve = encoded.select("uid", "n", "key", F.xxhash64("uid").alias("tie"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(curve.repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie").mapInPandas(_places, "uid long, part int, before long, n long"), "placed")
    # one row a range: the ranges are as many as shuffle partitions
    ranges = placed.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    first = ranges.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("first"))
    where = materialize(placed.join(F.broadcast(first), "part").select("uid", (F.col("first") + F.col("before")).alias("at")), "where")
    release(placed)
    lined = encoded.select("uid", "doc_id", "n", "ids").join(where, "uid").select("doc_id", "n", "at", "ids")
    pieces = lined.mapInArrow(_pieces(length, with_ids), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return pieces if with_ids else pieces.drop("ids")
