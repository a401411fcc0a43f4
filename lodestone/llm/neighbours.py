"""Approximate nearest neighbours by cross-polytope hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.scratch import materialize, release

#: Hash tables, share of all their buckets that a query looks into, and sign flips with Hadamard steps of a rotation.
TABLES, PROBE_SHARE, ROUNDS = 8, 3 / 32, 3
SEED = 40_961
#: Members and queries of a bucket that are scored in one task; a larger bucket is cut into blocks of both, which all meet.
BLOCK, QUERY_BLOCK = 20_000, 5_000
#: Squared lengths of a space that differ by less than this share of their mean count as equal.
EQUAL_LENGTHS = 1e-3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the orthonormal Hadamard matrix, by sums and differences of halves; the width is a power of two."""
    n = x.shape[1]
    half = 1
    while half < n:
        pairs = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def width_of(dim: int) -> int:
    return 1 << max(1, int(dim - 1).bit_length())


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """Unit rows padded to a power of two, after a pseudo-rotation of this table."""
    width = width_of(x.shape[1])
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(ROUNDS):
        out = hadamard(out * np.random.default_rng([SEED, table, k, width]).choice([-1.0, 1.0], width))
    return out


def axis_values(x: np.ndarray, table: int) -> np.ndarray:
    """How near each row is to each signed axis: the cosine; axis a is 2a, its opposite 2a + 1."""
    y = rotated(x, table)
    return np.stack([y, -y], axis=2).reshape(len(y), -1)


def signed_axes(x: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first."""
    return np.argsort(-axis_values(x, table), axis=1, kind="stable")[:, :probes]


def probed(x: np.ndarray, tables: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables and signed axes of each row's nearest axes in all tables together: a table in which it lies between axes is asked less."""
    values = np.concatenate([axis_values(x, t) for t in range(tables)], axis=1)
    best = np.argpartition(-values, probes - 1, axis=1)[:, :probes] if probes < values.shape[1] else np.tile(np.arange(values.shape[1]), (len(x), 1))
    axes = values.shape[1] // tables
    return best // axes, best % axes


CLEAN = "uid long, vec_id long, dim int, octave int, square double, query boolean, v binary"


@dataclass(frozen=True)
class Space:
    """Vectors of one number of dimensions and of lengths within a factor of two: what is hashed together.

    By two more coordinates, members get one length and the nearest one to a query gets the smallest angle to it:
    |x - q|**2 is |q|**2 + mean - 2 * (q . x - (|x|**2 - mean) / 2), which a query extended by -scale / 2 and members
    extended by (|x|**2 - mean) / scale turn into a product of two vectors.
    """

    dim: int
    mean: float  # of squared lengths
    scale: float  # 0: all lengths are equal, and nothing is added
    most: float  # square of the length that members get

    def width(self) -> int:
        return width_of(self.dim + 2 if self.scale else self.dim)

    def members(self, x: np.ndarray) -> np.ndarray:
        if not self.scale:
            return x
        square = (x * x).sum(axis=1)
        more = (square - self.mean) / self.scale
        return np.column_stack([x, more, np.sqrt(np.maximum(0, self.most - square - more * more))])

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.full(len(x), -self.scale / 2), np.zeros(len(x))]) if self.scale else x


def _spaces(clean: DataFrame) -> dict[tuple[int, int], Space]:
    """The spaces, by dimensions and octave of lengths: one row each comes to the driver, some dozens."""
    square = F.col("square")
    rows = clean.groupBy("dim", "octave").agg(F.avg(square).alias("mean"), F.stddev_pop(square).alias("sd"), F.min(square).alias("least"), F.max(square).alias("most"))
    out = {}
    for r in rows.collect():
        scale = 0.0 if r.sd < EQUAL_LENGTHS * r.mean else math.sqrt(2 * r.sd)  # adds as much to members as to queries
        most = r.most + (max(r.most - r.mean, r.mean - r.least) / scale) ** 2 if scale else 0.0
        out[r.dim, r.octave] = Space(r.dim, r.mean, scale, most)
    return out


def _packed(v: np.ndarray) -> bytes:
    """The vector's numbers, in single precision if that changes none."""
    with np.errstate(over="ignore"):
        single = v.astype(np.float32)
    return single.tobytes() if (single == v).all() else v.tobytes()


def _unpacked(payload: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(payload, np.float32 if len(payload) == 4 * dim else np.float64).astype(np.float64)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose vector is whole, finite and not zero."""
    uid = TaskContext.get().partitionId() << 40
    for batch in batches:
        rows = []
        for vec_id, query, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if vec_id is not None and v and None not in v:
                v = np.array(v, np.float64)
                if np.isfinite(v).all() and v.any():
                    length = float(np.linalg.norm(v / np.abs(v).max()) * np.abs(v).max())
                    # octaves meet halfway between powers of two, so that lengths about 1 share one
                    rows.append((uid, vec_id, len(v), round(math.log2(length)), length * length, bool(query), _packed(v)))
            uid += 1
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        types = pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.binary()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["uid", "vec_id", "dim", "octave", "square", "query", "v"])


#: kind 0: a member, kind 1: a query; payload is the vector. A query has rows in all octaves of its dimensions.
ROWS = "dim int, octave int, tbl int, bucket int, kind int, uid long, vec_id long, payload binary"
BUCKET = ["dim", "octave", "tbl", "bucket"]


def _hashed(spaces: dict[tuple[int, int], Space], tables: int, share: float | None):
    """Rows of members (share is None) or queries (uid, vec_id, dim, octave, v) in their buckets."""
    names = [*BUCKET, "kind", "uid", "vec_id", "payload"]
    types = [pa.int32()] * 5 + [pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims, octaves = whole.column(2).to_numpy(), whole.column(3).to_numpy()
            for (dim, octave), space in spaces.items():
                here = whole.filter(pa.array((dims == dim) & (True if share else octaves == octave)))
                step = 256 if share else 2048
                for at in range(0, len(here), step):
                    batch = here.slice(at, step)
                    uid, vec_id, raw = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(4).to_pylist()
                    x = np.stack([_unpacked(v, dim) for v in raw])
                    if share:
                        table, axis = probed(space.queries(x), tables, max(1, round(share * tables * 2 * space.width())))
                    else:
                        x = space.members(x)
                        axis = np.concatenate([signed_axes(x, t, 1) for t in range(tables)], axis=1)
                        table = np.tile(np.arange(tables), (len(x), 1))
                    n, each = axis.size, axis.shape[1]
                    columns = np.full(n, dim), np.full(n, octave), table.ravel(), axis.ravel(), np.full(n, int(bool(share))), np.repeat(uid, each), np.repeat(vec_id, each), np.repeat(np.array(raw, object), each)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=names)

    return run


def _scored(k: int):
    """For each block, the k members nearest to each of its queries, ties to the smaller id. Rows come sorted by block."""
    keys = [*BUCKET, "block", "query_block"]

    def score(f: pd.DataFrame) -> pd.DataFrame:
        members, queries = f[f.kind == 0].sort_values(["vec_id", "uid"]), f[f.kind == 1]
        out = []
        if len(members) and len(queries):
            # of equal vectors the first k + 1 are enough, as a query passes over itself only
            members = members[members.groupby("payload", sort=False).cumcount() <= k]
            dim = int(f.dim.iloc[0])
            c = np.stack([_unpacked(v, dim) for v in members.payload])
            length, uid, vec_id = (c * c).sum(axis=1), members.uid.to_numpy(), members.vec_id.to_numpy()
            for at in range(0, len(queries), 256):
                part = queries.iloc[at : at + 256]
                own = part.uid.to_numpy()
                q = np.stack([_unpacked(v, dim) for v in part.payload])
                far = length - 2 * q @ c.T
                far[own[:, None] == uid] = np.inf
                nth = min(k, len(members)) - 1
                # no sum of dim products is further off than this, so no true neighbour is above the limit
                slack = 8 * (dim + 2) * np.finfo(float).eps * (length.max() + 2 * np.sqrt(length.max() * (q * q).sum(axis=1)))
                limit = np.partition(far, nth, axis=1)[:, nth] + slack
                for i in range(len(part)):
                    near = np.flatnonzero((far[i] <= limit[i]) & (uid != own[i]))
                    value = np.sqrt(((q[i] - c[near]) ** 2).sum(axis=1))
                    best = np.lexsort((uid[near], vec_id[near], value))[:k]
                    out.append((np.full(len(best), own[i]), uid[near][best], vec_id[near][best], value[best]))
        query, uid, vec_id, value = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        return pd.DataFrame({"query": query, "uid": uid, "vec_id": vec_id, "score": value})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            if not len(f):
                continue
            last = (f[keys] == f[keys].iloc[-1]).all(axis=1).to_numpy()
            rest = f[last]
            for _, g in f[~last].groupby(keys, sort=False):
                yield score(g)
        if rest is not None and len(rest):
            yield score(rest)

    return run


def _search(members: DataFrame, probes: DataFrame, sizes: DataFrame, clean: DataFrame, k: int) -> DataFrame:
    """(query, query_id, vec_id, score, rank) of the k nearest of what each query's blocks hold. sizes: (BUCKET, kind, count)."""
    cut = lambda kind, most: F.greatest(F.lit(1), F.ceil(F.max(F.when(F.col("kind") == kind, F.col("count"))) / most)).cast("int")
    blocks = sizes.groupBy(*BUCKET).agg(cut(0, BLOCK).alias("blocks"), cut(1, QUERY_BLOCK).alias("query_blocks"), F.count("*").alias("kinds")).where("kinds = 2").drop("kinds")
    own = lambda n: F.expr(f"cast(pmod(xxhash64(uid), {n}) as int)")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    dealt = members.join(blocks, BUCKET).withColumn("block", own("blocks")).withColumn("query_block", every("query_blocks"))
    asked = probes.join(blocks, BUCKET).withColumn("query_block", own("query_blocks")).withColumn("block", every("blocks"))
    keys = [*BUCKET, "block", "query_block"]
    columns = [*keys, "kind", "uid", "vec_id", "payload"]
    rows = dealt.select(*columns).union(asked.select(*columns)).repartition(*keys).sortWithinPartitions(*keys)
    near = rows.mapInPandas(_scored(k), "query long, uid long, vec_id long, score double").groupBy("query", "uid", "vec_id").agg(F.min("score").alias("score"))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return near.join(clean.where("query").select(F.col("uid").alias("query"), F.col("vec_id").alias("query_id")), "query").select("query", "query_id", "vec_id", "score", "rank")


def nearest(vectors: DataFrame, is_query, k: int = 10, tables: int = TABLES, probe_share: float = PROBE_SHARE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every query row its k nearest rows found, by Euclidean distance.

    Vectors of one number of dimensions and of lengths within a factor of two form a space, in which they are extended so
    that the nearest has the smallest angle (see Space). Each table turns vectors, scaled to unit length, by random
    signs and Hadamard steps and lists them under the signed axis nearest to them. A query looks into the buckets of
    its nearest axes in all tables together, probe_share of all, in every space.
    Every block of a bucket ranks its members by distances of the original vectors in double precision and
    passes the first k on. Ties go to the smaller id. score is the distance. Buckets of any size are
    searched whole, in blocks. A query whose buckets hold fewer than k rows searches all rows, in blocks; probe_share 1 searches
    all rows for every query.

    is_query is a condition on the rows. A row is no candidate of itself; other rows with its id are, and
    each of several query rows with one id is answered. Vectors that are null, empty, zero or hold a null or
    a value that isn't finite take no part, nor do rows with a null id. Vectors of different numbers of dimensions don't meet.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("query"), F.col(vector_col).cast("array<double>").alias("v"))
    clean = materialize(rows.mapInArrow(_clean, CLEAN), "vectors")
    spaces = _spaces(clean)
    given = ["uid", "vec_id", "dim", "octave", "v"]
    members = materialize(clean.select(*given).mapInArrow(_hashed(spaces, tables, None), ROWS), "members")
    asked = materialize(clean.where("query").select(*given).mapInArrow(_hashed(spaces, tables, probe_share), ROWS), "probes")
    every = members.select(*BUCKET, "kind").union(asked.select(*BUCKET, "kind"))
    sizes = materialize(every.groupBy(*BUCKET, "kind").count(), "sizes")  # no more rows than tables have axes
    found = materialize(_search(members, asked, sizes, clean, k), "found")

    few = clean.where("query").select(F.col("uid").alias("query"), "dim").join(found.groupBy("query").agg(F.count("*").alias("n")), "query", "left").where(F.coalesce("n", F.lit(0)) < k).select("query")
    few = materialize(few, "few")
    if few.limit(1).count():
        one = lambda df: df.where("tbl = 0").withColumn("octave", F.lit(0)).withColumn("bucket", F.lit(0))
        again = materialize(one(asked.join(few, asked.uid == few.query, "left_semi")).distinct(), "again")
        all_rows = one(members)
        whole = all_rows.union(again).groupBy(*BUCKET, "kind").count()
        found = found.join(few, "query", "left_anti").unionByName(_search(all_rows, again.select(all_rows.columns), whole, clean, k))
    else:
        release(members, asked, sizes, few)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
