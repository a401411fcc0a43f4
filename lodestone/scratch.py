"""Intermediate tables in the shared folder named by spark.checkpoint.dir.

A written table cuts the lineage and survives the loss of any executor, and later reads
of it prune columns, which a checkpointed RDD cannot.

Tables lie in a folder of the application, which goes when the application ends. Those that nothing reads any
more go earlier: by release(), or at the end of a `with tidy(spark)` block. A result is read lazily, so the
tables behind it stay until the application ends or clear() is called.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: What the blocks of tidy() that this thread is in have written, from the outermost.
_written: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


def scratch_dir(spark: SparkSession) -> str:
    """The application's folder. Only where all runs on one machine may spark.checkpoint.dir be unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/lodestone-scratch"
    return f"{base.rstrip('/')}/lodestone-{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    where, system = _path(spark, path)
    system.delete(where, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the scratch folder and return a frame that reads it."""
    spark = df.sparkSession
    folder = scratch_dir(spark)
    where, system = _path(spark, folder)
    system.deleteOnExit(where)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    if blocks := _written.get():
        blocks[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the tables behind frames that materialize() returned, once nothing reads them any more."""
    for df in frames:
        if path := getattr(df, "_scratch_path", None):
            _delete(df.sparkSession, path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes all tables written within the block, but for those in the list it gives out."""
    kept: list[DataFrame] = []
    outer, written = _written.get(), []
    _written.set((*outer, written))
    try:
        yield kept
    finally:
        stay = {getattr(df, "_scratch_path", None) for df in kept}
        _written.set(outer)
        if outer:
            outer[-1].extend(stay & set(written))
        for path in set(written) - stay:
            _delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables of the application; results that read them can't be read any more."""
    _delete(spark, scratch_dir(spark))
