"""Arrow batches in pieces, so that what a task makes of its input has a size of its own."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def pieces(batch: pa.RecordBatch, rows: int = 1024, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """batch in order, cut in halves until a piece has at most that many rows and bytes, or one row. Nothing is copied."""
    waiting = [batch]
    while waiting:
        part = waiting.pop()
        if len(part) > 1 and (len(part) > rows or part.nbytes > size):
            half = len(part) // 2
            waiting += [part.slice(half), part.slice(0, half)]
        elif len(part):
            yield part
