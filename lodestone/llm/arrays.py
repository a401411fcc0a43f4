"""Running totals over arrays as expressions, in about linear time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a part. A fold copies what it has put out at every step, so arrays are walked part by part.
PART = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is found once: inside a lambda a column's expression would be found again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, merge: Callable[[Column, Column], Column], kind: str) -> Column:
    """For each of values (an array of kind) what zero and all values before it merge to; merge is associative."""

    def before(part: Column, start: Column) -> Column:
        seed = F.struct(start.alias("now"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(part, seed, lambda acc, x: F.struct(merge(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")))["out"]

    def whole(v: Column) -> Column:
        last = F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / PART).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(v, k * PART + 1, F.lit(PART)))

    return let(values, lambda v: let(whole(v), lambda parts: F.flatten(F.zip_with(parts, before(F.transform(parts, lambda p: F.aggregate(p, zero, merge)), zero), before))))
