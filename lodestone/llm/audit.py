"""What every order of five filters removes, step by step, from counts of failure masks alone.

A document is known by its mask, the set of filters that it fails; an order removes it at the first of them. The
orders that do so at a given step share a prefix (filters that it passes, then one that it fails), and orders with a common
prefix are neighbours in lexicographic order. So a mask adds its count where such an interval of ranks begins and
takes it off where it ends, and a sum along the ranks gives all orders at once.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.scratch import materialize

FILTERS = "ABCDE"
ORDERS = factorial(len(FILTERS))
WORD = r"[^\x20\x09-\x0D]+"
#: Partitions over which rows without an id are dealt.
SALTS = 1024


def rank_of(prefix: str) -> int:
    """The lexicographic rank of the first order of FILTERS that starts with prefix: its Lehmer code, digit by digit."""
    left, rank = list(FILTERS), 0
    for name in prefix:
        rank += left.index(name) * factorial(len(left) - 1)
        left.remove(name)
    return rank


def intervals(mask: int) -> list[tuple[int, int, int]]:
    """(step, first rank, rank behind the last one) of the orders that remove a document with this mask (bit k: FILTERS[k]) at step."""
    failed = [f for k, f in enumerate(FILTERS) if mask >> k & 1]
    passed = [f for f in FILTERS if f not in failed]
    found = []
    for step in range(1, len(passed) + 2):
        for before in permutations(passed, step - 1):
            for f in failed:
                first = rank_of("".join(before) + f)
                found.append((step, first, first + factorial(len(FILTERS) - step)))
    return found


def failures(text: Column) -> Column:
    """The mask of a text by the filters that look at it alone: A to D."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.transform(
        F.array(F.struct(words.alias("words"), F.size(words).alias("n"))),
        lambda w: (
            F.when(w["n"] < 200, 1).otherwise(0)
            + F.when(100 * F.size(F.array_distinct(w["words"])) < 50 * w["n"], 2).otherwise(0)
            + F.when(100 * (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > 2 * F.length(text), 4).otherwise(0)
            + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
        ),
    )[0]


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part have this mask and these labels; see audit().

    Filter E needs the smallest id of each text. Copies are counted by text, part, mask and labels before they are shuffled, with
    their smallest id and how many rows have it, so a text that a third of all rows hold is a few rows.
    """
    text = F.coalesce("text", F.lit(""))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(SALTS))).otherwise(0).cast("int")
    facts = docs.select("doc_id", salt.alias("salt"), F.coalesce("source", F.lit("")).alias("part"), failures(text).alias("mask"), F.sha2(text, 256).alias("digest"))
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(one("quality"), one("toxic")).withColumn("salt", F.lit(0))
    labelled = facts.join(known, ["doc_id", "salt"], "left").na.fill(0, ["quality", "toxic"])
    # rows of one document lie together after the join, so this takes no further shuffle
    rows = labelled.groupBy("doc_id", "salt", "digest", "part", "mask", "quality", "toxic").agg(F.count("*").alias("n"))
    named = F.when(F.col("doc_id").isNotNull(), F.col("n"))
    copies = rows.groupBy("digest", "part", "mask", "quality", "toxic").agg(F.sum("n").alias("n"), F.sum(named).alias("named"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("at_first"))
    first = F.min("first").over(Window.partitionBy("digest"))
    later = F.coalesce(F.col("named") - F.when(F.col("first") == first, F.col("at_first")).otherwise(0), F.lit(0))
    cells = F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("later")).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.col("later").alias("n")))
    split = copies.withColumn("later", later).select("part", F.explode(cells).alias("cell"), F.col("quality").alias("good"), "toxic")
    return split.where("cell.n > 0").groupBy("part", "cell.mask", "good", "toxic").agg(F.sum("cell.n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row per part, order and step.

    docs (doc_id, text, source), labels (doc_id, quality, toxic). A document fails A with under 200 words, B if under half of its words are distinct,
    C if over 2 % of its code points are A-Z, D if it holds one of #$%&*|, E if another row with a smaller id has the same text. Each
    order of the filters removes it at the first that it fails. Within a part: kept after the step, removed at it,
    redundant (failing its filter, removed earlier), unique_fails (failing its filter alone), those removed with quality 1
    and with toxic 1, and what its filter removes in all 120 orders together.

    Null text counts as empty, null source as the part ''. A row without an id has no label, and neither fails E nor makes others fail it.
    Rows of one id and text are no copies of each other. Of several labels of a document any 1 counts. Other columns
    are ignored; without documents there are no rows. Work after the counts grows with the parts only.
    """
    spark = docs.sparkSession
    counts = materialize(mask_counts(docs, labels), "masks")
    # fixed by the filters' number: 31 masks with at most 65 intervals, 120 orders of 5 steps
    ranges = F.broadcast(spark.createDataFrame([(m, *x) for m in range(1, 1 << len(FILTERS)) for x in intervals(m)], "mask int, step int, first int, behind int"))
    orders = ["".join(p) for p in permutations(FILTERS)]
    grid = F.broadcast(spark.createDataFrame([(r * len(o) + s - 1, r, o, s, FILTERS.index(o[s - 1])) for r, o in enumerate(orders) for s in range(1, len(o) + 1)], "cell int, rank int, filter_order string, step int, bit int"))

    sums = [F.col("n").alias("removed"), (F.col("n") * F.col("good")).alias("good_lost"), (F.col("n") * F.col("toxic")).alias("toxic_lost")]
    added = counts.join(ranges, "mask").select("part", "step", "first", "behind", *sums)
    changes = added.select("part", "step", F.explode(F.array(F.struct(F.col("first").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("behind").alias("rank"), F.lit(-1).alias("sign")))).alias("end"), "removed", "good_lost", "toxic_lost")
    totals = ["removed", "good_lost", "toxic_lost"]
    changes = changes.where(F.col("end.rank") < ORDERS).groupBy("part", "step", "end.rank").agg(*(F.sum(F.col(c) * F.col("end.sign")).alias(c) for c in totals))

    failing = lambda k: F.sum(F.when(F.col("mask").bitwiseAND(1 << k) != 0, F.col("n")).otherwise(0))
    alone = lambda k: F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0))
    each = lambda f: F.array(*(f(k) for k in range(len(FILTERS))))
    parts = counts.groupBy("part").agg(F.sum("n").alias("all"), each(failing).alias("failing"), each(alone).alias("alone"))

    cells = parts.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(ORDERS * len(FILTERS) - 1)))).join(grid, "cell")
    filled = cells.join(changes, ["part", "step", "rank"], "left").na.fill(0, totals)
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = filled.withColumns({c: F.sum(c).over(along) for c in totals})
    gone = F.sum("removed").over(Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    of_filter = F.sum("removed").over(Window.partitionBy("part", "bit"))
    return summed.select(
        "part", "filter_order", "step",
        (F.col("all") - gone).alias("kept"), "removed", (F.get("failing", F.col("bit")) - F.col("removed")).alias("redundant"),
        F.get("alone", F.col("bit")).alias("unique_fails"), "good_lost", "toxic_lost", of_filter.alias("shapley"),
    )
