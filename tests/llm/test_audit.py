"""The audit of filter orders against running every order over every document."""

import random
from itertools import permutations

from pyspark.sql import functions as F

from lodestone.llm.audit import FILTERS, audit, intervals, rank_of

DOCS, LABELS = "doc_id long, text string, source string, n_chars long", "doc_id long, quality int, toxic int"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    """(part, order, step) to counts."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    out, totals = {}, {}
    for i, text, source, _ in docs:
        text = text or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        fails = {
            f
            for f, x in zip(
                FILTERS,
                [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), any(c in "#$%&*|" for c in text), i is not None and first[text] < i],
                strict=True,
            )
            if x
        }
        for order in map("".join, permutations(FILTERS)):
            gone = False
            for step, f in enumerate(order, 1):
                row = out.setdefault((source or "", order, step), dict.fromkeys(COUNTS, 0))
                row["unique_fails"] += fails == {f}
                if f in fails and not gone:
                    gone = True
                    row["removed"] += 1
                    row["good_lost"] += i in good
                    row["toxic_lost"] += i in toxic
                    totals[source or "", f] = totals.get((source or "", f), 0) + 1
                elif f in fails:
                    row["redundant"] += 1
                row["kept"] += not gone
    for (part, order, step), row in out.items():
        row["shapley"] = totals.get((part, order[step - 1]), 0)
    return out


def found(spark, docs, labels):
    rows = audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    out = {(r["part"], r["filter_order"], r["step"]): {c: r[c] for c in COUNTS} for r in rows}
    assert len(out) == len(rows)
    return out


def test_ranks_and_intervals():
    orders = ["".join(p) for p in permutations(FILTERS)]
    assert [rank_of(o) for o in orders] == list(range(120))
    for mask in range(1, 32):
        steps = [0] * 120
        for step, first, behind in intervals(mask):
            for r in range(first, behind):
                assert not steps[r]
                steps[r] = step
        assert steps == [next(s for s, f in enumerate(o, 1) if mask >> FILTERS.index(f) & 1) for o in orders]


def test_random_documents(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(300)] + ["Big", "WORD", "a#b", "é"]
    texts = [" ".join(r.choices(words[: r.choice([60, 300, 304])], k=r.choice([3, 150, 250, 400]))) for _ in range(40)]
    docs = [(r.randrange(300), r.choice(texts), r.choice(["a", "b", None, ""]), 1) for _ in range(200)]
    labels = [(r.randrange(300), r.randrange(2), r.choice([0, 1, None])) for _ in range(150)]
    assert found(spark, docs, labels) == brute(docs, labels)


def test_nulls_ties_repeats_and_long_texts(spark):
    docs = [
        (1, None, "s", 0), (2, "", "s", 0), (None, "", "s", 0), (None, "", None, 0), (5, "\t\x0b\x1f", "s", 0), (7, "x", "s", 1), (7, "x", "s", 1), (7, "x", "t", 1),
        (9, "X", "t", 1), (10, "long " * 300_000, "t", 1), (11, "a\U0001f600" * 40 + "B", "t", 1),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (None, 1, 1), (7, None, 1), (2, 1, 1)]
    assert found(spark, docs, labels) == brute(docs, labels)


def test_empty_and_clashing_columns(spark):
    assert audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []
    docs = spark.createDataFrame([(1, "a b", "s", 1), (2, "a b", "s", 1)], DOCS).withColumns({c: F.lit("x") for c in ("mask", "part", "digest", "n", "salt", "quality")})
    labels = spark.createDataFrame([(2, 1, 1)], LABELS).withColumn("source", F.lit("z"))
    rows = {(r["filter_order"], r["step"]): r for r in audit(docs, labels).collect()}
    assert len(rows) == 600 and rows["EABCD", 1]["removed"] == 1 and rows["EABCD", 1]["good_lost"] == 1 and rows["AEBCD", 2]["redundant"] == 1
