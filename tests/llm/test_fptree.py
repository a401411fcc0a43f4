"""Ranked search against scoring every document for every item."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import fptree
from lodestone.llm.fptree import TERM, Asked, Best, ranked_search, search_trie

DOCS, ITEMS = "doc_id long, text string, lang string", "item_id long, text string"


def terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=50):
    listed = [(i, terms(text)) for i, text, *_ in docs]
    listed = [(i, t) for i, t in listed if t]
    total = sum(len(t) for _, t in listed)
    out = []
    for item, text in items:
        scores = []
        asked = set(terms(text))
        df = {x: sum(x in t for _, t in listed) for x in asked}
        for i, t in listed:
            m = 50 + 50 * len(t) * len(listed) // total
            score = sum(math.floor(1000 * math.log((2 * len(listed) + 2) / (2 * df[x] + 1))) * (1000000000 * t.count(x) // (1000 * t.count(x) + 20 * m)) for x in asked if x in t)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k=50):
    rows = ranked_search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), k).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def corpus(seed, n, words=80):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    weights = [1 / (k + 1) for k in range(words)]
    return [(i, " ".join(r.choices(vocabulary, weights, k=r.choice([1, 5, 30, 100]))), "en") for i in range(n)], [(j, " ".join(r.choices(vocabulary, k=r.choice([1, 4, 12])))) for j in range(12)]


def test_random_documents(spark, monkeypatch):
    docs, items = corpus(1, 400)
    docs += [(1000 + i, docs[7][1], "en") for i in range(90)]  # copies: ties by id beyond k
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, 3) == brute(docs, items, 3)
    monkeypatch.setattr(fptree, "TOGETHER", 5)
    monkeypatch.setattr(fptree, "ITEM_BLOCK", 7)
    assert found(spark, docs, items) == brute(docs, items)


def test_nulls_case_long_texts_and_repeats(spark):
    docs = [
        (1, None, "x"), (2, "", "x"), (3, "--- ...", "x"), (None, "Café au lait", "x"), (4, "CAFÉ café", "x"), (4, "CAFÉ café", "x"), (5, "caf_é 12a", "x"), (6, "a " * 200_000 + "needle", "x"),
        (7, "\x7fneedle\x00 12A", "x"), (None, None, "x"),
    ]
    items = [(1, "cafÉ Café"), (1, "NEEDLE a"), (2, None), (3, "!"), (None, "12a é"), (4, "nowhere")]
    assert found(spark, docs, items) == brute(docs, items)


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "a")], ITEMS)
    assert ranked_search(empty, items).collect() == []
    assert ranked_search(spark.createDataFrame([(1, "a", "x")], DOCS), items.limit(0)).collect() == []
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], DOCS).withColumns({c: F.lit("y") for c in ("item_id", "n", "ids", "path", "score", "rank")})
    assert [tuple(r) for r in ranked_search(docs, items.withColumn("doc_id", F.lit(9))).collect()] == brute([(1, "a"), (2, "b")], [(1, "a")])


def test_bounds_skip_nodes_and_lose_nothing():
    r = np.random.default_rng(5)
    docs = sorted(tuple(sorted(set(r.zipf(1.4, 12) % 60))) for _ in range(3000))
    bounds = np.cumsum([0, *map(len, docs)])
    term = np.array([t for d in docs for t in d])
    tf, m = r.integers(1, 9, len(term)), r.integers(50, 400, len(docs))
    weights = (r.random((60, 10)) < 0.1) * r.integers(1, 9000, (60, 10))
    best = Best(10, 5)
    search_trie(weights, list(range(len(docs))), m, bounds, term, tf, best)
    share = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, np.diff(bounds)))
    scores = np.stack([np.add.reduceat(share * weights[term, j], bounds[:-1]) for j in range(10)])
    for j in range(10):
        want = sorted((-s, i) for i, s in enumerate(scores[j]) if s > 0)[:5]
        assert sorted((-s, x.id) for s, x in best.heaps[j]) == want
    assert best.skipped and best.scored < 3000


def test_terms_that_share_a_hash_are_told_apart(monkeypatch):
    asked = Asked(["ab", "cd"])
    data = np.frombuffer(b"ab cd xy", np.uint8)
    starts, ends = np.array([0, 3, 6]), np.array([2, 5, 8])
    assert [x.tolist() for x in asked.find(data, starts, ends)] == [[0, 1], [0, 1]]
    real = fptree.word_hashes
    monkeypatch.setattr(fptree, "word_hashes", lambda d, s, e: np.append(real(d, s, e)[:2], asked.hashes[:1]))
    assert [x.tolist() for x in asked.find(data, starts, ends)] == [[0, 1], [0, 1]]
