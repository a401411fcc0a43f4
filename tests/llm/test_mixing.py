import hashlib
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lodestone.llm.mixing import leaf_budgets, mix_sources

LEVELS = ["dom", "lang", "src"]


def fill(children, budget):
    """{key: budget} of {key: (cap, weight)}: raise one level until the budget is used; exact fractions."""
    live = {k: v for k, v in children.items() if v[0] > 0 and v[1] > 0}
    out = {}
    while live:
        unit = Fraction(budget, sum(w for _, w in live.values()))
        full = [k for k, (cap, w) in live.items() if cap <= unit * w]
        if not full:
            break
        for k in full:
            out[k] = live.pop(k)[0]
            budget -= out[k]
    total = sum(w for _, w in live.values())
    shares = {k: budget * w // total for k, (_, w) in live.items()}
    order = sorted(live, key=lambda k: (live[k][0] / live[k][1], k))
    for k in order[: budget - sum(shares.values())]:
        shares[k] += 1
    return out | shares


def plain_budgets(leaves, weights, budget):
    """leaves: {(a, b, c): cap}."""

    def down(prefix, budget):
        k = len(prefix)
        if k == 3:
            return {prefix: budget}
        nodes = {}
        for path, cap in leaves.items():
            if path[:k] == prefix:
                nodes[path[k]] = nodes.get(path[k], 0) + cap
        level = LEVELS[k]
        got = fill({n: (cap, weights.get(level, {}).get(n, 1)) for n, cap in nodes.items()}, budget)
        return {p: b for n, x in got.items() for p, b in down((*prefix, n), x).items()}

    return down((), min(budget, sum(leaves.values())))


WEIGHTS = {"dom": {"web": 5, "code": 2, "gone": 0}, "lang": {"en": 6, "es": 9}, "src": {"s0": 4}}


@pytest.mark.parametrize("seed", range(3))
def test_budgets_match_plain_ones(spark, seed):
    r = random.Random(seed)
    leaves = {(d, lang, s): r.choice([3, 50, 700, 9000]) for d in ("web", "code", "book") for lang in ("en", "es", "de") for s in ("s0", "s1", "s2") if r.random() < 0.7}
    rows = [(*k, v) for k, v in leaves.items()]
    for part in (0, 1, 10, 57, 90, 100):
        got = leaf_budgets(spark.createDataFrame(rows, "dom string, lang string, src string, cap long"), LEVELS, WEIGHTS, F.expr(f"cap * {part} div 100"))
        want = plain_budgets(leaves, WEIGHTS, sum(leaves.values()) * part // 100)
        assert {(x.dom, x.lang, x.src): x.budget for x in got.collect()} == want
        assert sum(want.values()) == sum(leaves.values()) * part // 100


@pytest.mark.parametrize("epochs,share,edge", [(1, (1, 2), None), (3, (3, 2), None), (2, (2, 1), None), (1, (1, 2), 0), (3, (3, 2), 1)])
def test_prefixes_of_seeded_epochs(spark, monkeypatch, epochs, share, edge):
    if edge is not None:  # buckets are split until they hold copies only
        monkeypatch.setattr("lodestone.llm.mixing.EDGE_ROWS", edge)
        monkeypatch.setattr("lodestone.llm.mixing.BUCKET_DIGITS", 1)
    r = random.Random(11)
    rows = [(i, "w " * r.randint(0, 40), r.choice(["web", "code", "gone", None]), r.choice(["en", "es"]), r.choice(["s0", "s1", None])) for i in range(400)]
    rows += [(None, "a b c", "web", "en", "s0"), (7, None, "web", "en", "s0"), (3, "x y", "web", "en", "s1"), (3, "x y", "web", "en", "s1")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, dom string, lang string, src string").selectExpr("*", "1 as epoch", "2 as cap", "3 as n_tokens")
    got = mix_sources(frame, {k: F.col(k) for k in LEVELS}, WEIGHTS, share, seed=5, max_epochs=epochs).collect()
    leaves, docs = {}, {}
    for d, t, *path in rows:
        path, n = tuple(x or "none" for x in path), len((t or "").split())
        if n:
            leaves[path] = leaves.get(path, 0) + n
            docs.setdefault(path, []).append((d, n))
    budgets = plain_budgets({k: v * epochs for k, v in leaves.items()}, WEIGHTS, sum(leaves.values()) * share[0] // share[1])
    want = []
    for path, budget in budgets.items():
        for e in range(epochs + 1):
            for d, n in sorted(docs[path], key=lambda x: (hashlib.md5(f"5:{e}:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[0] or -1, x[1])):
                if budget > 0:
                    want.append((str(d), *path, e, n, min(n, budget)))
                    budget -= n
    # whole epochs carry no order, so their rows compare as sets of rows
    assert sorted((str(x.doc_id), x.dom, x.lang, x.src, x.epoch, x.n_tokens, x.take_tokens) for x in got) == sorted(want)


@pytest.mark.parametrize("part", [1, 7, 50, 93])
def test_a_prefix_ends_within_copies(spark, monkeypatch, part):
    monkeypatch.setattr("lodestone.llm.mixing.EDGE_ROWS", 2)
    rows = [(None, "a b c")] * 60 + [(None, "a b")] * 50 + [(k, "x y z u") for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = mix_sources(frame, {"src": F.lit("s")}, {}, (part, 100), seed=3).collect()
    left, want = sum(len(t.split()) for _, t in rows) * part // 100, []
    for d, n in sorted(((d, len(t.split())) for d, t in rows), key=lambda x: (hashlib.md5(f"3:0:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[1])):
        if left > 0:
            want.append((str(d), n, min(n, left)))
            left -= n
    assert sorted((str(x.doc_id), x.n_tokens, x.take_tokens) for x in got) == sorted(want)


def test_nothing_to_mix(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, dom string, lang string, src string")
    assert mix_sources(empty, {k: F.col(k) for k in LEVELS}, WEIGHTS, (1, 2)).count() == 0
