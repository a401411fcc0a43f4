import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import neighbours
from lodestone.llm.neighbours import hadamard, nearest, rotated, signed_axes
from lodestone.llm.queries import op7_nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>"


def exact(ids, x, queries, k):
    out = {}
    for i in queries:
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        out[ids[i]] = sorted((d[j], ids[j]) for j in range(len(ids)) if j != i)[:k]
    return out


def test_rotations_keep_lengths():
    x = np.random.default_rng(0).normal(size=(20, 48))
    assert np.allclose(hadamard(hadamard(x[:, :32])), x[:, :32])
    assert np.allclose(np.linalg.norm(rotated(x, 3), axis=1), 1)
    axes = signed_axes(x, 3, 5)
    y = rotated(x, 3)
    assert (axes[:, 0] // 2 == np.abs(y).argmax(axis=1)).all()
    assert (signed_axes(-x, 3, 1) == axes[:, :1] ^ 1).all()


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_and_exact_scores(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    want = exact(ids, x, [i for i, d in enumerate(ids) if d % 100 == 0], 10)
    got = {}
    for r in op7_nearest_neighbours(spark, folder).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(got) == set(want)
    at = {d: i for i, d in enumerate(ids)}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert [(f[1], f[2]) for f in found] == sorted((f[1], f[2]) for f in found)
        for _, score, v in found:
            assert score == pytest.approx(np.sqrt(((x[at[q]] - x[at[v]]) ** 2).sum()), abs=1e-12)
        hits += len({f[2] for f in found} & {v for _, v in want[q]})
    assert hits / (10 * len(want)) >= 0.9


def test_odd_vectors_blocks_and_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 1)
    r = np.random.default_rng(2)
    base = r.normal(size=3).tolist()
    rows = [(i, (np.array(base) + 1e-3 * r.normal(size=3)).tolist()) for i in range(60)] + [(100, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.0]), (200, [5.0, 1.0]), (201, [5.0, 2.0])]
    odd = [(300, None), (400, []), (500, [0.0, 0.0, 0.0]), (600, [float("nan"), 1.0, 1.0]), (700, [None, 1.0, 2.0]), (800, [float("inf"), 1.0, 1.0]), (None, base)]
    frame = spark.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "'x' as v", "1 as query", "2 as uid")
    got = sorted(tuple(x) for x in nearest(frame, F.col("vec_id") % 100 == 0, 5, tables=2, probe_share=0.4).collect())
    asked = {q for q, *_ in got}
    assert asked == {0, 100, 200}
    for q, n in ((0, 5), (100, 10), (200, 1)):
        assert sum(g[0] == q for g in got) == n
    assert [g[2] for g in got if g[0] == 200] == [201]
    assert [g[2:] for g in got if g[0] == 100 and g[1] == 1] == [(100, 0.0)] * 2
    x = np.array([v for i, v in rows if i < 200], np.float32).astype(float)
    d = sorted((np.sqrt(((v - x[0]) ** 2).sum()), i) for i, v in zip([i for i, _ in rows], x, strict=False) if i != 0)
    assert {g[2] for g in got if g[0] == 0} == {i for _, i in d[:5]}
    assert nearest(frame.limit(0), F.lit(True)).count() == 0


def test_ties_in_groups_of_equal_and_nearly_equal_vectors(spark):
    """The smallest ids of 1,000 equal vectors, and the nearest of 1,000 that are closer than 16-bit codes tell."""
    r = np.random.default_rng(3)
    same, near = r.normal(size=(2, 16))
    ids = r.permutation(4000)[:2000].tolist()
    x = np.array([same] * 1000 + [near + 1e-7 * v for v in r.normal(size=(1000, 16))])
    queries = sorted(ids[:1000])[5:800:200] + ids[1000:1005]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for q, rank, i, score in nearest(frame.repartition(4), F.col("vec_id").isin(queries), 10).collect():
        got.setdefault(q, []).append((rank, i, score))
    at = {d: i for i, d in enumerate(ids)}
    want = exact(ids, x, [at[q] for q in queries], 10)
    for q in queries:
        assert [i for _, i, _ in sorted(got[q])] == [i for _, i in want[q]]


@pytest.mark.parametrize("spread", [0.05, 0.5, 2.0])
def test_recall_on_vectors_of_mixed_lengths(spark, spread):
    """Lengths that vary by some percent, within a factor of a few, over five orders of magnitude; and an exact search of all."""
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 24)) * np.exp(spread * r.normal(size=(3000, 1)))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    queries = list(range(0, 3000, 100))
    want = exact(list(range(3000)), x, queries, 10)
    for share, least in ((neighbours.PROBE_SHARE, 0.9), (1.0, 1.0)):
        got = {}
        for q, _, i, _ in nearest(frame, F.col("vec_id") % 100 == 0, probe_share=share).collect():
            got.setdefault(q, set()).add(i)
        assert sum(len(got[q] & {i for _, i in want[q]}) for q in queries) / (10 * len(queries)) >= least


def test_extended_vectors_keep_the_order_of_distances():
    r = np.random.default_rng(6)
    x, q = r.normal(size=(50, 8)) * r.uniform(0.7, 1.4, size=(50, 1)), r.normal(size=(1, 8))
    square = (x * x).sum(axis=1)
    scale = np.sqrt(2 * square.std())
    space = neighbours.Space(8, square.mean(), scale, square.max() + (np.abs(square - square.mean()).max() / scale) ** 2)
    m = space.members(x)
    assert np.allclose((m * m).sum(axis=1), space.most)
    assert (np.argsort(-(m @ space.queries(q)[0])) == np.argsort(((x - q) ** 2).sum(axis=1))).all()
