"""What a task holds at once is bounded by its own sizes, not by the batches that come in."""

import pyarrow as pa

from lodestone.functions.batches import pieces


def test_pieces_are_bounded_by_rows_and_bytes():
    batch = pa.RecordBatch.from_pydict({"k": list(range(1000)), "text": ["x" * (5000 if k == 500 else k % 7) for k in range(1000)]})
    got = list(pieces(batch, 100, 2000))
    assert [k for p in got for k in p.column(0).to_pylist()] == list(range(1000))
    assert all(len(p) <= 100 and (p.nbytes <= 2000 or len(p) == 1) for p in got) and max(map(len, got)) > 50
    assert [len(p) for p in pieces(batch.slice(0, 0))] == []


def test_words_of_documents_are_counted_in_pieces(monkeypatch):
    from lodestone.operators import ranking as R

    monkeypatch.setattr(R, "DOC_BYTES", 200)
    terms = [["a", "b", "a"], None, [], ["c"]] * 25
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "terms": pa.array(terms, pa.list_(pa.string()))})
    got = list(R._term_counts(pa.array(["a", "c"]))(iter([batch])))
    assert len(got) > 5 and [k for b in got for k in b.column(0).to_pylist()] == list(range(100))
    assert [(n, ids, times) for b in got for n, ids, times in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))][:4] == [(3, [0], [2]), (0, [], []), (0, [], []), (1, [1], [1])]


def test_postings_of_a_chunk():
    from lodestone.operators import postings as P

    rows = {"chunk": [1, 1, 1, 2], "doc_id": [3, 5, 9, 4], "length": [2, 0, 1, 1], "words": ["x a x", "", "a", "a"]}
    batch = pa.RecordBatch.from_pydict(rows, pa.schema([("chunk", pa.int32()), ("doc_id", pa.int64()), ("length", pa.int32()), ("words", pa.string())]))
    got = [r for b in P._postings(1.0)(iter([batch.slice(0, 2), batch.slice(2)])) for r in b.to_pylist()]
    docs = {(r["chunk"], r["term"]): [(d["doc_id"], d["length"], d["places"]) for d in r["docs"]] for r in got}
    assert docs == {(1, "x"): [(3, 2, [0, 2])], (1, "a"): [(3, 2, [1]), (9, 1, [0])], (2, "a"): [(4, 1, [0])]}
    part = lambda tf, n: tf / (tf + 1.5 * (0.25 + 0.75 * n))
    assert {(r["chunk"], r["term"]): round(r["top"], 9) for r in got} == {(1, "x"): round(part(2, 2), 9), (1, "a"): round(part(1, 1), 9), (2, "a"): round(part(1, 1), 9)}


def test_checks_of_a_query_are_those_of_its_parse(spark):
    from pyspark.sql import functions as F

    from lodestone.operators.parsing import check_column, parse_column

    texts = ["", None, "AND x", 'TITLE:"a*" OR (', "KW : (a OR MESH:b) y]", "'open", "x" * 3000 + " AND"] * 200
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, q string").select("k", parse_column(F.col("q")).alias("p"), check_column(F.col("q")).alias("c"))
    assert rows.where("c.faults <=> p.faults and c.quote_faults <=> p.quote_faults and c.clauses <=> p.clauses and c.has_root <=> p.has_root").count() == len(texts)
    assert rows.schema["c"].dataType.names == ["faults", "quote_faults", "clauses", "has_root"]


def test_only_places_where_sentences_may_end_are_looked_at():
    from lodestone.operators import segmentation as G

    looked = [m[0] for m in G._STOPS.finditer("one two three. Four \n five (six) seven")]
    assert looked == [". ", "\n ", ") "]
    assert G.split("  One cf. Two 3.5! x\n\n y \"Zed.\" End. ", frozenset(["cf"])) == ["One cf. Two 3.5!", "x", 'y "Zed."', "End."]


def test_texts_of_fielded_questions_are_sent_once_and_not_made_into_lists():
    from collections import Counter

    from lodestone.operators import ranking as R
    from lodestone.operators.percolate import Percolator, read_columns
    from lodestone.operators.querytext import program

    texts = [" ab the cd ab x ", "  ", " cd ab ", " x x \U0001d4b3 éé ", " the "] * 3
    batch = pa.RecordBatch.from_pydict({"doc_id": range(15), "text text": texts, "year year": pa.array([2001, None, 2009] * 5, pa.int32())})
    stored = Percolator({0: program('"cd ab"'), 2: program("x NOT PUB_YEAR:2001"), 5: program("éé OR x*")}, Counter())
    read = read_columns(batch, ["text text", "year year"], 1)
    assert isinstance(read["text text"], pa.Array) and read["year year"][:2] == [2001, None]
    rows = [r for b in R._term_counts(pa.array(["ab", "éé", "cd"]), stored, ["text text", "year year"], 1)(iter([batch.slice(0, 7), batch.slice(7)])) for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(15))
    assert [(r["length"], r["ids"], r["times"]) for r in rows[5:10]] == [(3, [0, 2], [2, 1]), (0, [], []), (2, [0, 2], [1, 1]), (1, [1], [1]), (0, [], [])]
    assert [r["met"] for r in rows[:5]] == [[0, 5], [], [0], [5], []] and [r["met"] for r in rows[5:10]] == [[0, 2, 5], [], [0], [2, 5], []]


def test_counts_of_documents_are_scored_in_pieces(monkeypatch):
    import numpy as np

    from lodestone.operators import ranking as R

    n = 400
    ids = [[k % 3, 3 + k % 5] if k % 7 else [] for k in range(n)]
    rows = {"doc_id": range(n), "length": [5 + k % 11 for k in range(n)], "ids": ids, "times": [[1 + k % 4] * len(x) for k, x in enumerate(ids)], "met": [[1] if k % 50 == 0 else [] for k in range(n)]}
    ints = pa.list_(pa.int32())
    batch = pa.RecordBatch.from_pydict(rows, pa.schema([("doc_id", pa.int64()), ("length", pa.int64()), ("ids", ints), ("times", ints), ("met", ints)]))
    run = R._best_of_task([[0, 4], [2], [7, 1]], {1}, np.arange(1.0, 9.0), 9.0, 10)
    best = lambda: [r for b in run(iter([batch])) for r in b.to_pylist()]
    whole, seen = best(), []
    assert len(whole) == 28 and {r["doc_id"] for r in whole if r["question"] == 1} == set(range(0, n, 50))
    monkeypatch.setattr(R, "COUNT_BYTES", 1000)
    monkeypatch.setattr(R, "pieces", lambda *a: (seen.append(len(p)) or p for p in pieces(*a)))
    assert sorted(map(repr, best())) == sorted(map(repr, whole)) and sum(seen) == n and max(seen) < 50


def test_memory_of_ranking_is_the_same_for_a_batch_of_any_size():
    import tracemalloc

    import numpy as np

    from lodestone.operators import ranking as R

    def peak(n: int) -> float:
        """MB that counting and scoring n documents of one batch take besides the batch."""
        batch = pa.RecordBatch.from_pydict({"doc_id": range(n), "terms": [[f"w{(k * j) % 97}" for j in range(300)] for k in range(n)]})
        usual, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
        pa.set_memory_pool(pool)
        tracemalloc.start()
        try:
            counted = R._term_counts(pa.array([f"w{k}" for k in range(97)]))(iter([batch]))
            best = [r for b in R._best_of_task([[0, 4], [2]], set(), np.arange(1.0, 98.0), 300.0, 10)(counted) for r in b.to_pylist()]
            assert len(best) == 20
            return (pool.max_memory() + tracemalloc.get_traced_memory()[1]) / 1e6
        finally:
            tracemalloc.stop()
            pa.set_memory_pool(usual)

    peak(100)  # what is loaded or made once
    small, large = peak(2000), peak(16000)
    assert large < 1.5 * small


def test_conditions_of_one_shape_are_evaluated_side_by_side(monkeypatch):
    """An operator is carried out for many conditions at once, and what they find leaves in parts of a size of its own."""
    import random
    from collections import Counter

    import numpy as np

    from lodestone.operators import percolate as Q
    from lodestone.operators.querytext import program

    made, n = random.Random(3), 1000
    words = [f"w{int(made.paretovariate(0.7))}" for _ in range(20 * n)]
    papers = [words[k : k + 20] for k in range(0, 20 * n, 20)]
    columns = {"text text": pa.array([f" {' '.join(p)} " for p in papers], pa.string()), "year year": [2000 + k % 3 for k in range(n)]}
    asked = [made.sample(range(1, 60), 4) for _ in range(900)]
    one, other = "w{} (w{} OR w{}) NOT w{}", '(w{0} PUB_YEAR:2001) OR "w{1} w{2}"'
    stored = Q.Percolator({k: program((one if k % 3 else other).format(*x)) for k, x in enumerate(asked)}, Counter())
    has = [set(p) for p in papers]

    def holds(k: int, i: int) -> bool:
        a, b, c, d = (f"w{x}" for x in asked[k])
        near = any(x == b and y == c for x, y in zip(papers[i], papers[i][1:]))
        return (a in has[i] and (b in has[i] or c in has[i]) and d not in has[i]) if k % 3 else (a in has[i] and i % 3 == 1) or near

    want = {(k, i) for k in range(900) for i in range(n) if holds(k, i)}
    assert {(k, i) for k, places in stored.meeting(columns, n) for i in places.tolist()} == want
    monkeypatch.setattr(Q, "PART", 1 << 14)
    sizes = [len(numbers) for numbers, _ in stored.found(columns, n)]
    assert max(sizes) == (1 << 14) // 128 and len(sizes) < 12
    monkeypatch.setattr(Q, "PAIRS", 1000)
    ends = np.cumsum([0, *(8 if k % 50 == 1 else 1 for k in range(900))])
    parts = list(Q._pairs(stored.found(columns, n), ends))
    assert max(len(query) for query, _ in parts) <= 1000 and len(parts) > 5
    got = [(q, i) for query, place in parts for q, i in zip(query.tolist(), place.tolist())]
    assert sorted(got) == sorted((q, i) for k, i in want for q in range(ends[k], ends[k + 1]))


def test_papers_are_read_in_full_once_for_all_blocks_of_conditions(spark, monkeypatch):
    from lodestone.operators import percolate as Q

    monkeypatch.setattr(Q, "BLOCK", 2)
    made = []
    monkeypatch.setattr(Q, "materialize", lambda df, label, write=Q.materialize: made.append(label) or write(df, label))
    papers = spark.createDataFrame([(i, f"a{i % 5} b{i % 7}", str(2000 + i)) for i in range(40)], "doc_id long, text string, year string")
    texts = [f"{w} PUB_YEAR:[2000 TO *]" for w in ("a0", "a1", "b2", "b3")] + ["PUB_YEAR:[2039 TO *] a4", "b6", "zz"]
    got = Q.percolate(papers, spark.createDataFrame(list(enumerate(texts)), "query_id int, query string").repartition(1)).collect()
    want = [(k, i) for k, w in enumerate(["a0", "a1", "b2", "b3", "a4", "b6"]) for i in range(40) if w in (f"a{i % 5}", f"b{i % 7}") and (k != 4 or i == 39)]
    assert sorted((r.query_id, r.doc_id) for r in got) == want and len(made) == len(set(made))


def _scored(rows, asked, k, **how):
    """(question, doc_id) with their scores, of rows of blocks dealt over tasks."""
    from collections import Counter

    from lodestone.operators import postings as P

    kinds = [("chunk", pa.int32()), ("term", pa.int32()), ("top", pa.float64()), ("edge", pa.int8()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))]
    total, n = Counter(), 0
    for task in rows:
        for b in P._scoring(asked, 2.0, k, **how)(pa.RecordBatch.from_pylist(part, pa.schema(kinds)) for part in task):
            for r in b.to_pylist():
                total[r["question"], r["doc_id"]] += r["score"]
                n += 1
    best = {q: sorted((-round(x, 9), d) for (p, d), x in total.items() if p == q)[:k] for q in range(len(asked))}
    return best, n


def test_a_task_passes_on_its_best_documents_and_parts_of_chunks_that_it_shares(monkeypatch):
    import numpy as np

    from lodestone.operators import postings as P

    n_chunks, n_terms, each = 40, 12, 16
    rng = np.random.default_rng(5)
    rows = []
    for chunk in range(n_chunks):
        length = rng.integers(1, 9, each)
        terms = [t for t in range(n_terms) if rng.random() < 0.8] or [0]
        for at, t in enumerate(terms):
            d = np.flatnonzero(rng.random(each) < 0.5)
            d = d if len(d) else np.arange(1)
            tf = rng.integers(1, 5, len(d))
            top = float(P._part(tf.astype(float), length[d], 2.0).max())
            rows.append({"chunk": chunk, "term": t if t < 10 else None, "top": top, "edge": (at == 0) + 2 * (at == len(terms) - 1), "doc_ids": (d + chunk * each).tolist(), "lengths": length[d].tolist(), "tfs": tf.tolist()})
    asked = [[(0, 1.5), (3, 0.2), (9, 2.0)], [], [(7, 1.0)], [(1, 0.5), (2, 0.5), (4, 0.5)]]
    want: dict = {}
    for r in rows:
        for q, terms in enumerate(asked):
            for t, idf in terms:
                if t == r["term"]:
                    for d, length, tf in zip(r["doc_ids"], r["lengths"], r["tfs"]):
                        want[q, d] = want.get((q, d), 0) + idf * tf / (tf + 1.5 * (0.25 + 0.75 * length / 2.0))
    best = {q: sorted((-round(x, 9), d) for (p, d), x in want.items() if p == q)[:5] for q in range(4)}
    least = np.array([-best[q][-1][0] if best[q] else 0.0 for q in range(4)])
    close = lambda a, b: a.keys() == b.keys() and all([d for _, d in a[q]] == [d for _, d in b[q]] and np.allclose([x for x, _ in a[q]], [x for x, _ in b[q]]) for q in a)
    monkeypatch.setattr(P, "HELD", 60)
    for how in ({"least": least * 0}, {"least": least}, {"wanted": {c: [0, 1, 2, 3] for c in range(n_chunks)}}):
        whole, n = _scored([[rows[:100], rows[100:]]], asked, 5, **how)
        assert close(whole, best) and n <= 15
        cuts = [0, 7, 8, 33, 150, len(rows)]
        dealt, n = _scored([[rows[a:b]] for a, b in zip(cuts, cuts[1:])], asked, 5, **how)
        assert close(dealt, best) and n < len(want)


def test_postings_are_not_shuffled_for_ranking(spark, monkeypatch):
    from lodestone.operators import postings as P
    from lodestone.operators.ranking import bm25_top

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    asked = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").selectExpr("item_id as question_id", "text").where("question_id < 6")
    index = P.build_index(docs)
    plans = {}

    def seen(df, label, write=P.materialize):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(P, "materialize", seen)
    monkeypatch.setattr(P, "QUESTION_BLOCK", 4)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # chunks lie in several tasks
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = P.ranked(index, asked, 5).hits.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = lambda rows: sorted((r.question_id, r["rank"], r.doc_id, round(r.score, 6)) for r in rows)
    assert plain(got) == plain(bm25_top(docs, asked, 5).collect())
    assert "MapInArrow" in plans["hits"] and "hashpartitioning" not in plans["hits"] and "places" not in plans["hits"][plans["hits"].index("Scan parquet") :].split("ReadSchema")[1][:400]
