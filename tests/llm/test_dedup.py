import random
import re

import pytest
from brute import components, cut_lines, links, random_documents, sha, shingle_set

from lodestone.llm import jaccard, line_dedup
from lodestone.llm.components import connected_components
from lodestone.llm.exact_dedup import exact_duplicates
from lodestone.llm.jaccard import jaccard_components
from lodestone.llm.line_dedup import dedup_lines

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_match_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 8)
    monkeypatch.setattr(jaccard, "COMMON_SHINGLES", 50)
    rows = random_documents(seed)
    got = {r.doc_id: r for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {d: r.component_id for d, r in got.items()} == components(rows)
    assert all(got[d].n_shingles == len(shingle_set(t)) for d, t in rows)
    assert {d: (r.class_links, r.n_links) for d, r in got.items()} == links(rows)
    sets = {d: frozenset(shingle_set(t)) for d, t in rows}
    assert all(got[d].class_id == min([d] + [e for e in sets if x and sets[e] == x]) for d, x in sets.items())
    plain = jaccard_components(spark.createDataFrame(rows, SCHEMA), count_links=False).collect()
    assert {r.doc_id: (r.component_id, r.n_links) for r in plain} == {d: (r.component_id, None) for d, r in got.items()}


@pytest.mark.parametrize("percent", [1, 30, 50, 90, 100])
def test_jaccard_at_any_percent(spark, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 16)
    r = random.Random(percent)
    base = [f"t{i}" for i in range(200)]
    rows = [(k, " ".join(base[:n])) for k, n in enumerate((60, 190, 195, 20, 6, 5))]
    for k in range(10, 40):
        a = r.randint(0, 150)
        rows.append((k, " ".join(base[a : a + r.randint(5, 120)])))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # lists go on from batch to batch
    try:
        got = {d.doc_id: (d.component_id, d.class_links, d.n_links) for d in jaccard_components(spark.createDataFrame(rows, SCHEMA), percent).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    roots, counts = components(rows, percent), links(rows, percent)
    assert got == {d: (roots[d], *counts[d]) for d in roots}


def test_jaccard_refuses_other_percents(spark):
    for percent in (0, 101):
        with pytest.raises(ValueError):
            jaccard_components(spark.createDataFrame([], SCHEMA), percent)


def test_jaccard_counts_links_of_repeated_rows_once(spark):
    """Rows that come again, under one id or others, and near copies of them."""
    base = [f"t{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base[:-1] + ["x"]), " ".join(["y", *base[1:]])]
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[0].upper()), (2, texts[0]), (3, texts[1]), (4, texts[2]), (4, texts[2])]
    got = sorted((r.doc_id, r.component_id, r.class_links, r.n_links) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1, 2, 6)] * 3 + [(2, 1, 2, 6), (3, 1, 2, 6), (4, 1, 2, 6), (4, 1, 2, 6)]


def test_jaccard_chain_needs_the_cross_pairs(spark):
    """A chain in which only neighbours link, so that links to the least member of a tile can't join it."""
    base = [f"t{i}" for i in range(400)]
    rows = [(100 - k, " ".join(base[12 * k : 12 * k + 104])) for k in range(20)]
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == components(rows)
    assert len(set(got.values())) == 1


def test_jaccard_edges(spark):
    rows = [(1, None), (2, ""), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "A B C D E F"), (5, "x y"), (6, "X  Y"), (7, "y x")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "text as cls", "1 as component_id", "2 as n_shingles")
    got = sorted(((r.doc_id or 0), r.component_id, r.n_shingles) for r in jaccard_components(frame).collect())
    assert got == [(0, None, 2), (1, 1, 0), (2, 2, 0), (3, 3, 2), (3, 3, 2), (4, 3, 2), (5, 5, 1), (6, 5, 1), (7, 7, 1)]
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (3, 2), (None, 4)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 120)}}


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_duplicates(spark, digest_all):
    rows = [*random_documents(5), (1000, None), (1001, " "), (None, "one"), (1002, "one  "), (1003, "o n e"), (1003, "o n e"), (1004, "x" * 200_000), (1005, "x" * 200_000 + "\n")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "1 as size", "2 as keep_id")
    got = exact_duplicates(frame, digest_all).collect()
    assert len(got) == len(rows)
    groups = {}
    for d, t in rows:
        groups.setdefault(sha(t), []).append((-len(t or ""), d if d is not None else 1 << 62, d))
    want = sorted((str(d), str(min(g)[2]), len(g)) for g in groups.values() for _, _, d in g)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    shas = {(r.text_sha256, r.keep_id) for r in got if r.text_sha256}
    assert shas <= {(k, min(g)[2]) for k, g in groups.items()}
    assert len(shas) == (len(groups) if digest_all else sum(len(g) > 1 for g in groups.values())) or not digest_all
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", [3, 4, 6, 7])
def test_dedup_lines_matches_brute_force(spark, seed):
    rows = random_documents(seed)
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, SCHEMA), 12).collect()}
    want = cut_lines(rows, 12)
    assert {d: r.text for d, r in got.items()} == want
    texts = dict(rows)
    assert sum(r.removed_lines for r in got.values()) > 20
    assert all(r.removed_words == len(texts[d].split()) - len(r.text.split()) for d, r in got.items() if " " not in texts[d])


def test_dedup_lines_edges(spark):
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(2, f"head two\n{p}\ntail"), (1, f"{p}"), (3, None), (4, ""), (None, p), (5, "a b\n" * 100), (6, "short\nshort"), (7, f"{p}\n\nMIT\nshort"), (7, f"{p}\n\nMIT\nshort")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("text as lo", "doc_id", "text", "5 as n_lines", "'x' as digest")
    got = dedup_lines(frame)
    assert got.columns == ["lo", "doc_id", "text", "digest", "n_lines", "removed_lines", "removed_words"]
    assert sorted((str(r.doc_id), str(r.text), r.removed_words) for r in got.collect()) == sorted(
        [("2", "head two\ntail", 60), ("1", p, 0), ("3", "None", 0), ("4", "", 0), ("None", p, 0), ("5", "a b\n", 198), ("6", "short\nshort", 0), ("7", "\nMIT\nshort", 60), ("7", "\nMIT\nshort", 60)]
    )
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dedup_lines_extends_by_any_earlier_copy(spark):
    """The end of a repeated run goes although its last window first stands elsewhere, followed by something else."""
    w, y, z = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("w", 60), ("y", 20), ("z", 20)))
    rows = [(1, f"{w}\nother"), (2, f"{w}\n{y}\nend"), (3, f"{w}\n{y}\n{z}\nlast"), (4, f"top\n{w}\n{y}\n{z}\nmore"), (5, f"{w}\n{z}")]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: rows[0][1], 2: f"{y}\nend", 3: f"{z}\nlast", 4: "top\nmore", 5: z}


@pytest.mark.parametrize("seed", [8, 9])
def test_dedup_lines_with_few_short_lines_in_many_contexts(spark, seed):
    """Lines of which many are equal, so that one fingerprint stands in many contexts and windows repeat within a text."""
    r = random.Random(seed)
    lines = [" ".join(f"{c}{k}" for k in range(r.randint(1, 7))) for c in "abcdefg"] + ["", " \t"]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(0, 40)))) for i in range(60)]
    got = {d.doc_id: d.text for d in dedup_lines(spark.createDataFrame(rows, SCHEMA), 10).collect()}
    assert got == cut_lines(rows, 10)


def test_fingerprints_are_fewer_than_windows(spark):
    rows = random_documents(11)
    texts = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "xxhash64(text)", "text")
    found = texts.mapInArrow(line_dedup._positions(12), line_dedup.POSITIONS).collect()
    windows = sum(p.starts for p in found)
    assert len({(p.doc_id, p.line) for p in found}) == len(found) < 0.7 * windows
    sizes = [[n for n in (len(re.findall("[^\x20\x09-\x0d]+", x)) for x in t.split("\n")) if n] for _, t in rows]
    assert windows == sum(sum(sum(s[i:]) >= 12 for i in range(len(s))) for s in sizes)


def test_dedup_lines_tells_texts_of_one_id_apart(spark):
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"one\n{p}"), (1, f"two\n{p}"), (8, f"{p}\nthree")]
    got = sorted(r.text for r in dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got in ([f"one\n{p}", "three", "two"], ["one", "three", f"two\n{p}"])
