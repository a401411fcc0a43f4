import re

import numpy as np
import public_tokenizers
from brute import components, cut_lines
from pyspark.sql import Row
from tokenizers import Tokenizer

import corpus_pipeline as p

BLANK = "[^\x20\x09-\x0d]+"
SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r.doc_id: r for r in docs.collect()}
    first = p.language_id(spark, docs, SF)
    assert first.columns == p.COLUMNS
    rows = {r.doc_id: r for r in first.collect()}
    assert len(rows) >= 0.97 * len(known) and all(known[d].text == r.text for d, r in rows.items())
    odd = docs.limit(2).unionByName(spark.createDataFrame([(-1, "12 345 !!", None, "s", 9), (-2, None, "en", "s", 0)], docs.schema))
    assert {r.doc_id for r in p.language_id(spark, odd, SF).collect()} == {r.doc_id for r in docs.limit(2).collect()}

    want = cut_lines([(d, r.text) for d, r in rows.items()])
    second = p.line_dedup(spark, first, SF)
    assert second.columns == p.COLUMNS
    got = {r.doc_id: r for r in second.collect()}
    assert {d: r.text for d, r in got.items()} == {d: t for d, t in want.items() if t.split() or t == rows[d].text}
    assert all(r.n_chars == len(r.text) for d, r in got.items() if r.text != rows[d].text)

    third = p.near_duplicates(spark, second, SF)
    assert third.columns == p.COLUMNS
    roots = components([(d, r.text) for d, r in got.items()])
    left = {r.doc_id: r for r in third.collect()}
    assert set(left) == set(roots.values())

    fourth = p.mixing(spark, third, SF)
    assert fourth.columns == p.COLUMNS
    mixed = {r.doc_id: r for r in fourth.collect()}
    words = lambda rows: sum(len(re.findall(BLANK, r.text)) for r in rows.values())
    assert set(mixed) <= set(left) and words(mixed) == budget(left.values())
    parts = {lang: words({d: r for d, r in mixed.items() if r.lang == lang}) for lang in p.MIX_WEIGHTS["lang"]}
    assert all(abs(100 * parts[lang] / words(mixed) - 100 * w / sum(p.MIX_WEIGHTS["lang"].values())) < 2 for lang, w in p.MIX_WEIGHTS["lang"].items())
    cut = [d for d, r in mixed.items() if r.text != left[d].text]
    assert cut and len({(left[d].lang, left[d].source) for d in cut}) == len(cut)
    assert all(left[d].text.startswith(mixed[d].text) and mixed[d].n_chars == len(mixed[d].text) for d in cut)

    pieces = p.packing(spark, fourth, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {}
    for r in pieces:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {d: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for d, r in mixed.items()}
    ends = np.zeros(max(r.sequence_id for r in pieces) + 1, int)
    for r in pieces:
        ends[r.sequence_id] += r.length
    assert (ends[:-1] == 4096).all()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_language_stage_rejects_mixed_and_foreign_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by_lang = {k: [r.text for r in docs.where(f"lang = '{k}' and length(text) > 400").orderBy("doc_id").limit(4).collect()] for k in ("en", "de", "fr")}
    part = lambda k, i, n=30: " ".join(by_lang[k][i].split()[:n])
    rows = [(-1 - i, "\n".join(part(k, i) for k in ("en", "de", "fr")), None, "s", 1) for i in range(4)]  # a third each
    rows += [(-11, "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", "en", "s", 1), (-12, "Все люди рождаются свободными и равными в своем достоинстве", None, "s", 1)]
    clean = [(-21, part("en", 0, 60) + "\n" + part("de", 0, 20), None, "s", 1), (-22, part("fr", 1) + "\nAll rights reserved.", "fr", "s", 1)]
    kept = {r.doc_id: r.lang for r in p.language_id(spark, docs.unionByName(spark.createDataFrame(rows + clean, SCHEMA)), SF).where("doc_id < 0").collect()}
    assert kept == {-21: "en", -22: "fr"}


def test_near_duplicates_keeps_one_row_of_each_group(spark):
    base = [f"t{i}" for i in range(60)]
    a, b, other = " ".join(base), " ".join(["x", *base[1:]]), " ".join(f"o{i}" for i in range(30))
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, a, None, "s", 1), (1, other, "en", "s", 1), (2, b, "en", "s", 1), (None, b, "en", "s", 1), (7, "x y", "en", "s", 1), (None, "x y", "en", "s", 1), (None, "z z", None, None, None), (None, "z z", None, None, None), (9, "", "en", "s", 0), (10, None, "en", "s", 0)]
    got = sorted((str(r.doc_id), str(r.text)) for r in p.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), SF).collect())
    assert got == sorted([("1", a), ("1", other), ("7", "x y"), ("None", "z z"), ("9", ""), ("10", "None")])


def budget(rows) -> int:
    """The words that a mixture takes by the weights of languages: the scarcest one is used up, but half of all at least."""
    sizes: dict = {}
    for r in rows:
        sizes[r.lang] = sizes.get(r.lang, 0) + len(re.findall(BLANK, r.text))
    weights = p.MIX_WEIGHTS["lang"]
    whole = sum(weights.get(lang, 1) for lang in sizes)
    total = sum(sizes.values())
    return min(total, max(total // 2, min(n * whole // weights[lang] for lang, n in sizes.items() if lang in weights)))


def test_mixing_takes_rows_without_an_id(spark):
    rows = [(None if i % 2 else i, f"word{i} of the text " * 10, ["en", "de"][i % 3 == 0], f"src{i % 4}", i) for i in range(40)]
    got = p.mixing(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()
    assert sum(len(r.text.split()) for r in got) == budget(Row(lang=r[2], text=r[1]) for r in rows) == 26 * 40 * 8 // 6
    assert sum(r.doc_id is None for r in got) > 10


def test_a_scarce_language_takes_no_more_than_half_of_all_words(spark):
    rows = [(i, f"word{i} of the text " * 10, "de" if i == 7 else "en", "src1", i) for i in range(40)]
    got = p.mixing(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()
    assert sum(len(r.text.split()) for r in got) == 20 * 40 and 7 in {r.doc_id for r in got}


def test_run_on_nulls_and_nothing(spark, tmp_path):
    long = " ".join(f"word{i} of the text" for i in range(40))
    # the rows without an id: one that is learned from, one that is a copy
    rows = [(1, long, "en", None, None), (None, long, "en", None, None), (2, long + " more", None, "src0", 1), (None, "the words of a text without an id", "en", "src1", 5), (3, None, None, None, None), (4, "", "en", "s", 0), (1, long, "en", None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    pieces = p.run(spark, str(tmp_path / "a")).collect()
    ids = {r.doc_id for r in pieces}
    assert 1 in ids and not ids & {2, 3, 4}
    assert len([r for r in pieces if r.start == 0]) == len(ids)  # repeated rows are packed once
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert p.run(spark, str(tmp_path / "b")).count() == 0
