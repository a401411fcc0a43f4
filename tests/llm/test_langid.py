import itertools
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid
from lodestone.llm.langid import BUCKETS, FOREIGN, SCRIPTS, Model, identify, learn, script_table, words_of
from lodestone.llm.queries import op3_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op3_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    both = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.count() == docs.count()
    assert both.where("lang = lang_pred").count() / both.count() > 0.97
    want = docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("h"))
    assert got.join(want, "doc_id").where("h <> held_out").count() == 0


def test_path_is_the_best_of_all(seed=7):
    r = np.random.default_rng(seed)
    for k in range(60):
        model = Model(["a", "b", "c"], np.zeros((3, 4), np.float32), np.ones((3, len(SCRIPTS)), bool), switch=float(r.choice([0.5, 2, 6])))
        scores = r.normal(size=(3, 7)) * r.choice([0.3, 1, 3])
        value = lambda p: sum(scores[x, i] for i, x in enumerate(p)) - model.switch * sum(a != b for a, b in itertools.pairwise(p))
        assert value(model.path(scores)) == pytest.approx(max(map(value, itertools.product(range(3), repeat=7))))


def test_mixed_text_and_scripts(spark):
    rows = [(i, t, lang) for i in range(30) for t, lang in [("the quick brown fox jumps over the lazy dog with them", "en"), ("der schnelle braune fuchs springt über den faulen hund", "de"), ("быстрая лиса прыгает через ленивую собаку", "ru")]]
    model = learn(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    assert model.languages == ["de", "en", "ru"]
    texts = ["the lazy fox jumps over the dog with them springt der faule hund über den braunen fuchs schnelle", "Лиса ДОМ", "字字 字", None, "", "12 !?", "the 字 fox", "x" * 100_000 + " the the the"]
    frame = spark.createDataFrame([(t, "x", 1) for t in texts], "text string, score string, lang int")
    got = {r.text: r for r in identify(frame, model).collect()}
    assert [s.lang for s in got[texts[0]].spans] == ["en", "de"]
    assert abs(got[texts[0]].spans[1].first_word - 9) <= 1
    assert got["Лиса ДОМ"].lang_pred == "ru" and got["the 字 fox"].lang_pred == "en"
    assert got["字字 字"].lang_pred in model.languages
    assert all(got[t].lang_pred == "und" and got[t].score == 0 for t in (None, "", "12 !?"))
    assert sum(s.words for s in got[texts[0]].spans) == len(texts[0].split())


def test_without_labels_or_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = learn(empty)
    assert identify(empty, model).count() == 0
    assert identify(spark.createDataFrame([("abc",)], "text string"), model).first().lang_pred == "und"


def test_words_of_texts():
    w = words_of(["Ab cd", "", "x1yé", "İ"])
    assert w.at.tolist() == [0, 2, 2, 4, 5] or w.at.tolist() == [0, 2, 2, 4, 6]
    assert w.letters.tolist()[:4] == [2, 2, 1, 2]


def test_more_than_a_hundred_languages(spark):
    words = lambda k: " ".join(chr(97 + k % 26) * 3 + chr(97 + k // 26) * 3 for _ in range(9))
    rows = [(k * 2 + i, words(k), f"l{k:03}") for k in range(120) for i in range(2)] + [(999, words(130), "rare")]
    frame = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    model = learn(frame)
    assert model.languages == sorted({r[2] for r in rows})
    assert identify(frame.where("doc_id = 999"), model).first().lang_pred == "rare"


def plain_label(model, text):
    """Words by a loop over characters, every score by a loop over letters, Viterbi by all predecessors."""
    words, word = [], ""
    for c in text.lower() + " ":
        if unicodedata.category(c)[0] == "L":
            word += c
        elif word:
            words.append(word)
            word = ""
    table, best, back, n = script_table(), None, [], len(model.languages)
    columns = []
    for word in words:
        script, column = table[ord(word[0])], []
        codes = [0, *map(ord, word), 0]
        for k in range(n):
            total = 0.0
            for a, b, c in zip(codes, codes[1:], codes[2:]):
                h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32
                h = ((h ^ (h >> 15)) * 0x2C1B3C6D) % 2**32
                total += float(model.table[k][h >> 16])
            column.append(0.0 if not model.candidate[:, script].any() else total - (0 if model.candidate[k][script] else FOREIGN))
        columns.append(column)
    for column in columns:
        if best is None:
            best = column
            continue
        step = [max(range(n), key=lambda j: best[j] - model.switch * (j != k)) for k in range(n)]
        back.append(step)
        best = [best[step[k]] - model.switch * (step[k] != k) + column[k] for k in range(n)]
    path = [max(range(n), key=lambda k: best[k])]
    for step in reversed(back):
        path.insert(0, step[path[0]])
    letters = {k: sum(len(w) for w, x in zip(words, path) if x == k) for k in range(n)}
    top = max(range(n), key=lambda k: letters[k])
    likely = sum(c[k] if model.candidate[:, table[ord(w[0])]].any() else float(model.table.min()) * len(w) for w, c, k in zip(words, columns, path))
    total = sum(letters.values())
    expected = [sum(float(np.exp(np.float64(x))) * float(x) for x in row) for row in model.table]
    spans = [(len(list(g)), model.languages[k]) for k, g in itertools.groupby(path)]
    return model.languages[top], letters[top] / total, (likely - sum(letters[k] * expected[k] for k in range(n))) / total, spans


def test_whole_texts_against_a_plain_version(spark, monkeypatch):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    model = learn(spark.createDataFrame(list(docs.values())))
    assert model.table.shape == (4, BUCKETS)
    r = random.Random(3)
    some = [docs[d].text for d in r.sample(sorted(docs), 25)]
    texts = [" ".join(t.split()[:120]) for t in some]
    texts += [" ".join(" ".join(t.split()[:30]) for t in r.sample(some, 3)) for _ in range(15)] + ["Лиса ДОМ the", "字 x", "all human beings are born free"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for most in (langid.CHUNK_CHARS, 25):  # the second: nearly all texts are scored in parts
        monkeypatch.setattr(langid, "CHUNK_CHARS", most)
        got = identify(frame, model).collect()
        for g in got:
            lang, score, fit, spans = plain_label(model, g.text)
            assert (g.lang_pred, [(s.words, s.lang) for s in g.spans]) == (lang, spans)
            assert g.score == pytest.approx(score) and g.fit == pytest.approx(fit, abs=1e-3)


def test_fit_tells_languages_that_were_not_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = learn(docs)
    usual = identify(docs, model).where("length(text) > 100").agg(F.expr("percentile(fit, 0.01)"), F.avg("fit")).first()
    assert usual[0] > -1 and abs(usual[1]) < 0.3
    texts = ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności", "Все люди рождаются свободными и равными в своем достоинстве"]
    assert all(r.fit < -5 for r in identify(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect())
