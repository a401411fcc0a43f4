import random
import re
import time

from brute import lower

from lodestone.llm.licenses import BASE_PHRASES, FAMILIES, FORMS, GATE, SINGLE_RULES, rules, scan_licenses

LINES = [
    "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "Copyright (c) 2021 X. All rights reserved.",
    "see https://opensource.org/licenses/MIT", "mit license apache license mit licence general public license", "Das ist mit Lizenz", "MIT\tLICENSE MIT-LICENSE",
    "Licensed under the Foo License", "3-clause BSD license", "permission is hereby granted, free of charge", "Éxpat licençe CC0 1.0", "unlicense", "licensed under mİt license",
]


def plain(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    norm = " ".join(words)
    base = [(i, label) for phrase, label in BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    hits = []
    for r in rules():
        if any(g in text.lower() for g in GATE) and r.keyword in norm and any(n in norm for n in r.names):
            for m in re.finditer(r.pattern, norm):
                hits.append((len(norm[: m.start()].split()), len(norm[: m.end()].split()), r.priority, r.label, r.confidence))
    hits.sort(key=lambda h: (h[0], -h[1], *h[2:]))
    kept = [h for i, h in enumerate(hits) if not any(o[1] >= h[1] and o[2] <= h[2] for o in hits[:i])]
    starts = [i for i, _ in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted({x for _, x in base} | {h[3] for h in kept})), max([h[4] for h in kept], default=0.0), kept)


def test_the_scan_matches_a_plain_one(spark):
    rows = [(i, t) for i, t in enumerate([*LINES, "", None, " ".join(LINES), "\n".join(LINES * 40), "mit " * 50_000 + "license", "x " * 30 + LINES[3]])]
    rows += [(None, LINES[0]), (0, LINES[0])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as norm", "2 as base", "'x' as labels")
    got = sorted((str(r.doc_id), tuple(r)[1:8] + ([tuple(d) for d in r.detections],)) for r in scan_licenses(frame).collect())
    want = sorted((str(d), plain(t or "")) for d, t in rows)
    for g, w in zip(got, want, strict=True):
        assert g == w
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rules_are_many_and_tell_licenses_apart(spark):
    assert len(rules()) > 250
    texts = {t: r.labels for t, r in zip(LINES, scan_licenses(spark.createDataFrame(list(enumerate(LINES)), "doc_id long, text string")).orderBy("doc_id").collect(), strict=True)}
    assert texts[LINES[0]] == "mit"
    assert texts[LINES[1]] == "cc-by-nc-4.0"
    assert texts[LINES[2]] == "apache,apache-2.0"
    assert texts[LINES[3]] == "gpl,gpl-3.0"
    assert texts[LINES[4]] == "gpl-3.0"
    assert texts[LINES[8]] == ""


def test_gate_and_keywords_lose_nothing(spark, monkeypatch):
    """The scan against the rules run on all texts, without gate and keywords."""
    r = random.Random(5)
    words = sorted({w for _, name, _, slug in FAMILIES for w in re.findall("[a-z0-9]+", f"{name} {slug}")} | {w for f in [*FORMS, *SINGLE_RULES] for w in re.findall("[a-z0-9]{2,}", str(f))} | {"Été", "Foo"})
    names = ["MIT", "Expat", "Apache 2.0", "BSD 3-clause", "MPL 2.0", "CC_BY 4.0", "CC\nBY 4.0", "GPL v3", "ISC", "zlib", "MS-PL", "the Unlicense"]
    verbs = ["Released", "DISTRIBUTED", "available", "published", "offered now", "covered İx", "redistributed", "Licensed"]
    texts = ["Released under MIT.", "Released under Apache 2.0", "distributed under the terms of BSD 3-clause", "released under the ISC"]
    texts += [f"{v}{gap}under{gap}{the}{n}." for v in verbs for n in names for gap, the in [(" ", "the "), ("\n", ""), (" -- ", "the terms of the ")]]
    texts += [f"licensed under the {n} License" for n in names] + [f"{n} Licence" for n in names] + [f"License: {n}" for n in names]
    texts += [" ".join(r.choice(words) for _ in range(r.randint(2, 60))) for _ in range(200)]
    got = {d.doc_id: tuple(d)[1:8] + ([tuple(x) for x in d.detections],) for d in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    monkeypatch.setitem(globals(), "GATE", [""])
    monkeypatch.setitem(globals(), "rules", lambda made=rules(): [type(x)(x.priority, x.label, x.confidence, x.pattern, "") for x in made])
    for i, t in enumerate(texts):
        assert got[i] == plain(t), t
    assert [got[i][5] for i in range(4)] == ["mit", "apache-2.0", "bsd-3-clause", "isc"]
    by_text = {t: got[i][5] for i, t in enumerate(texts)}
    assert by_text["licensed under the Expat License"].split(",")[0] == "mit"
    assert by_text["Released under the CC_BY 4.0."] == "cc-by-4.0"


def test_time_grows_with_the_matches(spark):
    """Twice the mentions in one text take at most 2.5 times as long."""
    took, found = [], []
    for n in (8_000, 16_000):
        frame = spark.createDataFrame([(1, "under the mit license and x " * n)], "doc_id long, text string")
        scan_licenses(frame).collect()
        began = time.time()
        found.append(scan_licenses(frame).first())
        took.append(time.time() - began)
    assert [r.n_base for r in found] == [8_000, 16_000] and found[1].last_word == 15_999 * 6 + 2
    assert took[1] <= 2.5 * took[0] + 1
