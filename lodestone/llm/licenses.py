"""License scans: ordered signature rules over normalised words, with Spark expressions only."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrays import let, running

#: Words are runs of digits, a-z and everything beyond ASCII.
WORD, GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The phrases whose places are counted, and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Strings within a word: a lowered text that a rule matches holds one of them, or UNDER matches it.
GATE = ["licen", "copyright", "spdx", "creative", "domain", "warrant", "reserved", "hereby", "redistribution"]
#: How a text names a license after "under" without a string of GATE; all of it stands in a text that such a rule matches.
VERBS = "licensed|released|distributed|available|provided|published|offered|covered|redistributed"
UNDER = rf"(?:{VERBS}){GAP}(?:{WORD}{GAP})?under{GAP}"

#: Licenses: label, name as words (a regular expression), keywords of which every name holds one, slugs in SPDX tags and addresses.
FAMILIES = [
    ("mit", "(?:mit|expat|mit expat|x11 mit)", "mit|expat", "mit"),
    ("mit-0", "mit (?:0|no attribution)", "mit", "mit 0"),
    ("x11", "x11", "x11", "x11"),
    ("apache-1.0", "apache(?: software)?(?: license)?(?: version| v)? 1 0", "apache", "apache 1 0"),
    ("apache-1.1", "apache(?: software)?(?: license)?(?: version| v)? 1 1", "apache", "apache 1 1"),
    ("apache-2.0", "apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?", "apache", "apache 2 0"),
    ("gpl-1.0", "(?:gnu )?(?:gpl|general public license)(?: version| v)? ?1(?: 0)?", "gpl|general public", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "(?:gnu )?(?:gpl|general public license)(?: version| v)? ?2(?: 0)?", "gpl|general public", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "(?:gnu )?(?:gpl|general public license)(?: version| v)? ?3(?: 0)?", "gpl|general public", "gpl 3 0(?: only| or later)?"),
    ("lgpl-2.0", "(?:gnu )?(?:lgpl|library general public license)(?: version| v)? ?2(?: 0)?", "lgpl|library general", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "(?:gnu )?(?:lgpl|lesser general public license)(?: version| v)? ?2 1", "lgpl|lesser general", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "(?:gnu )?(?:lgpl|lesser general public license)(?: version| v)? ?3(?: 0)?", "lgpl|lesser general", "lgpl 3 0(?: only| or later)?"),
    ("agpl-3.0", "(?:gnu )?(?:agpl|affero general public license)(?: version| v)? ?3(?: 0)?", "agpl|affero", "agpl 3 0(?: only| or later)?"),
    ("gfdl-1.3", "(?:gnu )?(?:gfdl|free documentation license)(?: version| v)? ?1(?: [0-9])?", "gfdl|free documentation", "gfdl 1 3(?: only| or later)?"),
    ("bsd-2-clause", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)", "bsd", "bsd 2 clause"),
    ("bsd-3-clause", "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)", "bsd", "bsd 3 clause"),
    ("bsd-4-clause", "(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)", "bsd", "bsd 4 clause"),
    ("0bsd", "(?:0bsd|zero clause bsd|bsd zero clause)", "bsd", "0bsd"),
    ("isc", "isc", "isc", "isc"),
    ("mpl-1.1", "(?:mpl|mozilla public license)(?: version| v)? ?1 1", "mpl|mozilla", "mpl 1 1"),
    ("mpl-2.0", "(?:mpl|mozilla public license)(?: version| v)? ?2(?: 0)?", "mpl|mozilla", "mpl 2 0"),
    ("epl-1.0", "(?:epl|eclipse public license)(?: version| v)? ?1(?: 0)?", "epl|eclipse", "epl 1 0"),
    ("epl-2.0", "(?:epl|eclipse public license)(?: version| v)? ?2(?: 0)?", "epl|eclipse", "epl 2 0"),
    ("eupl-1.2", "(?:eupl|european union public licen[cs]e)(?: version| v)? ?1 2", "eupl|european union", "eupl 1 2"),
    ("cddl-1.0", "(?:cddl|common development and distribution license)(?: version| v)? ?1(?: 0)?", "cddl|common development", "cddl 1 0"),
    ("cpl-1.0", "(?:cpl|common public license)(?: version| v)? ?1(?: 0)?", "cpl|common public", "cpl 1 0"),
    ("artistic-2.0", "(?:perl )?artistic(?: license)?(?: version| v)? ?2(?: 0)?", "artistic", "artistic 2 0"),
    ("bsl-1.0", "boost software(?: license)?(?: version| v)? ?1(?: 0)?", "boost", "bsl 1 0"),
    ("busl-1.1", "business source(?: license)?(?: version| v)? ?1 1", "business", "busl 1 1"),
    ("zlib", "(?:zlib|zlib libpng)", "zlib", "zlib"),
    ("unlicense", "(?:the )?unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("python-2.0", "(?:python software foundation|psf)(?: license)?(?: version| v)? ?2(?: 0)?", "psf|python software", "python 2 0"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl", "openssl"),
    ("ofl-1.1", "(?:sil )?(?:ofl|open font license)(?: version| v)? ?1 1", "ofl|open font", "ofl 1 1"),
    ("ms-pl", "(?:microsoft|ms) (?:public license|pl)", "ms p|microsoft p", "ms pl"),
    ("odbl-1.0", "(?:odbl|open(?: data commons)? (?:open )?database license)(?: version| v)?(?: 1 0)?", "odbl|database", "odbl 1 0"),
    ("odc-by-1.0", "(?:odc by|open data commons attribution license)(?: version| v)?(?: 1 0)?", "odc by|data commons", "odc by 1 0"),
    ("cc0-1.0", "(?:cc0|cc zero|creative commons zero)(?: universal)?(?: version| v)?(?: 1 0)?", "cc0|cc zero|commons zero", "(?:cc0|publicdomain zero|zero) 1 0"),
    *(
        (f"cc-{code.replace(' ', '-')}-{version}", f"(?:cc|creative commons) (?:{code}|{words})(?: version| v)? {version.replace('.', ' ')}(?: international| unported| license)*", "cc|creative commons", f"(?:cc )?{code} {version.replace('.', ' ')}")
        for code, words in [("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nc", "attribution non ?commercial"), ("by nd", "attribution no ?deriv(?:s|atives)"), ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc nd", "attribution non ?commercial no ?deriv(?:s|atives)")]
        for version in ("2.0", "3.0", "4.0")
    ),
]

#: Ways to name a license: priority (1 goes first), confidence, pattern of name or slug, keyword beside the name's.
FORMS = [
    (1, 0.99, "spdx license identifier {slug}", "spdx"),
    (1, 0.95, f"(?:{VERBS})(?: [^ ]+)? under(?: the)?(?: terms)?(?: and conditions)?(?: of)?(?: the| a)? {{name}}(?: licen[cs]e)?", "under"),
    (1, 0.95, "(?:opensource org licenses|spdx org licenses|gnu org licenses|apache org licenses|creativecommons org licenses|creativecommons org) {slug}", "org"),
    (2, 0.8, "(?:licen[cs]e|licen[cs]ed|licen[cs]es)(?: is| type)? {name}", "licen"),
    (2, 0.7, "{name}(?: public| open source)? licen[cs]e", "licen"),
]

#: Rules of their own: priority, label, confidence, pattern, keyword.
SINGLE_RULES = [
    (2, "gpl", 0.7, "(?:gnu )?general public license", "general public"),
    (2, "lgpl", 0.7, "(?:gnu )?(?:lesser|library) general public license", "general public"),
    (2, "agpl", 0.7, "(?:gnu )?affero general public license", "affero"),
    (2, "apache", 0.7, "apache(?: software)? license", "apache"),
    (2, "bsd", 0.6, "bsd(?: style)? licen[cs]e", "bsd"),
    (2, "mpl", 0.6, "mozilla public license", "mozilla"),
    (2, "public-domain", 0.7, "(?:dedicated to|released into|placed in|in) the public domain", "public domain"),
    (2, "cc", 0.5, "creative commons(?: [^ ]+){0,3} licen[cs]e", "creative commons"),
    (3, "proprietary", 0.6, "all rights reserved", "rights reserved"),
    (3, "copyright", 0.3, "copyright(?: c)? (?:19|20)[0-9]{2}", "copyright"),
    (3, "warranty-disclaimer", 0.4, "without warrant(?:y|ies) of any kind", "warrant"),
    (3, "permissive", 0.4, "permission is hereby granted free of charge", "permission is hereby"),
    (3, "permissive", 0.4, "redistribution and use in source and binary forms", "redistribution and use"),
    (3, "other-license", 0.2, "(?:licensed|released|distributed) under(?: the)?(?: terms)?(?: of)?(?: the)? [^ ]+(?: [^ ]+)? licen[cs]e", "under"),
]


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    confidence: float
    pattern: str
    keyword: str
    names: tuple[str, ...] = ("",)


def rules() -> list[Rule]:
    """Every license in every form, then the single rules; whole words only."""
    whole = lambda p: f"(?<![^ ])(?:{p})(?![^ ])"
    made = []
    for priority, confidence, form, beside in FORMS:
        for label, name, keyword, slug in FAMILIES:
            names = tuple(keyword.split("|")) if "{name}" in form else ("",)
            made.append(Rule(priority, label, confidence, whole(form.format(name=name, slug=slug)), beside, names))
    return made + [Rule(p, label, c, whole(pattern), k) for p, label, c, pattern, k in SINGLE_RULES]


def _word_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.filter(F.split(text, " "), lambda w: w != "")))


def _places(norm: Column, pattern: Column) -> Column:
    """First word and word behind the last one of each match of pattern in words joined by blanks."""
    between, found = F.split(norm, pattern, -1), F.regexp_extract_all(norm, pattern, F.lit(0))
    counts = F.zip_with(F.transform(between, _word_count), F.transform(found, _word_count), lambda a, b: F.struct(a.alias("gap"), F.coalesce(b, F.lit(0)).alias("size")))

    def placed(c: Column) -> Column:
        starts = running(F.transform(c, lambda x: x["gap"] + x["size"]), F.lit(0), lambda a, b: a + b, "int")
        every = F.zip_with(c, starts, lambda x, at: F.struct((at + x["gap"]).alias("first"), (at + x["gap"] + x["size"]).alias("behind")))
        return F.filter(every, lambda h: h["behind"] > h["first"])

    return let(counts, placed)


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda h: F.struct(h["first"].alias("first"), h["behind"].alias("behind"), F.lit(label).alias("label")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections), one row per input row.

    Texts with A-Z lowered are cut into words. n_base counts the places of the base phrases, first_word and
    last_word are their smallest and largest starts in words from 0, null if there is none. Texts that no rule can match, as
    they hold none of its words, are not looked at further. A rule runs where its own keywords stand, which all it matches holds.
    Of all matches in order of start, longer first, then priority, one goes if an earlier one of the same or a
    higher priority contains it. detections are those left: first, behind (in words), priority, label, confidence.
    labels are theirs and the base labels, score is their highest confidence, 0 if there is none.

    Null text counts as empty. A null id is carried on; repeated rows each give a row. Other columns are ignored.
    """
    # one literal: three hundred structs of literals would take the optimizer seconds
    listed = F.from_json(F.lit(json.dumps([asdict(r) for r in rules()])), "array<struct<priority:int,label:string,confidence:double,pattern:string,keyword:string,names:array<string>>>")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.select("doc_id", "text", F.lower("text").alias("low"))
    gate = F.lit(False)
    for word in GATE:
        gate = gate | F.col("low").contains(word)
    gate = gate | (F.col("low").contains("under") & F.col("low").rlike(UNDER))
    texts = texts.select("doc_id", "text", gate.alias("gated"))
    n_words = F.size(F.regexp_extract_all("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"), F.lit(0)))
    norm = F.when(F.col("gated"), F.array_join(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0)), " "))
    texts = texts.select("doc_id", n_words.cast("long").alias("n_words"), norm.alias("norm"))

    nothing = F.array().cast("array<struct<first:int,behind:int,label:string>>")
    base = F.flatten(F.array(*(_labelled(_places(F.col("norm"), F.lit(f"(?<![^ ]){phrase}(?![^ ])")), label) for phrase, label in BASE_PHRASES.items())))
    runs = lambda r: F.col("norm").contains(r["keyword"]) & F.exists(r["names"], lambda n: F.col("norm").contains(n))
    hits = F.flatten(F.transform(F.filter(listed, runs), lambda r: F.transform(_places(F.col("norm"), r["pattern"]), lambda h: F.struct(h["first"].alias("first"), (-h["behind"]).alias("until"), r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence")))))
    hit = "array<struct<first:int,until:int,priority:int,label:string,confidence:double>>"
    texts = texts.select("doc_id", "n_words", F.when(F.col("norm").isNull(), nothing).otherwise(base).alias("base"), F.when(F.col("norm").isNull(), F.array().cast(hit)).otherwise(F.array_sort(hits)).alias("hits"))

    # ends that matches of priority 1, up to 2, and up to 3 have reached before each match
    none = F.struct(*(F.lit(-1).alias(f"p{k}") for k in (1, 2, 3)))
    ends = F.transform("hits", lambda h: F.struct(*(F.when(h["priority"] <= k, -h["until"]).otherwise(-1).alias(f"p{k}") for k in (1, 2, 3))))
    reached = running(ends, none, lambda a, b: F.struct(*(F.greatest(a[f"p{k}"], b[f"p{k}"]).alias(f"p{k}") for k in (1, 2, 3))), "struct<p1:int,p2:int,p3:int>")
    seen = F.zip_with("hits", reached, lambda h, r: F.struct(h.alias("hit"), F.when(h["priority"] == 1, r["p1"]).when(h["priority"] == 2, r["p2"]).otherwise(r["p3"]).alias("end")))
    kept = F.transform(F.filter(seen, lambda x: x["end"] < -x["hit"]["until"]), lambda x: x["hit"])
    texts = texts.select("doc_id", "n_words", "base", kept.alias("kept"))
    names = lambda array: F.transform(array, lambda h: h["label"])
    joined = lambda array: F.array_join(F.array_sort(F.array_distinct(array)), ",")
    starts = F.transform("base", lambda h: h["first"].cast("long"))
    return texts.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(names("base")).alias("base_labels"),
        joined(F.concat(names("base"), names("kept"))).alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda h: h["confidence"])), F.lit(0.0)).alias("score"),
        F.transform("kept", lambda h: F.struct(h["first"].alias("first"), (-h["until"]).alias("behind"), h["priority"].alias("priority"), h["label"].alias("label"), h["confidence"].alias("confidence"))).alias("detections"),
    )
