import datetime
import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions import records as X
from lodestone.functions import text as T
from lodestone.operators import evidence as E
from lodestone.operators import postings as P
from lodestone.operators import ranking as R
from lodestone.operators import segmentation as G
from lodestone.operators.percolate import Percolator, percolate, positive_words
from lodestone.operators.querytext import condition, matching, program
from lodestone.operators import validation as V
from lodestone.plans.expansion import tiered_queries, within_years, year_window
from lodestone.plans.evidence import RunCounts, passages, search, sub_queries
from lodestone.plans import report
from lodestone.plans.judging import STRICT, Retrying, ask, cited_ids, filled, judge_batches, model_queries, payloads, plan, rendered
from lodestone.scratch import materialize, tidy
from lodestone.sources import corpus as C
from lodestone.sources.articles import article_paragraphs, paragraphs_of, sections_of, store_full_texts, with_full_text, with_sections
from lodestone.sources.chat import ChatModel, assistant_text, endpoint_url, replies, reply_text, wait_seconds
from lodestone.sources.remote import SearchReader, SubQuery, remote_records
from lodestone.streaming.ingest import arriving_paragraphs, checked_clauses, first_hits

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


NO_TERMS = "Query does not contain any searchable terms"
QUERIES = [
    ("cancer AND therapy", []),
    ('title:"x y"', []),
    ("-toxicity and cells", []),
    ("CITED:[100 TO *]", []),
    ("PUB_YEAR:[2020 TO 2021] AND LANG:eng", []),
    ("", ["Query is empty or None"]),
    ("   ", ["Query is empty or None"]),
    ("Alzheimer's disease", ["Unmatched single quotes in query"]),
    ('TITLE:"open', ["Unmatched double quotes in query"]),
    ('"a*"', ['Wildcard not allowed in quotes: "a*"']),
    ("NOPE:x", ["Invalid field tag 'NOPE'"]),
    ("TITLE : x", ["Field tag 'TITLE' has invalid spacing before colon", "Field tag 'TITLE' has invalid spacing after colon"]),
    ("TITLE:", ["Field tag is missing a value", "Field tag 'TITLE' is missing a value"]),
    ("TITLE:()", ["Field tag 'TITLE' is missing a value"]),
    ("HAS_FT:Y cancer", ["Invalid syntax: HAS_FT:Y cancer - multi-word field values must use quotes or parentheses", "Invalid value for HAS_FT: 'Y cancer' - must use Y or N"]),
    ("HAS_FT:(Y)", ["Invalid value for HAS_FT: '(Y)' - must use Y or N"]),
    ("SRC:xyz", ["Invalid value for SRC: 'XYZ'"]),
    ("ACCESSION_TYPE:pdb AND ACCESSION_TYPE:pdx", ["Invalid value for ACCESSION_TYPE: 'pdx'"]),
    ("ANNOTATION_TYPE:gene", ["Invalid value for ANNOTATION_TYPE: 'gene'"]),
    ("AUTHORID_TYPE:orcid AND AUTHORID_TYPE:x", ["Invalid value for AUTHORID_TYPE: 'X'"]),
    ('AUTHOR_ROLES:"Writing – Original  Draft"', []),
    ("LANG:ger", ["Invalid value for LANG: 'ger'"]),
    ('LICENSE:"by nc sa" OR LICENSE:mit', ["Invalid value for LICENSE: 'mit'"]),
    ("PUB_YEAR:2020-01-01", ["Invalid value for PUB_YEAR: '2020-01-01' - expected YYYY"]),
    ("E_PDATE:2020-02-30", ["Invalid value for E_PDATE: '2020-02-30' - expected YYYY or YYYY-MM-DD"]),
    ("PUB_YEAR:[2021 TO 2020]", ["Invalid range for PUB_YEAR: start '2021' is after end '2020'"]),
    ("FIRST_PDATE:[2020-06-01 TO 2020]", ["Invalid range for FIRST_PDATE: start '2020-06-01' is after end '2020'"]),
    ("PUB_YEAR:[2020]", ["Invalid range for PUB_YEAR: '[2020]' - use [start TO end]"]),
    ("PUB_YEAR:[x to *]", ["Invalid range start for PUB_YEAR: 'x'"]),
    ("DOI:10.1000/a,10.1000/b", ["Multiple comma-separated values are not allowed for field 'DOI'"]),
    ("AUTHORID:0000-0001-0002-000x", ["Invalid AUTHORID format: '0000-0001-0002-000x'"]),
    ("CITES:IND43_agr AND CITES:x_foo AND CITES:bad", ["Invalid source suffix in CITES: 'x_foo'", "Invalid CITES format: 'bad' - expected identifier_source"]),
    ("PMCID:pmc12 AND PMCID:12", ["Invalid PMCID format: '12'"]),
    ("ISSN:1234-567x AND ESSN:12", ["Invalid ESSN format: '12'"]),
    ("ISBN:978-1234567890 AND ISBN:12", ["Invalid ISBN format: '12'"]),
    ("DOI:11.1/x", ["Invalid DOI format: '11.1/x'"]),
    ("BOOK_ID:NBK1 AND BOOK_ID:1", ["Invalid BOOK_ID format: '1'"]),
    ("AUTH_MAN_ID:EMS123 AND AUTH_MAN_ID:1", ["Invalid AUTH_MAN_ID format: '1'"]),
    ('TITLE:"a*"', ['Wildcard not allowed in quotes: "a*"', "Wildcards are not allowed inside quotes for field 'TITLE'"]),
    ("BOOK_ID:NBK1*", ["Invalid BOOK_ID format: 'NBK1*'", "Wildcards are not allowed for field 'BOOK_ID'"]),
    ("E_PDATE:202?", ["Invalid value for E_PDATE: '202?' - expected YYYY or YYYY-MM-DD", "Question-mark wildcards are not allowed for field 'E_PDATE'"]),
    ("E_PDATE:202*", ["Invalid value for E_PDATE: '202*' - expected YYYY or YYYY-MM-DD", "Wildcards are only allowed in date ranges for field 'E_PDATE'"]),
    ("MESH:*", ["Wildcard-only presence checks are not allowed for field 'MESH' - use ANNOTATION_TYPE or HAS_TM when you mean annotation presence"]),
    ("(a AND b", ["Unmatched parentheses in query"]),
    ("TITLE:[a", ["Unmatched brackets in query", "Field tag 'TITLE' is missing a value"]),
    ("a AND", ["Operator 'AND' is missing a right-hand operand"]),
    ("a OR", ["Operator 'OR' is missing a right-hand operand"]),
    ("a NOT", ["Illegal NOT placement"]),
    ("NOT NOT a", ["Illegal NOT placement", "Unexpected token 'NOT'", NO_TERMS]),
    ("AND a", ["Unexpected token 'AND'", "Unexpected token 'a'", NO_TERMS]),
    ("a OR OR b", ["Operator 'OR' is missing a right-hand operand", "Unexpected token 'OR'"]),
    ("x AND AND y", ["Operator 'AND' is missing a right-hand operand", "Unexpected token 'AND'"]),
    ("(AND a)", ["Unexpected token 'AND'", "Unmatched parentheses in query", "Unexpected token ')'"]),
    ("(a OR)", ["Operator 'OR' is missing a right-hand operand"]),
    ("(a))(b", ["Unexpected token ')'"]),
    ("TITLE:((a OR (b AND (c))))", []),
    ('TITLE:"x" (a OR b) NOT c', []),
    ("NOT (a OR b) AND NOT c", []),
    ('"a""b" AND x y', []),
    ("NOT", ["Illegal NOT placement", NO_TERMS]),
    ('SRC:"MED', ["Unmatched double quotes in query", "Invalid value for SRC: '\"MED'"]),
    ("]", ["Unexpected closing bracket", NO_TERMS]),
    ("a ]", ["Unexpected token ']'"]),
    ("(a ]", ["Unmatched parentheses in query", "Unexpected token ']'"]),
    ("[a", ["Unexpected token '['", "Unexpected token 'a'", NO_TERMS]),
    ("()", ["Empty group '()' is not allowed"]),
    (")", ["Unexpected closing parenthesis", NO_TERMS]),
    ("TITLE: AND b", ["Field tag is missing a value", "Field tag 'TITLE' is missing a value"]),
    ("a AND (b", ["Unmatched parentheses in query"]),
    ("TITLE:((((((((a OR b))))))))", []),
    ("TITLE:" + "(" * 5000 + "a OR b" + ")" * 5000, []),
    ("TITLE:(a OR BOGUS:y)", ["Invalid field tag 'BOGUS'"]),
    ("TITLE:(a OR PUB_YEAR:20x)", ["Invalid value for PUB_YEAR: '20x' - expected YYYY"]),
    ("NOPE:(SRC:q OR (LANG:ger))", ["Invalid value for SRC: 'Q'", "Invalid value for LANG: 'ger'", "Invalid field tag 'NOPE'"]),
    ("TITLE:(a BOGUS:y)", []),
    ("NOT ] a", ["Unexpected closing bracket", "Operator 'NOT' is missing an operand", "Unexpected token 'a'", NO_TERMS]),
    ("(OR)", ["Unexpected token 'OR'", "Grouped expression is empty"]),
    ("(]) OR b", ["Unexpected closing bracket", "Grouped expression is empty"]),
    ("TITLE:(a OR) AND AUTH:(b NOT) c OR", ["Operator 'OR' is missing a right-hand operand", "Illegal NOT placement", "Operator 'OR' is missing a right-hand operand"][:2]),
    ("TITLE:(a AND (b) c", ["Unmatched parentheses in query"]),
    ("a OR ] b", ["Unexpected closing bracket", "Unexpected token 'b'"]),
    ("TITLE:NOT x AND TITLE:] y", ["Unexpected token ']'", "Invalid syntax: TITLE:NOT x - multi-word field values must use quotes or parentheses", "Field tag 'TITLE' is missing a value"]),
    ("TITLE :", ["Field tag is missing a value", "Field tag 'TITLE' is missing a value"]),
]


def test_queries_are_checked(spark):
    rows = [(i, q) for i, (q, _) in enumerate(QUERIES)] + [(1000, None)]
    got = {r.query_id: r for r in V.validate(spark.createDataFrame(rows, "query_id long, query string")).collect()}
    for i, (q, want) in enumerate(QUERIES):
        assert got[i].reasons == want, q
        assert got[i].valid == (not want)
    assert got[1000].reasons == ["Query is empty or None"]


def test_companions_usable_and_summary(spark):
    rows = [(1, 1, "GRANT_ID:1 AND EXT_ID:2 AND INVESTIGATOR:x AND ISSUE:3 AND VOLUME:1"), (2, 1, "NOPE:x"), (3, 2, "NOPE:y")]
    frame = spark.createDataFrame(rows, "query_id long, question long, query string")
    checked = V.validate(frame)
    assert [w.split()[0] for w in checked.where("query_id = 1").first().warnings] == ["GRANT_ID", "EXT_ID", "INVESTIGATOR", "ISSUE"]
    assert sorted(r.query_id for r in V.usable(checked.join(frame.select("query_id", "question"), "query_id"), "question").collect()) == [1, 3]
    assert tuple(V.summary(checked).first()) == ("fail", 3, 1, 2)
    assert tuple(V.summary(checked.where("query_id = 1")).first()) == ("pass", 1, 1, 0)
    assert tuple(V.summary(checked.limit(0)).first()) == ("fail", 0, 0, 0)


ARTICLE = """<a:article xmlns:a="urn:x"><front><p>front</p></front><a:body><sec sec-type=" Methods "><title>Ways <i>of</i> work</title>
<p>One <b>bold</b>  text</p><p>Outer <p>inner</p> end</p><p>Before <table-wrap><label>T1</label><caption><p>About it</p></caption><table><tr><td>a</td><td/></tr><tr><th>b</th><td>c</td></tr></table></table-wrap>after</p>
<sec sec-type="My-References"><p>no</p></sec><sec><p>deep</p><p>deep</p></sec></sec><sec sec-type="FUNDING"><p>no</p></sec></a:body><sub><body><p>second</p></body></sub></a:article>"""


def test_article_paragraphs(spark):
    m = ("Ways of work", "Methods")
    want = [("One bold text", *m), ("Outer inner end", *m), ("inner", *m), ("Before after", *m), ("T1. About it. a ; b | c", *m), ("About it", *m), ("deep", "", ""), ("second", "", "")]
    assert paragraphs_of(ARTICLE) == want
    assert paragraphs_of("<r><p>no body</p><back><p>x</p></back></r>") == [("no body", "", "")]
    assert [paragraphs_of(x) for x in ("", None, "<a>&nbsp;</a>", "<a><p>", "text")] == [[]] * 5
    got = article_paragraphs(spark.createDataFrame([(1, ARTICLE), (2, None), (3, "<r><p>q</p></r>")], "doc_id long, xml string")).collect()
    assert [(r.doc_id, r.para_idx, r.text) for r in got] == [(1, k, w[0]) for k, w in enumerate(want)] + [(3, 0, "q")]


def test_judging_splits_broken_batches(spark):
    calls = []

    def judge(payload):
        papers = json.loads(payload)
        calls.append(len(papers))
        return "broken" if len(papers) > 2 else json.dumps({"relevant_ids": [p["id"] for p in papers]})

    papers = [{"id": str(k)} for k in range(8)]
    assert ask(judge, papers) == [str(k) for k in range(8)]
    assert calls == [8, 4, 2, 2, 4, 2, 2]
    assert ask(lambda _: "broken", papers) == [] and ask(lambda _: '{"relevant_ids": []}', papers) == []
    assert cited_ids('Sure:\n```json\n{"relevant_ids": [1, "b"]}\n```') == ["1", "b"]
    assert cited_ids('["x"]') is None and cited_ids('{"relevant_ids": "x"}') is None and cited_ids("") is None
    rows = [(1, k // 2, k, json.dumps({"id": f"s{k}"})) for k in range(5)]
    got = judge_batches(spark.createDataFrame(rows, "question_id long, batch long, cand_pos long, paper string"), lambda p: json.dumps({"relevant_ids": [x["id"] for x in json.loads(p)][::-1]}))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 0, "s1"), (1, 0, 1, "s0"), (1, 1, 0, "s3"), (1, 1, 1, "s2"), (1, 2, 0, "s4")]


def test_planning_by_a_model(spark):
    asked = []

    def second_time(prompt):
        asked.append(prompt)
        return '{"queries": [" a ", "a", "", 3, "b"]}' if prompt.startswith(STRICT) else "no json"

    assert plan(second_time, "why {x}?", 7) == ["a", "3", "b"] and len(asked) == 2 and "why {x}?" in asked[0]
    assert plan(second_time, "q", 2) == ["a", "3"]
    assert plan(lambda _: 1 / 0, " whole question ", 7) == ["whole question"]
    assert filled("{a} {b} {c}", a="{b}", b="x") == "{b} x {c}"
    frame = spark.createDataFrame([(1, "q"), (2, None)], "question_id long, text string")
    got = model_queries(frame, lambda prompt: '{"queries": ["x", "NOPE:y"]}', 7).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, "x"), (1, 1, "NOPE:y"), (2, 0, "x"), (2, 1, "NOPE:y")]


def test_sub_queries_keeps_valid_ones_or_all(spark):
    frame = spark.createDataFrame([(1, "one"), (2, "two")], "question_id long, text string")
    reply = lambda prompt: '{"queries": ["NOPE:x", "fine"]}' if "one" in prompt else '{"queries": ["NOPE:x", "(a"]}'
    assert sorted((r.question_id, r.text) for r in sub_queries(frame, 7, reply).collect()) == [(1, "fine"), (2, "(a"), (2, "NOPE:x")]


def test_bm25_top_gives_the_best_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(R, "DOC_BLOCK", 7)
    monkeypatch.setattr(R, "QUESTION_BLOCK", 3)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, "the of"), (9001, None), (9002, "")], "doc_id long, text string"))
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id as question_id", "text").where("question_id < 8").unionByName(spark.createDataFrame([(100, ""), (101, None), (102, "zzzz")], "question_id long, text string"))
    want = R.top_k(R.bm25_corpus(docs.where("doc_id is not null"), asked), 5, "question_id", F.desc(F.round("score", 9)), "doc_id").collect()
    got = R.bm25_top(docs, asked, 5).collect()
    plain = lambda rows: sorted((r.question_id, r["rank"], r.doc_id, round(r.score, 6)) for r in rows)
    assert plain(got) == plain(want) and len(got) > 20
    assert R.bm25_top(docs, asked.limit(0), 5).count() == 0 and R.bm25_top(docs.limit(0), asked, 5).count() == 0


def test_excerpts_of_many_queries(spark):
    """As by the steps one after the other, for queries that share documents and one that shares no term."""
    d = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 12")
    some = [(f"{q}:{i}", i, t) for i in range(12) for q, t in enumerate((["the", "of"], ["en", "la", "un"], ["zzzz"], []))]
    asked = spark.createDataFrame(some, "pair string, doc_id long, terms array<string>")
    body = asked.select("pair", "doc_id").join(C.paragraphs(d), "doc_id").drop("doc_id").withColumnRenamed("pair", "doc_id")
    steps = R.excerpts(R.within_budget(R.positive_or_all(R.bm25_within(body, asked.select(F.col("pair").alias("doc_id"), "terms"))), 40, "doc_id", "rank"))
    got = {r.pair: r.excerpt for r in R.bm25_excerpts(C.paragraphs(d), asked, 40).collect()}
    assert got == {r.doc_id: r.excerpt for r in steps.collect()} and len(got) == len(some)


def test_payloads_and_reports(spark):
    papers = spark.createDataFrame([(1, "p1", "T", None, "2001"), (2, "p2", "", "A", "")], "doc_id long, paper_id string, title string, authors string, year string")
    sentences = spark.createDataFrame([(1, 1, "1_B", "b"), (1, 0, "1_A", "a")], "doc_id long, sent_idx int, sid string, sentence string")
    got = {r.doc_id: json.loads(r.paper) for r in payloads(papers, sentences).collect()}
    assert got[1] == {"id": "p1", "title": "T", "authors": "N/A", "affiliations": "N/A", "journal": "N/A", "year": "2001", "abstract": [{"id": "1_A", "text": "a"}, {"id": "1_B", "text": "b"}]}
    assert got[2]["title"] == "N/A" and got[2]["authors"] == "A" and got[2]["abstract"] == []
    assert one(spark, rendered(F.lit("{q} on {day}: {q}"), {"q": F.lit("x"), "day": F.lit("d")})) == "x on d: x"
    found = spark.createDataFrame([(1, 2, "p2", "U", "2002", ["y", "z"]), (1, 1, "p1", "T", "2001", ["x"])], "question_id long, final_pos int, paper_id string, title string, year string, evidence array<string>")
    assert [r.line for r in report.lines(found).orderBy("final_pos").collect()] == ["[1] T (2001) p1\n    x", "[2] U (2002) p2\n    y\n    z"]
    assert [p["paper_id"] for p in json.loads(report.as_json(found).first().passages)] == ["p1", "p2"]


def test_text_and_record_expressions(spark):
    assert one(spark, T.sentences(F.lit("One. Two! No end"))) == ["One.", "Two!", "No end"]
    assert one(spark, T.sentences(F.lit("...!"))) == ["...!"] and one(spark, T.sentences(F.lit("  "))) == []
    assert [one(spark, T.sentence_suffix(F.lit(k))) for k in (0, 25, 26)] == ["A", "Z", "S26"]
    assert (T.word_budget(3072), T.word_budget(10)) == (2304, 200)
    assert one(spark, T.squeeze(F.lit(" a \n b "))) == "a b"
    assert one(spark, T.plain_terms(F.lit("AND OR"))) == "AND OR"
    assert one(spark, X.percent_encoded(F.lit("a/b c*~é"))) == "a%2Fb%20c%2A~%C3%A9"
    assert one(spark, X.snippets(F.array().cast("array<string>"), F.array(F.lit(" x "), F.lit(" ")), F.lit("e"), F.lit("a"))) == ["x"]
    assert one(spark, X.snippets(F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), F.lit(""), F.lit(" a "))) == ["a"]
    assert one(spark, X.snippets(F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), F.lit(""), F.lit(None))) == []
    assert one(spark, X.day_key(F.lit("2020"))).isoformat() == "2020-01-01" and one(spark, X.is_day(F.lit("2021-02-29"))) is False


def test_repeated_places_open_spans(spark):
    rows = [(1, 0, "a"), (1, 0, "a"), (1, 2, "b"), (1, 3, "c")]
    got = E.span_ids(spark.createDataFrame(rows, "doc_id long, sent_idx int, sentence string")).orderBy("span", "sent_idx").collect()
    assert [r.span for r in got] == [1, 2, 3, 3]


def test_ids_and_json_files(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" a \n\nb\na\nz")
    (tmp_path / "all.json").write_text('[\n{"id": "a", "n": 1},\n {"id": "c", "n": 2}]')
    ids, records = C.read_ids(spark, str(tmp_path / "ids.txt")), C.read_json_array(spark, str(tmp_path / "all.json"))
    assert [r.n for r in C.with_ids(records, ids).collect()] == [1]
    assert [r.id for r in C.missing_ids(ids, records).collect()] == ["b", "z"]
    C.write_json(records, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("LODESTONE_TOP_K", "5")
    monkeypatch.setenv("LODESTONE_PAGE_SIZE", "many")
    spark.conf.set("lodestone.evidence_words", "9")
    s = Settings.load(spark)
    spark.conf.unset("lodestone.evidence_words")
    assert (s.top_k, s.page_size, s.evidence_words, Settings().top_k) == (5, 50, 9, 60)


def test_passages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    q = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id as question_id", "text").where("question_id < 5")
    stages = []
    got = passages(C.papers(d), C.paragraphs(d), q, Settings(top_k=8, max_full_text=3, max_abstract_only=4), stages.append).collect()
    assert stages == ["search", "excerpt", "judge", "merge"]
    by = {}
    for r in got:
        by.setdefault(r.question_id, []).append(r)
    assert set(by) == {r.question_id for r in q.collect()}
    for rows in by.values():
        rows.sort(key=lambda r: r.final_pos)
        assert [r.final_pos for r in rows] == list(range(1, len(rows) + 1)) and len(rows) <= 8
        assert sum(r.pool == 0 for r in rows) <= 3 and sum(r.pool == 1 for r in rows) <= 4
        assert len({r.paper_id for r in rows}) == len(rows)
        assert all(r.has_excerpt for r in rows if r.pool == 0)
        assert all(sum(len(s.split()) for s in r.evidence) <= 250 for r in rows if r.pool == 0)


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "<r><p>a</p><p>b</p></r>"), (2, "<")], "doc_id long, xml string").write.parquet(str(tmp_path / "in"))
    run = arriving_paragraphs(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert run.awaitTermination(60)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    assert checked_clauses(spark.createDataFrame([(1, "SRC:x")], "query_id long, query string")).first().messages == ["Invalid value for SRC: 'X'"]


@pytest.mark.parametrize("name", ["queries", "oracle_sql"])
def test_entry_points(name):
    import __spark_entry__

    assert len(getattr(__spark_entry__, name)()) > 30


def test_conditions_from_query_texts(spark):
    rows = [(1, "A red fox", "the end", "2001", "x y"), (2, "Red and blue", None, "2010", None), (3, None, "a fox, red", None, "foxes")]
    papers = spark.createDataFrame(rows, "doc_id long, title string, abstract string, year string, text string")
    ask = lambda q: sorted(r.doc_id for r in matching(papers, q).collect())
    assert ask("TITLE:red") == [1, 2] and ask("TITLE_ABS:(red fox)") == [1, 3] and ask('ABSTRACT:"FOX red"') == [3]
    assert ask("TITLE:red NOT TITLE:(fox OR green)") == [2] and ask("PUB_YEAR:[* TO 2005] OR fox*") == [1, 3]
    assert ask("NOT PUB_YEAR:2001") == [2, 3] and ask("x AND y") == [1] and ask("TITLE:r?d AND TITLE:b*") == [2]
    for q in ("", "(a", "a)", "a OR", "AND a", "NOT", "a ]", "AUTH:x", "NOPE:x", "INTRO:x", "PUB_YEAR:[2001]"):
        with pytest.raises(ValueError):
            condition(q, papers.columns)


PAPERS3 = [(1, "Cancer in men", "cancer therapy covid-19 vaccine", "1989"), (2, "Mice", "cancer in mouse mouse", "1995"), (3, "Mouse", "a mouse and cancer", "1990"), (4, None, None, None)]


def papers3(spark):
    return spark.createDataFrame(PAPERS3, "doc_id long, title string, text string, year string")


SEARCHES = [
    ("cancer NOT mouse", [1]), ("mouse AND PUB_YEAR:1990", [3]), ("mouse", [2, 3]), ("mouse zebra", [2, 3]), ("TITLE:mouse", [3]), ('"in mouse"', [2]), ("NOT cancer", [4]), ("PUB_YEAR:[1990 TO *]", [2, 3]),
    ("(mouse OR therapy) AND NOT TITLE:mice", [1, 3]), ("NOT (NOT cancer OR therapy)", [2, 3]), ("covid-19*", [1]), ("covid-1?", [1]), ('"---"', []), ("mous* NOT PUB_YEAR:1995", [3]), ("zebra AND cancer", []),
    ("TITLE:(mouse OR (cancer NOT mice))", [1, 3]), ("NOT PUB_YEAR:1990", [1, 2, 4]),
]


def test_searches_hold_to_the_query(spark):
    """In columns, stored, and as ranked sub-queries."""
    p = papers3(spark)
    stored = percolate(p, spark.createDataFrame([(i, q) for i, (q, _) in enumerate(SEARCHES)], "query_id int, query string")).collect()
    hits = search(p, spark.createDataFrame([(7, i, q) for i, (q, _) in enumerate(SEARCHES)], "question_id long, query_idx int, text string"), 50).collect()
    for i, (q, want) in enumerate(SEARCHES):
        if "zebra" not in q or "AND" in q:
            if q != "mouse zebra":
                assert sorted(r.doc_id for r in matching(p, q).collect()) == want, q
                assert sorted(r.doc_id for r in stored if r.query_id == i) == want, q
        assert sorted(r.doc_id for r in hits if r.query_idx == i) == want, q
    assert [r.doc_id for r in sorted(hits, key=lambda r: r["rank"]) if r.query_idx == 2] == [2, 3]  # twice the word goes first


def test_fields_without_a_column(spark):
    p = papers3(spark)
    with pytest.raises(ValueError):
        percolate(p, spark.createDataFrame([(1, "MESH:x")], "query_id int, query string"))
    asked = spark.createDataFrame([(1, 0, "MESH:mouse"), (1, 1, "TITLE:mouse"), (1, 2, "(mouse")], "question_id long, query_idx int, text string")
    assert sorted((r.query_idx, r.doc_id) for r in search(p, asked, 5).collect()) == [(1, 3), (2, 2), (2, 3)]
    assert [r.doc_id for r in matching(p.withColumn("mesh", F.concat(F.lit("A "), "title")), "MESH:mouse").collect()] == [3]
    for q in ("PUB_YEAR:2020*", "CITED:x", "TITLE:a b", "FIRST_PDATE:[2001-1 TO *]"):
        with pytest.raises(ValueError, match="PUB_YEAR|CITED|TITLE|FIRST_PDATE"):
            condition(q, [*p.columns, "cited", "first_pdate"])


def test_only_conditions_whose_word_a_paper_has_are_evaluated():
    texts = [f"w{k} AND (common OR x{k})" for k in range(300)] + ["x1 OR NOT common", "common w5", "y1 OR y2 OR w7"]
    stored = Percolator({k: program(t) for k, t in enumerate(texts)}, Counter(common=50))
    assert stored.matches({"text text": " common w5 w7 "}) == [5, 7, 301, 302] and stored.evaluated == 5
    assert positive_words(program("a NOT (b OR NOT c) TITLE:(d OR NOT e)")) == ["a", "c", "d"]


def test_stored_conditions_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("lodestone.operators.percolate.BLOCK", 2)
    rows = [(i, q) for i, q in enumerate(["mouse", "cancer", "therapy", "NOT mouse", "zebra"])]
    got = percolate(papers3(spark), spark.createDataFrame(rows, "query_id long, query string")).collect()
    assert sorted(map(tuple, got)) == [(0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (3, 4)]
    assert percolate(papers3(spark), spark.createDataFrame([], "query_id long, query string")).collect() == []


def test_index_reads_less_than_it_stores(spark, monkeypatch, tmp_path):
    """The same best documents as by bm25_top; chunks that can't reach them are left out."""
    monkeypatch.setattr(P, "CHUNK", 4)
    monkeypatch.setattr(P, "FIRST", 3)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, "the of"), (9001, None), (9002, "")], "doc_id long, text string"))
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id as question_id", "text").where("question_id < 12").unionByName(spark.createDataFrame([(100, ""), (101, None), (102, "zzzz")], "question_id long, text string"))
    index = P.build_index(docs, str(tmp_path / "index"))
    for k in (1, 5):
        want = R.bm25_top(docs, asked, k).collect()
        got = P.ranked(P.Index(spark, index.folder), asked, k)
        plain = lambda rows: sorted((r.question_id, r["rank"], r.doc_id, round(r.score, 6)) for r in rows)
        assert plain(got.hits.collect()) == plain(want)
        read, stored = got.read.count(), got.bounds.count()
        assert read < stored and got.read.distinct().count() == read
    assert P.ranked(index, asked.limit(0), 5).hits.count() == 0
    few = P.build_index(docs, None, spark.createDataFrame([("the",)], "term string"))
    assert {r.term for r in few.table("blocks").collect()} == {"the"}


def test_index_finds_phrases(spark):
    docs = spark.createDataFrame([(1, "to be or not to be"), (2, "be to or"), (3, "To be, TO BE!"), (4, None), (5, "not to")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "to be"), (2, "be or not"), (3, "to to"), (4, "--"), (5, "not"), (6, "be to be"), (7, "be to")], "phrase_id long, text string")
    got = sorted(map(tuple, P.phrases(P.build_index(docs), asked).collect()))
    assert got == [(1, 1, 2), (1, 3, 2), (2, 1, 1), (5, 1, 1), (5, 5, 1), (6, 3, 1), (7, 2, 1), (7, 3, 1)]


def test_sentences_by_learned_abbreviations(spark):
    said = ["See Fig. 2 and Fig. 3 for more.", "Doses (e.g. 3.5 mg) were given by Dr. Smith.", "As in Fig. 4, e.g. here. The end.", "J. Doe et al. say no. Is it so? It is!", "One figure. Two. Line\nbreak"]
    filler = [f"The {w} was here, so in the end two of them say more to the {v}. The {v} left a figure for Smith so that no {w} were it." for w in "cat dog cow fox owl hen".split() for v in "man boy girl king".split()]
    texts = spark.createDataFrame([(t,) for t in said * 6 + filler] + [(None,), ("",)], "text string")
    known = {r.word for r in G.abbreviations(texts).collect()}
    assert {"fig", "e.g", "dr", "al"} <= known and not known & {"left", "smith", "end", "two", "here", "more", "so"}
    cut = lambda t: G.split(t, frozenset(known))
    assert cut(said[0]) == [said[0]] and cut(said[1]) == [said[1]] and cut(said[2]) == ["As in Fig. 4, e.g. here.", "The end."]
    assert cut(said[3]) == ["J. Doe et al. say no.", "Is it so?", "It is!"] and cut(said[4]) == ["One figure.", "Two.", "Line", "break"]
    assert cut('He said "No." Then (see Dr. X.) left... Off  he went.') == ['He said "No."', "Then (see Dr. X.) left...", "Off  he went."] and cut("") == [] and cut(" \n ") == []
    rows = spark.createDataFrame([(1, said[2]), (2, None)], "doc_id long, text string")
    assert [r.sentence for r in E.sentence_rows(rows, split=G.splitter(known)).orderBy("sent_idx").collect()] == cut(said[2])


def test_sections_and_full_texts(spark, tmp_path):
    assert sections_of(ARTICLE) == {"methods": "One bold text\nOuter inner end\ninner\nBefore after\nT1. About it. a ; b | c\nAbout it", "other": "deep\nsecond"}
    assert sections_of("<r><sec sec-type='results|discussion'><title>x</title><p>a</p></sec><sec><title>Conclusions</title><p>b</p></sec></r>") == {"results": "a", "discuss": "a", "concl": "b"}
    assert sections_of(None) == {} and sections_of("<") == {}
    deep = "<r><p>" + "<i>" * 20_000 + "x" + "</i>y" * 20_000 + "</p></r>"
    assert [t for t, *_ in paragraphs_of(deep)] == ["x" + "y" * 20_000]
    store_full_texts(spark.createDataFrame([("PMC1", ARTICLE), ("PMC2", "<"), ("PMC9", None)], "pmcid string, xml string"), "full_texts_test", 4, path=str(tmp_path / "t"))
    papers = spark.createDataFrame([(1, "PMC1"), (2, "PMC2"), (3, ""), (4, None), (5, "PMC7"), (6, "PMC1")], "doc_id long, full_text_id string")
    found = with_full_text(papers, spark.table("full_texts_test"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.rindex("Sort") :]
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in scan
    got = {r.doc_id: r.sections for r in with_sections(found).collect()}
    assert len(got) == 6 and got[1] == got[6] == sections_of(ARTICLE) and not any(got[i] for i in (2, 3, 4, 5))
    assert [r.doc_id for r in matching(with_sections(found), 'METHODS:"bold text" NOT RESULTS:x').orderBy("doc_id").collect()] == [1, 6]


def test_a_run_counts_its_stages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    q = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id as question_id", "text").where("question_id < 5")
    counts = RunCounts(spark)

    def judge(prompt):
        raise OSError("no model")

    got = passages(C.papers(d), C.paragraphs(d), q, Settings(top_k=8), planner=lambda prompt: '{"queries": ["the of", "NOPE:x", "the AND NOT of"]}', judge=judge, counts=counts).collect()
    seen = counts.all()
    assert seen["query_count"] == 10 and seen["final_count"] == len(got) == 40 and seen["ft_relevant_count"] == seen["abstract_relevant_count"] == 0
    assert seen["candidate_count"] >= 40 and 0 < seen["excerpt_count"] < seen["candidate_count"] and seen["model_failures"] >= 10


def test_models_are_asked_again_and_told_what_is_known(spark):
    calls = []

    def model(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise OSError
        return '{"queries": ["q"]}'

    assert Retrying(model, 3, 0.0)("p") == '{"queries": ["q"]}' and len(calls) == 3
    calls.clear()
    with pytest.raises(OSError):
        Retrying(model, 2, 0.0)("p")
    frame = spark.createDataFrame([(1, "what", ["a fact", "another"]), (2, "why", None)], "question_id long, text string, prior array<string>")
    got = model_queries(frame, lambda prompt: json.dumps({"queries": [prompt]}), 3, "{today_year} {question}{context}").collect()
    year = got[0].text[:4]
    assert sorted(r.text for r in got) == [f"{year} what\n\nEvidence already gathered:\n- a fact\n- another", f"{year} why"] and year.isdigit()


def test_search_source_retries_and_isolates(spark):
    """Against a service on this machine: some answers fail for a while, one for good, one is broken, one is not found."""
    seen: Counter = Counter()

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            asked = parse_qs(urlparse(self.path).query)
            assert asked["format"] == ["json"] and asked["pageSize"] == ["2"] and asked["resultType"] == ["core"]
            q = asked["query"][0]
            seen[q] += 1
            code = 503 if q == "busy" and seen[q] < 3 or q == "down" else 404 if q == "gone" else 200
            self.send_response(code)
            self.end_headers()
            ids = [{"pmid": f"{q}{k}", "fullTextIdList": {"fullTextId": ["P1", "P2"] if k else "P0"}} for k in range(3)]
            self.wfile.write(json.dumps({"resultList": {"result": ids}}).encode()[: 20 if q == "broken" else None])

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    address = f"http://127.0.0.1:{server.server_port}/search"
    queries = ["a b&c", "busy", "down", "gone", "broken"]
    rows = remote_records(spark, address, queries, page_size="2", wait="0.01")
    assert rows.rdd.getNumPartitions() == 5
    got = rows.collect()
    assert sorted((r.query_idx, r["rank"], r.pmid) for r in got) == [(0, 1, "a b&c0"), (0, 2, "a b&c1"), (1, 1, "busy0"), (1, 2, "busy1")]
    assert seen["busy"] == 3 and seen["down"] == 4 and seen["gone"] == 1 and seen["broken"] == 1
    assert [p.full_text_ids for p in C.records_to_papers(rows.where("query_idx = 0").orderBy("rank")).collect()] == [["P0"], ["P1", "P2"]]
    strict = SearchReader({"endpoint": address, "queries": '["gone"]', "page_size": "2", "failures": "raise"})
    with pytest.raises(OSError):
        list(strict.read(SubQuery(0, "gone")))
    server.shutdown()


def test_first_hits_of_a_stream(spark, tmp_path):
    """Three batches give the rows that first_wins gives for all hits in time; a late one is dropped."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    batches = [
        [(1, "a", 2, 1, 0), (1, "b", 0, 5, 1), (2, "a", 1, 1, 2)], [(1, "a", 0, 9, 5), (1, "b", 0, 7, 6), (1, "a", 1, 1, 8)], [(9, "z", 0, 1, 100)],
        [(1, "a", 0, 1, 3), (9, "z", 0, 0, 101)], [(9, "end", 0, 0, 300)], [(9, "end", 0, 0, 301)],
    ]
    schema = "question_id long, paper_id string, query_idx int, rank int, seen timestamp"
    for k, rows in enumerate(batches):
        made = [(q, p, i, r, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)) for q, p, i, r, s in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = first_hits(stream, 10).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    got = sorted((r.question_id, r.paper_id, r.query_idx, r["rank"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    every = spark.createDataFrame([x[:4] for rows in batches for x in rows if x != (1, "a", 0, 1, 3) and x[1] != "end"], "question_id long, paper_id string, query_idx int, rank int")
    assert got == sorted((r.question_id, r.paper_id, r.query_idx, r["rank"]) for r in E.first_wins(every, ["question_id", "paper_id"], "query_idx", "rank").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_years_that_questions_name(spark):
    cases = [
        ("work of the last two years", 2025, 2026), ("past 3 years", 2024, 2026), ("last year", 2025, 2026), ("this year", 2026, 2026), ("from 2001 to 2004", 2001, 2004), ("since 1999", 1999, None),
        ("after 2010", 2011, None), ("up to 2010", None, 2010), ("in 2010", 2010, 2010), ("2010–2012", 2010, 2012), ("200 mice and 1500 cells", None, None), ("", None, None), (None, None, None),
    ]
    frame = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(cases)], "question_id int, text string")
    got = {r.question_id: (r.w.first, r.w.last) for r in frame.select("question_id", year_window(F.col("text"), 2026).alias("w")).collect()}
    assert got == {i: (a, b) for i, (_, a, b) in enumerate(cases)}
    rows = spark.createDataFrame([(4, "2001"), (4, "2000"), (4, None), (11, None), (99, "x")], "question_id int, year string")
    assert sorted(map(tuple, within_years(rows, frame, 2026).collect()), key=repr) == [(11, None), (4, "2001"), (99, "x")]


def test_tiers_of_sub_queries(spark):
    docs = spark.createDataFrame([(i, f"alpha beta gamma{i % 3} delta{i % 2} words here") for i in range(12)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "zzz"), (3, "")], "question_id long, text string")
    for most in (1, 3, 7):
        rows = tiered_queries(docs, asked, most).collect()
        assert all(sum(r.question_id == q for r in rows) <= most for q in (1, 2)) and all(r.text.count(" AND ") <= 1 for r in rows)
        assert [r.text for r in rows if r.question_id == 1 and r.query_idx == 0] == ["alpha beta"] and all(r.valid for r in V.validate(spark.createDataFrame([(k, r.text) for k, r in enumerate(rows)], "query_id int, query string")).collect())


ANSWERS = [
    ({"choices": [{"message": {"content": "plain"}}]}, "plain"),
    ({"choices": [{"message": {"content": '["a", 1]'}}]}, '["a", 1]'),
    ({"choices": [{"message": {"content": ["a", {"text": "b"}, {"content": "c"}, {"text": "", "content": "d"}, {"type": "image"}, 7, None, ""]}}]}, "a\nb\nc\nd"),
    ({"choices": [{"message": {"content": None, "reasoning_content": "thought"}}]}, "thought"),
    ({"choices": [{"message": {"content": [], "output_text": "out"}}]}, "out"),
    ({"choices": [{"text": "old"}, {"message": {"content": "second"}}]}, "old"),
    ({"choices": [{"message": None}]}, ""),
    ({"choices": []}, ""),
    ({"error": "down"}, ""),
]


def test_texts_of_answers(spark):
    assert [reply_text(a) for a, _ in ANSWERS] == [t for _, t in ANSWERS]
    rows = [(k, json.dumps(a)) for k, (a, _) in enumerate(ANSWERS)] + [(100, "no JSON"), (101, None), (102, "")]
    got = spark.createDataFrame(rows, "k int, body string").select("k", assistant_text(F.col("body")).alias("t")).orderBy("k").collect()
    assert [r.t for r in got] == [t for _, t in ANSWERS] + ["", "", ""]


def test_endpoints_and_waits(spark, monkeypatch):
    assert {endpoint_url(u) for u in ("http://h/v1", "http://h/v1//", "http://h/v1/chat/completions", "http://h/v1/chat/completions/")} == {"http://h/v1/chat/completions"}
    assert [wait_seconds(k, None, lambda: 0.5) for k in (0, 3, 9)] == [1.0, 8.0, 120.0]
    assert wait_seconds(0, None, lambda: 0.0) == 1.0 and wait_seconds(4, None, lambda: 1.0) == 20.0 and wait_seconds(4, None, lambda: 0.0) == 12.0
    assert wait_seconds(5, "0.5") == 0.5 and wait_seconds(1, "soon", lambda: 0.5) == 2.0
    monkeypatch.setenv("LODESTONE_CHAT_NAME", "m")
    spark.conf.set("lodestone.chat.url", "http://x")
    assert (m := ChatModel.load(spark, timeout=5.0)).url == "http://x" and m.name == "m" and m.timeout == 5.0 and "EMPTY" not in repr(m)
    spark.conf.unset("lodestone.chat.url")


def test_models_behind_an_endpoint(spark):
    """Against a service on this machine: busy and down for a while, refused for good, one answer in blocks."""
    seen: Counter = Counter()

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            assert self.path == "/v1/chat/completions" and self.headers["Authorization"] == "Bearer k" and asked["model"] == "m" and asked["temperature"] == 0.0 and asked["max_tokens"] == 1
            prompt = asked["messages"][0]["content"]
            seen[prompt] += 1
            code = 429 if prompt == "busy" and seen[prompt] < 3 else 503 if prompt == "down" else 401 if prompt == "refused" else 200
            self.send_response(code)
            if code != 200:
                self.send_header("Retry-After", "0.01")
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": ["re", {"text": prompt}]}}]}).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    model = ChatModel(f"http://127.0.0.1:{server.server_port}/v1/", "m", "k", 0.0, 0, attempts=3)
    prompts = spark.createDataFrame([(1, "a"), (2, "busy"), (3, "refused"), (4, None)], "prompt_id long, prompt string")
    got = {r.prompt_id: (r.reply, r.error) for r in replies(prompts, model).collect()}
    assert got[1] == ("re\na", None) and got[2] == ("re\nbusy", None) and got[3][0] is None and "401" in got[3][1] and got[4] == (None, None)
    assert seen["busy"] == 3 and seen["refused"] == 1
    with pytest.raises(OSError):
        ChatModel(model.url, "m", "k", 0.0, 0, attempts=1)("down")
    assert replies(prompts.where("false"), model).collect() == []
    assert [r.text for r in model_queries(spark.createDataFrame([(1, "a")], "question_id long, text string"), model, 3, "{question}").collect()] == ["a"]
    server.shutdown()


def test_blocks_of_threads_leave_each_others_tables(spark):
    inside, done = threading.Event(), threading.Event()
    made = {}

    def other():
        with tidy(spark) as kept:
            made["gone"] = materialize(spark.range(3), "gone")
            kept.append(made.setdefault("kept", materialize(spark.range(4), "kept")))
            inside.set()
            done.wait(60)

    thread = threading.Thread(target=other)
    with tidy(spark):
        with tidy(spark) as kept:
            thread.start()
            inside.wait(60)
            kept.append(made.setdefault("mine", materialize(spark.range(5), "mine")))
        assert made["mine"].count() == 5
    assert made["gone"].count() == 3
    done.set()
    thread.join()
    assert made["kept"].count() == 4
    for name in ("mine", "gone"):
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
            spark.read.parquet(made[name]._scratch_path)


def test_equal_conditions_are_evaluated_once_and_pairs_leave_in_parts(spark, monkeypatch):
    programs = {k: program(t) for k, t in enumerate(['a "b c"', '"a b c" OR NOT d', "b* AND NOT x", "a OR (b AND PUB_YEAR:[2005 TO *])"])}
    papers = [{"text text": f" {t} ", "year year": y} for t, y in [("a b c", 2001), ("b c a", 2006), ("d b x", 2007), ("d", None), ("", None), ("bc a", 1)] * 50]
    stored = Percolator(programs, Counter())
    found = [(k, int(i)) for k, places in stored.meeting({name: [p[name] for p in papers] for name in papers[0]}, len(papers)) for i in places]
    assert sorted(found) == sorted((k, i) for i, p in enumerate(papers) for k in stored.matches(p)) and len(found) > 500
    monkeypatch.setattr("lodestone.operators.percolate.PAIRS", 3)
    monkeypatch.setattr("lodestone.operators.percolate.PAPERS", 2)
    rows = [(k, t) for k, t in enumerate(["the", "the", "NOT the", "the", ""] * 9) if t]
    parsed = []
    monkeypatch.setattr("lodestone.operators.percolate.program", lambda t: parsed.append(t) or program(t))
    docs = spark.createDataFrame([(i, "The a" if i % 2 else "b") for i in range(20)], "doc_id long, text string")
    got = percolate(docs, spark.createDataFrame(rows, "query_id long, query string")).collect()
    assert sorted(map(tuple, got)) == sorted((k, i) for k, t in rows for i in range(20) if (i % 2 == 1) == (t == "the"))
    assert sorted(parsed) == ["NOT the", "the"]
