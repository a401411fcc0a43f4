import datetime as dt
import random
import re

from pyspark.sql import functions as F

from lodestone.llm import urlfilter
from lodestone.llm.urlfilter import HOST, SEGMENT, filter_urls

DAY0 = dt.date(2023, 1, 1)


def plain_keys(url):
    m = re.match(HOST, url or "")
    host = m[1].lower() if m else ""
    labels = [host] if host[:1] == "[" else host.split(".")
    keys = {".".join(labels[i:]) for i in range(len(labels) - 1)}
    if host and (s := re.match(SEGMENT, url)):
        keys.add(f"{host}/{s[1]}")
    return keys


def plain(url, day, entries):
    if url is None or day is None:
        return 0, "", None, False
    hits = []
    for key, name in {(e[0], e[1]) for e in entries if e[0] in plain_keys(url)}:
        past = [(e[3], e[4], e[2] or "") for e in entries if e[:2] == (key, name) and e[3] is not None and e[3] <= day]
        if past and max(past)[2] == "add":
            hits.append((key, name))
    if not hits:
        return 0, "", None, False
    longest = max(len(k) for k, _ in hits)
    return len(hits), ",".join(sorted({n for _, n in hits})), min(k for k, _ in hits if len(k) == longest), not any(n == "allow" for k, n in hits if len(k) == longest)


def test_verdicts_match_plain_ones(spark):
    r = random.Random(3)
    hosts = ["a.example.com", "b.a.example.com", "example.org", "x.org"]
    day = lambda: DAY0 + dt.timedelta(r.randint(0, 120))
    urls = [f"{r.choice(['http', 'HTTPS'])}://{r.choice(['', 'u@'])}{r.choice(hosts).replace('a.', r.choice(['a.', 'A.']))}{r.choice(['', ':80', '/', '/en/1?q#f', '/de', '?x/y'])}" for _ in range(80)] + [None, "", "no url", "mailto:x@y.org", "http://", "http://localhost/en", "http://example.org./de", "http://x.org.:80/de", "http://[2001:DB8::1.2]:80/en", "http://u@[::1]/de", "http://[::1"]
    captures = [(i, r.choice(urls), r.choice([day(), day(), day(), None])) for i in range(400)] + [(1, urls[0], DAY0)] * 2 + [(None, urls[1], DAY0)]
    keys = [*hosts, "[2001:db8::1.2]/en", "[::1]/de", "example.com", "a.example.com/en", "x.org/de", None]
    entries = [(r.choice(keys), r.choice(["adult", "spam", "allow", None]), r.choice(["add", "add", "remove", None]), r.choice([day(), day(), None]), i) for i in range(160)]
    frame = spark.createDataFrame(captures, "page_id long, url string, fetch_day date").selectExpr("*", "1 as key", "'x' as list", "2 as month", "3 as blocked")
    got = filter_urls(frame, spark.createDataFrame(entries, "key string, list string, action string, day date, seq long"))
    assert got.columns == ["page_id", "url", "fetch_day", "key", "list", "month", "n_active", "lists", "winner", "blocked"]
    clean = [e for e in entries if e[0] and e[1] and e[3]]
    want = sorted(repr((i, u, d, *plain(u, d, clean))) for i, u, d in captures)
    assert sorted(repr((x.page_id, x.url, x.fetch_day, x.n_active, x.lists, x.winner, x.blocked)) for x in got.collect()) == want
    assert sum("True)" in w for w in want) > 40


def test_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://a.b/c", DAY0)], "page_id long, url string, fetch_day date")
    entries = spark.createDataFrame([], "key string, list string, action string, day date, seq long")
    assert filter_urls(captures, entries).first().blocked is False
    assert filter_urls(captures.limit(0), entries).count() == 0


def test_old_entries_are_clipped(spark):
    """Months of entries before the first and behind the last fetch are no rows."""
    captures = spark.createDataFrame([(1, "https://a.example.com/x", "2024-05-03"), (2, "https://b.example.com/", "2024-06-01")], "page_id long, url string, d string").withColumn("fetch_day", F.to_date("d"))
    rows = [("example.com", "spam", "add", "0001-01-01", 1), ("a.example.com", "adult", "add", "1990-01-01", 1), ("a.example.com", "adult", "remove", "2024-05-03", 2), ("b.example.com", "spam", "add", "2030-01-01", 1)]
    entries = spark.createDataFrame(rows, "key string, list string, action string, d string, seq long").withColumn("day", F.to_date("d"))
    seen = []
    real = urlfilter.materialize
    urlfilter.materialize = lambda df, label: seen.append((label, real(df, label))) or seen[-1][1]
    try:
        got = filter_urls(captures, entries).select("page_id", "n_active", "lists").collect()
    finally:
        urlfilter.materialize = real
    assert sorted(map(tuple, got)) == [(1, 1, "spam"), (2, 1, "spam")]
    assert dict(seen)["spans"].count() == 2
