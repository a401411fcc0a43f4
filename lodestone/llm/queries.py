"""The registered queries of the pipeline operators and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.audit import FILTERS, audit
from lodestone.llm.chat import format_conversations, read_back
from lodestone.llm.exact_dedup import exact_duplicates
from lodestone.llm.fptree import ranked_search
from lodestone.llm.jaccard import jaccard_components
from lodestone.llm.langid import identify, learn
from lodestone.llm.licenses import BASE_PHRASES, rules, scan_licenses
from lodestone.llm.line_dedup import dedup_lines
from lodestone.llm.mixing import mix_sources
from lodestone.llm.neighbours import nearest
from lodestone.llm.packing import pack_documents
from lodestone.llm.pages import extract_pages
from lodestone.llm.urlfilter import SEGMENT, filter_urls, host
from lodestone.sources.corpus import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def domain(source):
    """A stand-in for a domain column, which the documents don't have: the first digit of the source's MD5."""
    digit = F.substring(F.md5(source), 1, 1)
    return F.when(digit < "6", "web").when(digit < "b", "books").when(digit >= "b", "code")


MIX_WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 8}, "source": {"src0": 4, "src1": 3, "src2": 2}}


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = {"domain": domain(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return mix_sources(table(spark, sf_dir, "documents"), levels, MIX_WEIGHTS, (3, 5), seed=7, max_epochs=2)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = learn(docs.where(~held_out))
    named = identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "fit", F.size("spans").alias("n_spans"))


def op4_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), digest_all=True)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no fetch day and no lists come with them; both are derived from the pages by rule, so that they grow with them."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = lambda factor: F.expr(f"date_add(date'2023-01-01', cast(pmod(page_id * {factor}, 730) as int))")
    labels = F.split(host(F.col("url")), r"\.")
    segment = F.regexp_extract("url", SEGMENT, 1)
    key = F.when(F.col("page_id") % 3 == 0, F.array_join(F.slice(labels, -3, 3), ".")).when(F.col("page_id") % 3 == 1, host(F.col("url"))).otherwise(F.concat(host(F.col("url")), F.lit("/"), segment))
    name = F.when(F.col("page_id") % 7 == 0, "allow").when(F.col("page_id") % 7 < 4, "adult").otherwise("spam")
    action = F.when(F.col("page_id") % 5 < 3, "add").otherwise("remove")
    entries = pages.where("page_id % 11 = 4").select(key.alias("key"), name.alias("list"), action.alias("action"), day(11).alias("day"), F.col("page_id").alias("seq"))
    return filter_urls(pages.withColumn("fetch_day", day(37)), entries)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


#: A text of control strings; the query formats it as conversation -7.
NASTY = "\\### Assistant: </turn> ok"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(NASTY))
    back = read_back(format_conversations(turns.union(added)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "removed_lines", "removed_words", "text")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id", "class_links", "n_links")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _op1_level(k: int, budget: str) -> str:
    """SQL that shares the budgets of level k's parents among their children."""
    levels = ["domain", "lang", "source"]
    level, above = levels[k], ", ".join(levels[:k])
    cases = " ".join(f"WHEN '{name}' THEN {w}" for name, w in MIX_WEIGHTS[level].items())
    part = f"PARTITION BY {above} " if above else ""
    order = f"{part}ORDER BY CAST(cap AS DOUBLE) / w, {level}"
    keys = f"{above}, {level}" if above else level
    return f"""
n{k} AS (SELECT {keys}, CAST(sum(cap) AS BIGINT) AS cap, CASE {level} {cases} ELSE 1 END AS w FROM leaves GROUP BY {keys}),
a{k} AS (
  SELECT n{k}.*, budget,
         sum(w) OVER ({part}) - coalesce(sum(w) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left,
         budget - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b_left
  FROM n{k} {f"JOIN {budget} USING ({above})" if above else f"CROSS JOIN {budget}"}
),
o{k} AS (SELECT *, max(CASE WHEN cap * w_left > b_left * w THEN 1 ELSE 0 END) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > 0 AS open FROM a{k}),
s{k} AS (
  SELECT *, sum(CASE WHEN open THEN w ELSE 0 END) OVER ({part}) AS w_open,
         budget - sum(CASE WHEN open THEN 0 ELSE cap END) OVER ({part}) AS b_open,
         sum(CASE WHEN open THEN 1 ELSE 0 END) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nth
  FROM o{k}
),
h{k} AS (SELECT *, CASE WHEN open THEN (b_open * w) // w_open ELSE cap END AS share FROM s{k}),
b{k} AS (
  SELECT {keys}, CAST(share + CASE WHEN open AND nth <= b_open - sum(CASE WHEN open THEN share ELSE 0 END) OVER ({part}) THEN 1 ELSE 0 END AS BIGINT) AS budget
  FROM h{k}
),"""


OP1 = (
    r"""
WITH docs AS (
  SELECT doc_id, coalesce(CASE WHEN md5(source)[1] < '6' THEN 'web' WHEN md5(source)[1] < 'b' THEN 'books' WHEN md5(source)[1] >= 'b' THEN 'code' END, 'none') AS domain,
         coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents
), counted AS (SELECT * FROM docs WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * 2 AS BIGINT) AS cap FROM counted GROUP BY ALL),
root AS (SELECT CAST(least(sum(cap), (sum(cap) // 2) * 3 // 5) AS BIGINT) AS budget FROM leaves),"""
    + _op1_level(0, "root")
    + _op1_level(1, "b0")
    + _op1_level(2, "b1")
    + """
plan AS (SELECT *, budget // tokens AS epochs, budget % tokens AS rest FROM leaves JOIN b2 USING (domain, lang, source)),
taken AS (
  SELECT doc_id, domain, lang, source, epoch, n_tokens, epochs, rest,
         coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('7:' || epoch || ':' || doc_id), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM counted JOIN plan USING (domain, lang, source), LATERAL (SELECT unnest(range(0, epochs + 1)) AS epoch)
)
SELECT doc_id, domain, lang, source, epoch, n_tokens, CAST(CASE WHEN epoch < epochs THEN n_tokens ELSE least(n_tokens, rest - start) END AS BIGINT) AS take_tokens
FROM taken WHERE epoch < epochs OR start < rest
"""
)

def _wide(pattern: str) -> str:
    """A rule's pattern for words that each have a blank on both sides, as this engine can't look around."""
    inner = pattern.removeprefix("(?<![^ ])(?:").removesuffix(")(?![^ ])")
    inner = inner.replace("[^ ]", "\0").replace(" ?", "\1")
    return " (?:" + inner.replace(" ", "  ").replace("\1", "(?:  )?").replace("\0", "[^ ]") + ") "


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op2_rules() -> str:
    values = [f"({r.priority}, {_quoted(r.label)}, CAST({r.confidence} AS DOUBLE), {_quoted(_wide(r.pattern))}, {_quoted(r.keyword)}, [{', '.join(map(_quoted, r.names))}])" for r in rules()]
    return ", ".join(values)


OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
n AS (SELECT *, array_to_string(w, ' ') AS norm, ' ' || array_to_string(w, '  ') || ' ' AS wide FROM d),
base_rules AS (SELECT unnest([{phrases}]) AS phrase, unnest([{phrase_labels}]) AS label),
base AS (SELECT row, label, p FROM (SELECT row, label, w, len(string_split(phrase, ' ')) AS k, phrase, unnest(range(0, len(w))) AS p FROM n, base_rules WHERE contains(norm, phrase)) WHERE array_to_string(w[p + 1:p + k], ' ') = phrase),
rules AS (SELECT * FROM (VALUES {rules}) AS r(priority, label, confidence, pattern, keyword, names)),
pieces AS (SELECT row, priority, label, confidence, string_split_regex(wide, pattern) AS gaps, regexp_extract_all(wide, pattern) AS found FROM n, rules WHERE contains(norm, keyword) AND len(list_filter(names, lambda x: contains(norm, x))) > 0),
sized AS (SELECT row, priority, label, confidence, generate_subscripts(found, 1) AS k, list_transform(gaps, lambda x: len(list_filter(string_split(x, ' '), lambda y: y <> ''))) AS g, list_transform(found, lambda x: len(list_filter(string_split(x, ' '), lambda y: y <> ''))) AS f FROM pieces WHERE len(found) > 0),
hits AS (SELECT row, priority, label, confidence, CAST(list_sum(g[:k]) + coalesce(list_sum(f[:k - 1]), 0) AS BIGINT) AS first, CAST(list_sum(g[:k]) + list_sum(f[:k]) AS BIGINT) AS behind FROM sized),
ordered AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY first, behind DESC, priority, label, confidence) AS nth FROM hits),
kept AS (SELECT * FROM ordered h WHERE NOT EXISTS (SELECT 1 FROM ordered o WHERE o.row = h.row AND o.nth < h.nth AND o.behind >= h.behind AND o.priority <= h.priority)),
b AS (SELECT row, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM base GROUP BY row),
k AS (SELECT row, list(label) AS labels, max(confidence) AS score FROM kept GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(b.labels, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(k.labels, [])))), ',') AS labels, coalesce(score, CAST(0 AS DOUBLE)) AS score
FROM n LEFT JOIN b USING (row) LEFT JOIN k USING (row)
""".replace("{phrases}", ", ".join(map(_quoted, BASE_PHRASES))).replace("{phrase_labels}", ", ".join(map(_quoted, BASE_PHRASES.values()))).replace("{rules}", _op2_rules())

OP5 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
), w AS (
  SELECT *, count(*) OVER (PARTITION BY h) AS g, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS k FROM t
)
SELECT doc_id, k AS keep_id, g AS group_size, doc_id = k AS kept, h AS text_sha256 FROM w
"""


OP6 = r"""
WITH p AS (
  SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#\[]+?)\.?(?:[:/?#]|$)', 1)) AS host,
         regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS segment,
         CAST(DATE '2023-01-01' + CAST((page_id * 37) % 730 AS INTEGER) AS DATE) AS fetch_day
  FROM pages
), e AS (
  SELECT CASE page_id % 3 WHEN 0 THEN array_to_string(string_split(host, '.')[-3:], '.') WHEN 1 THEN host ELSE host || '/' || segment END AS key,
         CASE WHEN page_id % 7 = 0 THEN 'allow' WHEN page_id % 7 < 4 THEN 'adult' ELSE 'spam' END AS list,
         page_id % 5 < 3 AS adds, CAST(DATE '2023-01-01' + CAST((page_id * 11) % 730 AS INTEGER) AS DATE) AS day, page_id AS seq
  FROM p WHERE page_id % 11 = 4
), daily AS (SELECT key, list, day, arg_max(adds, seq) AS adds FROM e GROUP BY ALL),
spans AS (SELECT key, list, adds, day AS since, lead(day) OVER (PARTITION BY key, list ORDER BY day) AS until FROM daily),
probes AS (
  SELECT DISTINCT page_id, fetch_day, unnest(list_distinct(list_concat(CASE WHEN host[1] = '[' THEN [] ELSE list_transform(range(1, len(string_split(host, '.'))), lambda i: array_to_string(string_split(host, '.')[i:], '.')) END,
         CASE WHEN segment <> '' AND host <> '' THEN [host || '/' || segment] ELSE [] END))) AS key FROM p
), hits AS (SELECT page_id, key, list FROM probes JOIN spans USING (key) WHERE adds AND since <= fetch_day AND (until IS NULL OR fetch_day < until)),
v AS (
  SELECT page_id, count(*) AS n_active, array_to_string(list_sort(list_distinct(list(list))), ',') AS lists,
         first(key ORDER BY length(key) DESC, key) AS winner, NOT first(list = 'allow' ORDER BY length(key) DESC, list = 'allow' DESC) AS blocked
  FROM hits GROUP BY page_id
)
SELECT page_id, url, fetch_day, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists, winner, coalesce(blocked, false) AS blocked FROM p LEFT JOIN v USING (page_id)
"""

OP8 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\e'), '<part/>', '\p') AS x,
         replace(replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\e'), '<part/>', '\p'), ':', '\c') AS head,
         lag(role) OVER w AS above, lead(role) OVER w AS below
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(x) + CASE WHEN above = role THEN 7 ELSE 6 + length(head) END + CASE WHEN below = role THEN 0 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


OP9 = r"""
WITH raw AS (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS body FROM documents WHERE text IS NOT NULL),
worded AS (SELECT doc_id, line, array_to_string(w, ' ') AS body, len(w) AS n FROM (SELECT doc_id, line, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w FROM raw) WHERE len(w) > 0),
c AS (SELECT doc_id, row_number() OVER o AS k, line, body, n, CAST(sum(n) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM worded WINDOW o AS (PARTITION BY doc_id ORDER BY line)),
lists AS (SELECT doc_id, list(body ORDER BY k) AS bodies, list(line ORDER BY k) AS lines FROM c GROUP BY doc_id),
ends AS (SELECT a.doc_id, a.k AS i, min(b.k) AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - a.upto + a.n >= 50 GROUP BY ALL
   UNION SELECT b.doc_id, max(a.k), b.k FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - a.upto + a.n >= 50 GROUP BY b.doc_id, b.k),
runs AS (SELECT doc_id, lines[i] AS lo, lines[j] AS hi, md5(array_to_string(bodies[i:j], chr(10))) AS digest FROM ends JOIN lists USING (doc_id)),
later AS (SELECT doc_id, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY doc_id, lo) AS nth FROM runs) WHERE nth > 1),
gone AS (SELECT DISTINCT r.doc_id, r.line FROM raw r JOIN later l ON r.doc_id = l.doc_id AND r.line BETWEEN l.lo AND l.hi),
marked AS (SELECT r.doc_id, r.line, r.body, g.line IS NOT NULL AS goes FROM raw r LEFT JOIN gone g USING (doc_id, line)),
done AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS removed_lines, coalesce(sum(len(regexp_extract_all(body, '[^\x20\x09-\x0D]+'))) FILTER (goes), 0) AS removed_words, coalesce(string_agg(body, chr(10) ORDER BY line) FILTER (NOT goes), '') AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(removed_lines, 0) AS removed_lines, CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words, done.text FROM documents d LEFT JOIN done USING (doc_id)
"""

OP10 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS grams FROM w),
named AS (SELECT doc_id, CAST(len(grams) AS BIGINT) AS n, CASE WHEN len(grams) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(grams)) END AS cls, grams FROM s),
classes AS (SELECT cls, any_value(n) AS n, any_value(grams) AS grams, count(*) AS copies FROM named WHERE n > 0 GROUP BY cls),
listed AS (SELECT cls, n, unnest(grams) AS gram FROM classes),
pairs AS (SELECT a.cls AS a, b.cls AS b FROM listed a JOIN listed b ON a.gram = b.gram AND a.cls <> b.cls GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT cls AS a, cls AS b FROM classes UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
roots AS (SELECT a AS cls, min(b) AS root FROM reach GROUP BY a),
counts AS (SELECT a AS cls, count(*) AS links, CAST(sum(copies) AS BIGINT) AS docs FROM pairs JOIN classes ON classes.cls = pairs.b GROUP BY a)
SELECT doc_id, named.n AS n_shingles, coalesce(root, doc_id) AS component_id, named.cls AS class_id, coalesce(links, 0) AS class_links, CAST(coalesce(docs, 0) + coalesce(copies, 1) - 1 AS BIGINT) AS n_links
FROM named LEFT JOIN roots USING (cls) LEFT JOIN counts USING (cls) LEFT JOIN classes USING (cls)
"""
OP12 = r"""
WITH lowered AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
asked AS (SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
whole AS (SELECT count(*) AS n_docs, sum(len(t)) AS n_terms FROM lowered WHERE len(t) > 0),
terms AS (SELECT item, item_id, unnest(t) AS term FROM asked),
tf AS (SELECT row, doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT row, doc_id, t, unnest(t) AS term FROM lowered) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, whole),
parts AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * CAST(50 + (50 * n * n_docs) // n_terms AS BIGINT))) AS part FROM tf JOIN w USING (term), whole),
scores AS (SELECT item, item_id, row, doc_id, CAST(sum(part) AS BIGINT) AS score FROM parts JOIN terms USING (term) GROUP BY ALL HAVING sum(part) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores) WHERE rank <= 50
"""


def _op13_events() -> str:
    """One row for each order and step, with the filter there and those before it."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    return ", ".join(f"('{o}', {s + 1}, '{o[s]}', '{o[:s]}')" for o in orders for s in range(len(o)))


OP13 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first,
           regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
f AS (SELECT doc_id, part, len(w) < 200 AS A, 100 * len(list_distinct(w)) < 50 * len(w) AS B,
      100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS C, regexp_matches(text, '[#$%&*|]') AS D, coalesce(doc_id > first, false) AS E FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, concat(CASE WHEN A THEN 'A' ELSE '' END, CASE WHEN B THEN 'B' ELSE '' END, CASE WHEN C THEN 'C' ELSE '' END, CASE WHEN D THEN 'D' ELSE '' END, CASE WHEN E THEN 'E' ELSE '' END) AS fails,
      count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
o AS (SELECT * FROM (VALUES {_op13_events()}) AS o(filter_order, step, name, before)),
x AS (SELECT m.*, o.*, contains(fails, name) AS failing, len(list_filter(string_split(fails, ''), lambda c: c <> '' AND contains(before, c))) > 0 AS gone FROM m, o),
s AS (SELECT part, filter_order, step, name, sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed,
      sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = name THEN n ELSE 0 END) AS unique_fails,
      sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, name) AS BIGINT) AS shapley FROM s
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mixing": OP1, "op2_license_scan": OP2, "op5_exact_dedup": OP5, "op6_url_filter": OP6, "op8_chat_format": OP8, "op9_line_dedup": OP9, "op10_ngram_jaccard": OP10, "op12_lexical_search": OP12, "op13_filter_audit": OP13}
