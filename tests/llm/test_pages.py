"""Main text of pages: pages made with what belongs and what doesn't, broken markup, and a plain reading of the given pages."""

import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lodestone.llm.pages import extract_pages, main_text
from lodestone.llm.queries import op11_html_extraction

PAGES = "page_id long, url string, html string"
LONG = "This sentence is long enough to be the text of an article, and it goes on for a while."
CASES = {
    "marks": (f"<article><h1>T</h1><p>{LONG}</p><p>b</p></article>", f"T\n{LONG}\nb"),
    "menus": (f"<nav><ul><li><a href=x>Home</a></ul></nav><header>Site</header><article><p>a</p></article><footer>&copy; {LONG}</footer>", "a"),
    "sidebar": (f"<article><p>a</p></article><aside><p>{LONG}</p></aside><div class='side-bar'>{LONG}</div><div id=sidebar>{LONG}</div>", "a"),
    "notices": (f"<div class='cookie-notice'><p>{LONG}</p></div><main><p>a</p><div role=alert>n</div><p class=notice>n</p><p>b</p></main>", "a\nb"),
    "adverts": (f"<article><p>a</p><div class='ad'><div><p>{LONG}</p></div></div><p>b<span class=\"sponsored\">x</span> c</p></article>", "a\nb c"),
    "forms": ("<article><p>a</p><form><p>name</p><input><textarea><p>t</textarea></form><p>b <button>press</button></p></article>", "a\nb"),
    "comments": (f"<article><p>a</p><section id='comments'><article class='comment'><p>{LONG}</p></article></section></article><div class='commentList'><p>{LONG}</p></div>", "a"),
    "scripts": ("<article><p>a</p><script>if (1 < 2) document.write('</p><p>x')</script><style>p{}</style><noscript><div>x</div></noscript><p>b</p></article>", "a\nb"),
    "html comments": ("<article><p>a<!-- <p>x</p> --> b</p><!--> c <!-- -- > d --></article>", "a b\nc"),
    "references": ("<article><p>&lt;b&gt; &amp;amp; &eacute;&#233;&#x1F600;&nbsp;&copy &unknown; 1 < 2</p></article>", "<b> &amp; éé\U0001f600 © &unknown; 1 < 2"),
    "white space": ("<article><p>\n a\t\r\n b<br>c<br/> d  </p> \n <p> </p></article>", "a b c d"),
    "inline": ("<article><p>a<b>b</b> <i>c</i><a href='x'>d</a></p></article>", "ab cd"),
    "blocks": ("<article>a<p>b<ul><li>c<li>d</ul>e<table><tr><td>f<td>g<tr><th>h</table><dl><dt>i<dd>j</dl><blockquote>k</blockquote>l</article>", "a\nb\nc\nd\ne\nf\ng\nh\ni\nj\nk\nl"),
    "unclosed": ("<article><p>a<p><b>b<br><p>c<div>d<span>e", "a\nb\nc\nde"),
    "unclosed menu": ("<nav><ul><li>x<li>y<article><p>a</p></article>", "a"),
    "unclosed head": ("<head><title>x</title><meta name=a><body><article>a", "a"),
    "cut in a tag": ("<article><p>a</p><p class='b", "a"),
    "cut in a script": ("<article><p>a</p><script>var x = '<p>y</p>", "a"),
    "quotes": ("<article><p title=\"a > b\" data-x='<p>'>c</p><p title=\"x>d</p></article>", "c\nd"),  # a quote that never ends swallows no text
    "stray ends": ("<article></div></b><p>a</p></p></span></article>", "a"),
    "headers of articles": ("<header><h1>Site</h1></header><article><header><h1>T</h1><p>x</p></header><p>a</p><footer>x</footer></article>", "T\na"),
    "topics aren't parts": ("<body class='has-sidebar'><article class='post tag-social category-menu'><p>a</p></article>", "a"),
    "hidden": ("<article><p hidden>x</p><p style='display: none'>x</p><p aria-hidden=true>x</p><p>a</p></article>", "a"),
    "upper case": ("<ARTICLE><P>a</P><NAV>x</NAV></ARTICLE>", "a"),
    "main": (f"<div>{LONG}</div><div role=main><p>a</p></div>", "a"),
    "content": (f"<div class=top>{LONG}</div><div id='main-content'><p>a</p><div class=related>x</div></div>", "a"),
    "articles of one page": ("<main><p>x</p><article><p>a</p></article><article><p>b</p></article></main>", "a\nb"),
    "no marks": (f"<div><a href=a>Home</a> <a href=b>About us</a></div><div><a>x</a></div><div><a>y</a></div><div><p>{LONG}</p><p>short</p><p>{LONG} <a>link</a></p></div><div class=footer>c</div>", f"{LONG}\nshort\n{LONG} link"),
    "far below": (f"<p>{LONG}</p><div class=ad>x<p>x<p>x<p>x</div><p>stray</p>", LONG),
    "short page": ("<p>a</p>", "a"),
    "plain text": ("a & b", "a & b"),
    "nothing": ("<nav>x</nav><script>y</script>", ""),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    page, text = CASES[name]
    assert main_text(page) == text


def made_page(r: random.Random) -> tuple[str, str]:
    """A page with an article between all kinds of other parts, and its text."""
    word = lambda: "".join(r.choices("abcdefghé", k=r.randint(1, 9)))
    line = lambda: " ".join(word() for _ in range(r.choice([1, 4, 30])))
    other = lambda: r.choice([
        "<nav><ul>{0}</ul></nav>", "<aside><p>{0}</p></aside>", "<div class='ad banner'>{0}</div>", "<div id=\"cookie-consent\"><p>{0}</p></div>", "<script>x('<p>{0}</p>')</script>", "<style>{0}</style>", "<form><label>{0}</label><input value='{0}'></form>",
        "<section class=\"comments\"><ol><li>{0}<li>{0}</ol></section>", "<footer><p>{0}</p></footer>", "<!-- {0} -->", "<div class='sidebar-left'><h3>{0}</h3><div>{0}</div></div>", "<div class='site-notice'>{0}</div>",
    ]).format(line())
    some = lambda: "".join(other() for _ in range(r.randrange(4)))
    parts, texts = [], []
    for _ in range(r.randint(1, 12)):
        text = line()
        texts.append(text)
        parts.append(some() + r.choice(["<p>{0}</p>", "<h2>{0}</h2>", "<p>{0}", "<ul><li>{0}</li></ul>", "<p><b>{0}<br>", "<div>{0}</div>", "<blockquote><p>{0}</p></blockquote>"]).format(text.replace(" ", r.choice([" ", "\n  ", "&#32;"]), 2).replace("é", r.choice(["é", "&eacute;"]))))
    whole = f"<html><head><title>{line()}</title></head><body>{some()}<article>{''.join(parts)}{some()}</article>{some()}" + r.choice(["</body></html>", ""])
    return whole, "\n".join(texts)


def test_made_pages():
    r = random.Random(11)
    for _ in range(400):
        page, text = made_page(r)
        assert main_text(page) == text, page


def test_given_pages(spark):
    """Every given page has one article of headings and paragraphs, so a pattern finds its text."""
    raw = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = op11_html_extraction(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(raw)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", raw[r.page_id].html, re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(filter(None, parts)) and r.n_chars == len(r.text) and r.url == raw[r.page_id].url


def test_long_and_deep_pages():
    for page in ("<div>" * 60_000 + "a", "<article>" + "<p>word</p>" * 60_000, "<b>" * 60_000 + "a", "<article><p>" + "word " * 500_000, "<" * 60_000, "<a b='" * 20_000, "<span class=ad>" * 20_000 + "</span>", "</p>" * 60_000):
        began = time.time()
        main_text(page)
        assert time.time() - began < 10


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "u", None), (1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (None, "u", "")]
    pages = spark.createDataFrame(rows, PAGES).withColumns({"text": F.lit("x"), "n_chars": F.lit(3)})
    assert sorted(map(tuple, extract_pages(pages).collect()), key=repr) == sorted([(1, "u", "", 0), (1, None, "a", 1), (1, None, "a", 1), (None, "u", "", 0)], key=repr)
    assert extract_pages(pages.limit(0)).collect() == []
