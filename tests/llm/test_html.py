import html
import re

import pytest

from nomina.llm import catalog
from nomina.llm.html_text import extract, main_text

LONG = "This sentence of the article is long enough to be taken for running text by any rule."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "<p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site name</h1><nav><a href=/a>Home</a><a href=/b>News</a></nav></header>
<div id="cookie-notice" class="notice">We use cookies on this site, and this notice about it is quite long, as they are.</div>
<div class="content"><h2>The &quot;title&quot;</h2><p>{LONG}<br>Same&nbsp;block,
   one   space.</p><div class="ad">Buy now</div><p>Second <b>bold</b> &lt;tag&gt; <a href="/x">link</a> &copy; 2 &amp; 3 {LONG}<p>Unclosed third</div>
<aside><p>{LONG} aside</p></aside><section id="comments"><p>{LONG} comment</p></section><form><p>{LONG} form</p><input value="x>y"></form>
<footer><p>{LONG} footer</p></footer></body></html>"""


def test_page_without_article():
    assert main_text(PAGE) == f'The "title"\n{LONG} Same block, one space.\nSecond bold <tag> link © 2 & 3 {LONG}\nUnclosed third'


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("   ", ""), ("plain", "plain"), ("<p>a", "a"), ("<!-- x <p>y", ""), ("<script>x", ""), ("<p>a<!-- - --> b</p>", "a b"),
    ("<article><p>short</p></article><p>" + LONG + "</p>", "short"), ("<div><p>x &am</p><p>&#233;&eacute;</p></div>", "x &am\néé"),
    ("<P CLASS='x'>Upper</P>", "Upper"), ("a < b and <p>c</p>", "a < b and\nc"), ("<nav><p>" + LONG + "</p></nav>", ""),
    ("<article><header><h1>H</h1></header><p>t</p><div hidden>no</div><footer>no</footer><p>u</p></article>", "H\nt\nu"),
    ("<main><p>one</p><div class='comment-list'><p>no</p></div><p>two</p></main>", "one\ntwo"), ("<td>a</td><td>b</td>", "a\nb"),
    ("<article><p>a</p><table><tr><td>b<td>c</table><ul><li>d<li>e</ul></article>", "a\nb\nc\nd\ne"),
])
def test_edge_cases(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("marked", [True, False])
def test_what_looks_like_a_notice_inside_the_text_stays(marked):
    def page(inner):
        return f"<body><nav><a href=/>Home</a></nav>{'<article>' if marked else '<div>'}{inner}{'</article>' if marked else '</div>'}<footer>{LONG}</footer></body>"

    # a paragraph that is mostly a link
    assert main_text(page(f"<p>{LONG}</p><p>See <a href=/r>the full report on this matter</a>.</p><p>{LONG} 2</p>")) == f"{LONG}\nSee the full report on this matter.\n{LONG} 2"
    # dropped blocks before a short last paragraph
    asides = f"<aside><p>{LONG}</p></aside>" * 3
    assert main_text(page(f"<p>{LONG}</p>{asides}<p>Short end.</p>")) == f"{LONG}\nShort end."
    # headings never go by their name
    assert main_text(page(f"<h2 class='header'>Heading</h2><p>{LONG}</p><h3 id=comments>Other</h3><p>{LONG}</p>")) == f"Heading\n{LONG}\nOther\n{LONG}"


def test_names_of_text_elements_inside_an_article():
    inner = f"<p class='legal'>{LONG}</p><p class=\"note side\">b</p><ul><li class=share>c</li></ul><blockquote class=notice>d</blockquote><table><tr><td class=ad>e</td></tr></table>"
    assert main_text(f"<article>{inner}<div class=ad>no</div></article>") == f"{LONG}\nb\nc\nd\ne"


def test_articles_outside_the_main_element():
    page = f"<main><p>{LONG}</p></main><section><article><p>{LONG} teaser</p></article></section>"
    assert main_text(page) == LONG
    assert main_text(page.replace("main", "article")) == f"{LONG}\n{LONG} teaser"


def test_deep_nesting_takes_linear_time():
    import time

    took = []
    for n in (4000, 16_000):
        t = time.process_time()
        assert main_text("<a></a><i><b>" * n + "x" + "</u></b>" * n) == "x"
        took.append(time.process_time() - t)
    assert took[1] < 10 * took[0] + 0.5


def test_very_long_and_odd_pages():
    many = "".join(f"<p>{LONG} {i}</p>" for i in range(20_000))
    assert main_text(f"<article>{many}</article>").count("\n") == 19_999
    assert main_text("<p " + "a='" * 3000) == ""
    assert main_text("<" * 5000 + " x") == "<" * 5000 + " x"


def test_pages_of_the_driver(spark, sf_small):
    rows = catalog.QUERIES["op10_line_blocks"](spark, sf_small).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_small}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", p)).split()) for p in re.split("</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(filter(None, parts)) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_null_and_repeated_pages(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (1, "u", "<p>a</p>", "y"), (1, "u", "<p>a</p>", "y"), (None, "u", "", "z")], "page_id long, url string, html string, text string")
    assert sorted(map(str, extract(pages).collect())) == sorted(map(str, [
        _row(1, None, "", 0), _row(1, "u", "a", 1), _row(1, "u", "a", 1), _row(None, "u", "", 0)]))


def _row(*values):
    from pyspark.sql import Row

    return Row(page_id=values[0], url=values[1], text=values[2], n_chars=values[3])
