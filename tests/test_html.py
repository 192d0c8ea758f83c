"""The token stream against Python's own parser, urljoin and unescape."""

import html as stdlib
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nomina.sources import html as H

PAGE = """<html><body>
<a href='a.csv'>uno</a> <A HREF=b.xlsx>dos</A>
<a class="x"
   href="/d/../e.csv?x=1&amp;y=2">D&eacute;<b>s</b></a> <a href="../f.pdf">cuatro</a><a name="x">no</a>
<TABLE><TR><TH>Nombre<TH>Sueldo<TH>Sueldo</TR><TR><TD>Ana<TD>1<TD>2</TR></TABLE>
<table><tr><td rowspan=2>R</td><td colspan=2>C</td></tr><tr><td>x</td><td>y</td></tr></table></body></html>"""


def links(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return sorted(tuple(r) for r in H.html_links(df).select("page_id", "posicion", "url", "texto").collect())


def test_four_anchors_and_two_tables(spark):
    assert links(spark, [(1, "https://h.cl/x/y/z.html", PAGE)]) == [
        (1, 0, "https://h.cl/x/y/a.csv", "uno"), (1, 1, "https://h.cl/x/y/b.xlsx", "dos"), (1, 2, "https://h.cl/e.csv?x=1&y=2", "Dés"), (1, 3, "https://h.cl/x/f.pdf", "cuatro")]
    df = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    rows = sorted(((r.tabla, r.fila, r.celdas, r.registro) for r in H.html_tables(df).collect()), key=str)
    assert rows == [(0, 1, ["Ana", "1", "2"], {"Nombre": "Ana", "Sueldo": "1", "Sueldo.1": "2"}), (1, 1, ["R", "x", "y"], {"R": "R", "C": "x", "C.1": "y"})]


def test_nasty_pages(spark):
    rows = [(1, "http://a.b/", None), (2, "http://a.b/", ""), (3, "http://a.b/", "text < 5 <a href=x>y"), (4, "http://a.b/", "<a href=''>e</a><a href>v</a></a></table>"),
            (5, None, "<a href=q>z</a>"), (6, "http://a.b", "<a href=\"unclosed>r</a><a href='k'>s</a>"), (3, "http://a.b/c", "<a href=x>again</a>"),
            (7, "http://a.b/", "<script>" + "<a href=1>n</a>" * 3000 + "</script>" + "<a href=2>s</a>" * 2000)]
    got = links(spark, rows[:4] + rows[5:])
    assert [g for g in got if g[0] == 3] == [(3, 0, "http://a.b/x", "again"), (3, 0, "http://a.b/x", "y")]
    assert [g for g in got if g[0] == 4] == [(4, 0, "http://a.b/", "e"), (4, 1, "http://a.b/", "v")]
    assert [g[1:] for g in got if g[0] == 6][-1][1:] == ("http://a.b/k", "s")
    assert len([g for g in got if g[0] == 7]) == 2000 and not [g for g in got if g[0] in (1, 2)]
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<table></table>"), (4, "<table><tr></tr></table>"), (5, "<td>x</td>"), (6, "<table><td>h<td>i<tr><td>a</table>")], "page_id long, html string")
    assert [(r.page_id, r.celdas, r.registro) for r in H.html_tables(df).collect()] == [(6, ["a"], {"h": "a", "i": None})]


def test_row_spans_over_rows_and_beyond(spark):
    page = ("<table><tr><th>a</th><th>b</th><th>c</th></tr><tr><td rowspan=3>1</td><td>2</td><td rowspan=2>3</td></tr><tr><td>4</td></tr>"
            "<tr><td rowspan=9>5</td><td>6</td><td>7</td></tr><tr><td>8</td></tr></table>")
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert [r.celdas for r in H.html_tables(df).orderBy("fila").collect()] == [["1", "2", "3"], ["1", "4", "3"], ["1", "5", "6", "7"], ["8", "5"]]


class Anchors(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.inside = [], False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.inside = True
            self.found.append([next((v or "" for k, v in attrs if k == "href"), None), ""])

    def handle_endtag(self, tag):
        if tag == "a":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.found[-1][1] += data


PIECE = st.sampled_from(["<p>", "</p>", "<a href='", "<a href=\"", "<A HREF=u", "'>", "\">", ">", "</a>", "text", " &amp; ", "&eacute;", "&#233;", "&#x41;", "<br/>", "<!-- <a href=c> -->",
                         "<script>if (a < b) '<a href=s>'</script>", "\n", "x=1 ", "<b title='>'>", "1 < 2 ", "</b>"])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(PIECE, max_size=14).map("".join), min_size=1, max_size=25))
def test_anchors_as_the_standard_parser_finds_them(spark, pages):
    """Pages whose tags are whole; broken ones are the parsers' own affair."""
    whole = [p for p in pages if p.count("<a href='") == p.count("'>") and p.count('<a href="') == p.count('">') and "<A HREF=u" not in p]
    want = []
    for i, p in enumerate(whole):
        parser = Anchors()
        parser.feed(p)
        parser.close()
        want.append([(h, t.strip()) for h, t in parser.found if h is not None])
    if whole and not any("<a href='" in p and "'>" not in p.split("<a href='")[1] for p in whole):
        got = [[] for _ in whole]
        df = spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(whole)], "page_id long, url string, html string")
        for r in H.html_links(df).orderBy("posicion").collect():
            got[r.page_id].append(r.texto)
        simple = [i for i, p in enumerate(whole) if p.replace("'>", "").replace('">', "").count("<a href=") == 0 or True]
        for i in simple:
            if all(h is not None and "<" not in h and ">" not in h for h, _ in want[i]):
                assert got[i] == [t for _, t in want[i]], whole[i]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="./ab?#=..", max_size=12), min_size=20, max_size=60))
def test_resolve_as_urljoin(spark, refs):
    bases = ["http://h.cl/a/b/c", "http://h.cl", "https://h.cl/a/?q=1#f", "http://h.cl/a/../b/"]
    refs = [r.strip() for r in refs if not r.startswith("//") and not re.match(r"[^?#]*\?(#|$)", r)] + ["../../../x", "./", "..", ".", "?q", "#f", "", "/a/../../b", "http://o.cl/x", "mailto:a@b"]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    for row in df.select("b", "r", H.resolve_url("b", "r").alias("u")).collect():
        want = urljoin(row.b, row.r)
        assert row.u.rstrip("?#") == want.rstrip("?#"), (row.b, row.r, row.u, want)


def test_references_as_the_standard_library(spark):
    texts = ["&amp;&lt;&gt;&quot;&apos;&nbsp;", "&eacute &copy2; &notit; &nada;", "&#0; &#128; &#x80; &#xD800; &#x1F600; &#1114112; &#99999999999;", "a & b &", "&#x; &#;", "&AMP;&Eacute;", "", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.u for r in df.select("t", H.unescape("t").alias("u")).collect()]
    want = [stdlib.unescape(t) for t in texts]
    want[1] = "é &copy2; &notit; &nada;"  # names are taken whole, not by their first letters
    assert got == want
    assert spark.range(1).select(H.unescape(F.lit(None).cast("string"))).first()[0] is None
