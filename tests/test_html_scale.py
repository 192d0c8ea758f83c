"""Plans of the HTML operators: a page's anchors come from its own row."""

import contextlib
import io

from pyspark.sql import functions as F

from nomina.sources import html as H

PAGES = [(1, "https://h.cl/a/b.html?v=1#t", "<a href=x.csv>uno</a> fuera <a HREF='../y?p=1&amp;q=2'>d&#243;s<b>!</b><a name=n>no</a><a class='href=\"z\"' href>yo</a>"),
         (2, "https://h.cl/", None), (3, "https://h.cl/", ""), (3, "https://h.cl/", "<A/href=\"/./c/../d\">&Aacute;&nope;&#128;")]


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_links_need_no_shuffle(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    links = H.html_links(pages)
    shown = plan(links)
    assert "Exchange" not in shown and "Window" not in shown
    assert sorted(tuple(r) for r in links.collect()) == [
        (1, 0, "https://h.cl/a/x.csv", "uno"), (1, 1, "https://h.cl/y?p=1&q=2", "dós!"), (1, 2, "https://h.cl/a/b.html?v=1#t", "yo"), (3, 0, "https://h.cl/d", "Á&nope;€")]


def test_references_are_dealt_by_the_hash_that_looks_them_up(spark):
    names = sorted(H._REFERENCES)
    rows = spark.createDataFrame([(n,) for n in names if n.startswith("&")], "n string").select("n", H.unescape("n").alias("c"))
    assert {r.n: r.c for r in rows.collect()} == {n: c for n, c in H._REFERENCES.items() if n.startswith("&")}
    assert sorted(k for part in H._DEALT for k in part) == names and max(map(len, H._DEALT)) < 16


def test_filter_on_links_does_not_repeat_their_work(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = H.link_relevance(H.html_links(pages), text_words=["uno"])
    assert plan(got).split("Generate")[0].count("regexp_extract") == 0
    assert [tuple(r) for r in got.select("page_id", F.col("motivo")).collect()] == [(1, "extension y texto")]
