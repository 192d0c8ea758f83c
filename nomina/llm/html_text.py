"""Main text of web pages by the distribution of text over lines.

Markup is stripped into lines, one for each block element.  Lines in a menu, header, footer,
sidebar, notice, advert, form or comment leave the sequence.  A line's weight is the length
of its text, 0 if most of it is link text or if it stands outside the page's main element
(or, without one, its articles) where one is marked.  Weights are summed over sliding windows
of ``WINDOW`` lines.  Text begins where a sum surges to ``SURGE`` characters (or to the page's
greatest sum, if that is less) and ends where the sums dive to 0; what lies between the first
and the last weighty line is kept, lines of links included.  Lines inside a marked element
all have weight, so that none of them is lost.

Character references are decoded, white space inside a block becomes one space, blocks are
joined by line feeds.  A <br> is white space inside its block.

Edge cases: null, empty and markup-only pages give an empty text; unclosed elements end with
their parent or the page, an unclosed comment or script with the page; a page's text is never
cut, however long or deeply nested; of runs with the same sums all are kept; repeated rows
each give a row; columns other than the named ones are not read; an empty table gives an
empty result."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 60

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul").split())
#: Elements that never hold main text.
_DROP = frozenset("nav footer aside form head select button menu dialog template svg object audio video canvas fieldset".split())
_ARTICLE = frozenset(("article", "main"))
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Names of classes and ids, or their parts between - and _, that mark what is not main text.
_NAMES = frozenset(("ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promoted promotion "
                    "cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox newsletter subscribe subscription signup paywall "
                    "sidebar side aside rail widget widgets related recommended recommendations recommendation teaser teasers "
                    "share sharing sharebar social follow nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager tabs toolbar topbar "
                    "footer foot header masthead copyright legal comment comments commentlist reply replies respond disqus discussion responses "
                    "login search searchbox form toc skip tagcloud").split())
#: With one of these parts a name speaks of the article, whatever else it has.
_OWN = frozenset("article post entry content story main body text page".split())
#: Elements whose names say nothing: those that hold the text itself, the second kind only inside a marked element.
_SAFE = frozenset("html body article main h1 h2 h3 h4 h5 h6 b i em strong a code blockquote pre".split())
_SAFE_INSIDE = frozenset("p li td th tr dd dt caption figcaption figure".split())
#: Elements that end an open one of the same kind.
_ENDS = {"p": _BLOCK - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


def _dropped(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _DROP or tag == "header" and not in_article:
        return True
    if not attributes.strip(" /\n\t"):
        return False
    own = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", ""), re.I):
        return tag not in ("html", "body")
    if own.get("role", "").lower() in _ROLES:
        return True
    if tag in _SAFE or in_article and tag in _SAFE_INSIDE:
        return False
    for name in (own.get("class", "") + " " + own.get("id", "")).lower().split():
        parts = set(re.split(r"[-_:]+", name))
        if parts & _NAMES and (name in _NAMES or not parts & _OWN or parts & {"comment", "comments", "sidebar", "footer", "nav", "menu", "ad", "ads", "related", "share"}):
            return True
    return False


def lines(page: str) -> tuple[list[tuple[str, int, int]], set[int]]:
    """(text, characters of links, number of the marked element it is in or 0) of each block that
    is not dropped; and the numbers of main elements."""
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[str, bool, int, int]] = []  # tag, dropped, marked element, open links
    opened: Counter[str] = Counter()
    mains: set[int] = set()
    text: list[str] = []
    linked = articles = links = 0
    at = 0

    def close(first: int) -> None:
        nonlocal links
        opened.subtract(t for t, _, _, _ in stack[first:])
        del stack[first:]
        links = stack[-1][3] if stack else 0

    def flush() -> None:
        nonlocal linked
        if text:
            if (line := " ".join(html.unescape("".join(text)).split())) and not (stack and stack[-1][1]):
                out.append((line, linked, stack[-1][2] if stack else 0))
            text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text.append(raw)
            if links:
                linked += len(raw.strip())

    while m := _TOKEN.search(page, at):
        add(page[at:m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None) if opened[tag] > 0 else None
            if found is None:
                if tag in _BLOCK:
                    flush()
                continue
            if any(t in _BLOCK or t in _DROP for t, _, _, _ in stack[found:]) or stack[found][1] != (stack[found - 1][1] if found else False):
                flush()
            close(found)
            continue
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            text.append(" ")
            continue
        if tag in _BLOCK:
            flush()
            for open_, ends in _ENDS.items():  # an element that the new one ends
                if tag in ends and opened[open_] > 0:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == open_:
                            close(i)
                            break
                        if stack[i][0] in _BLOCK:
                            break
        if tag in _VOID:
            text.append(" ")
            continue
        if attributes.endswith("/") and tag not in _BLOCK:
            continue
        _, dropped, article, _ = stack[-1] if stack else ("", False, 0, 0)
        own = _dropped(tag, attributes, article > 0)
        if own and not dropped:
            flush()
        main = tag == "main" or bool(re.search(r"""role\s*=\s*["']?main|itemprop\s*=\s*["']?articleBody""", attributes))
        if not article and not (dropped or own) and (main or tag in _ARTICLE):
            articles += 1
            article = articles
            if main:
                mains.add(article)
        links += tag == "a"
        opened[tag] += 1
        stack.append((tag, dropped or own, article, links))
    if at < len(page) and not re.match(r"<[a-zA-Z/!?]", page[at:at + 2]):
        add(page[at:] if "<" not in page[at:] else re.sub(r"<[a-zA-Z/!?][^<]*\Z", "", page[at:]))
    flush()
    return out, mains


def main_text(page: str | None) -> str:
    rows, mains = lines(page or "")
    marked = {a for _, _, a in rows if a in mains} or {a for _, _, a in rows if a}
    weight = [len(t) if a in marked or not marked and 2 * n <= len(t) else 0 for t, n, a in rows]
    sums = [sum(weight[i:i + WINDOW]) for i in range(len(weight))]
    surge = min(SURGE, max(sums, default=0))
    kept: list[str] = []
    i = 0
    while i < len(sums):
        j = i
        while j < len(sums) and sums[j]:
            j += 1
        if j > i and max(sums[i:j]) >= surge:
            weighty = [k for k in range(i, j) if weight[k]]
            kept += [rows[k][0] for k in range(weighty[0], weighty[-1] + 1) if weight[k] or not marked]
        i = max(j, i + 1)
    return "\n".join(kept)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row a page: page_id, url, text, n_chars."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
