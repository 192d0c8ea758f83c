"""HTML corpus operators over a ``(key, url, html)`` frame (SRC-10..13, SCL-22).

A page becomes a table of tokens (``html_tokens``): one pattern finds comments, raw-text
elements, tags with attributes in any of the three quoting forms, and text.  Tokens stay an
array of the page's row where slices of it are enough (anchors, ``html_links``).  For tables,
what a parser keeps on a stack are running sums over a page's tokens: how many tables are
open, the row and cell of each open table.  Every page is one row to begin with, so the work
is spread by the pages and whole pages are always processed; nothing runs outside the JVM.
"""

from __future__ import annotations

import html.entities
import json
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Salary-related patterns (matched against lower-cased text).
SALARY_PATTERNS = [
    r"remuneraci[oó]n", r"sueldo", r"salario", r"bruto", r"l[ií]quido", r"monto",
    r"honorario", r"dotaci[oó]n",
]
# Keywords searched inside table text.
TABLE_KEYWORDS = ["sueldo", "remuneracion", "bruto", "liquido"]
# Data-file extensions of interest for links.
DATA_EXTENSIONS = [".xlsx", ".xls", ".csv", ".pdf"]

# Quoted parts of a tag may hold ">".
_ATTRS = r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+"""
RAW_TEXT = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
TOKEN_RE = (r"(?is)<!--.*?(?:-->|$)|<(" + "|".join(RAW_TEXT) + r")(?=[\s/>])" + _ATTRS + r">.*?(?:</\1\s*+>|$)"
            r"|<[!?][^>]*+>|</?[a-z][^\s/>]*+" + _ATTRS + r">|</?[a-z][^>]*+>|[^<]++|<")
NAME_RE = r"^</?([a-zA-Z][^\s/>]*)"
# Tokens that are text or the start or end tag of an anchor.
ANCHOR_OR_TEXT_RE = r"^(?:</?[aA](?:[\s/>]|$)|(?!</?[a-zA-Z]|<[!?]))"
_VALUE = r"""\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+)"""
# A start tag as far as its first attribute of a name; the value is the second group.
ATTR_RE = (r"""(?s)^<[a-zA-Z][^\s/>]*+(?:[\s=/>"']*+[^\s=/>"']++(?:""" + _VALUE + r""")?+)*?[\s=/>"']*+(?i:{name})(?![^\s=/>"'])(?:""" + _VALUE + ")?+")
ENTITY_RE = r"&(?:#[xX]?[0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)"
TABLE_RE = r"(?is)<table\b.*?</table>"
TAG_RE = r"<[^>]+>"
SCHEME_HOST_RE = r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)"
HOST_RE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)"
PATH_RE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"
# Most columns a cell may span, as browsers have it.
MAX_COLSPAN = 1000
# Character references by name, as Python's standard library lists them, and those numbers
# that stand for a character of Windows-1252.
_REFERENCES = {f"&{n}": c for n, c in html.entities.html5.items()} | {
    str(i): bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0)}
# The same dealt by hash, since Spark looks a key up in a map by going through it.
_DEALT = [{k: c for k, c in _REFERENCES.items() if zlib.crc32(k.encode()) % 1024 == i} for i in range(1024)]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _let(value: Column, of) -> Column:
    """``of(value)`` with ``value`` worked out once, however often ``of`` names it."""
    return F.get(F.transform(F.array(value), of), 0)


def strip_tags(x) -> Column:
    return F.trim(F.regexp_replace(_c(x), TAG_RE, ""))


def _strip(x) -> Column:
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def _character(code: Column) -> Column:
    """The character of a code point; U+FFFD for those that are none."""
    def units(c: Column, digits: int) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(c), digits, "0")), "UTF-16BE")

    pair = (F.lit(0xD800) + F.shiftright(code - 0x10000, 10)) * 0x10000 + F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))
    bad = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    return F.when(bad, F.lit("\ufffd")).when(code < 0x10000, units(code, 4)).otherwise(units(pair, 8))


def unescape(x) -> Column:
    """Character references by name, number and hexadecimal number; unknown names stay."""
    text = _c(x)
    dealt = F.from_json(F.lit(json.dumps(_DEALT)), "array<map<string,string>>")

    def known(name: Column) -> Column:
        return F.element_at(F.get(dealt, (F.crc32(name.cast("binary")) % len(_DEALT)).cast("int")), name)

    def number(ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"^&#([xX]?)([0-9a-fA-F]+)", 2)
        hexa = F.substring(ref, 3, 1).isin("x", "X")
        code = F.when(hexa, F.conv(F.lpad(F.right(digits, F.lit(9)), 9, "0"), 16, 10).cast("long"))
        code = code.otherwise(F.try_to_number(F.right(digits, F.lit(9)), F.lit("999999999")).cast("long"))
        return _let(code, lambda c: F.coalesce(F.when(c.between(0x80, 0x9F), known(c.cast("string"))), _character(c)))

    def one(ref: Column) -> Column:
        return F.when(ref.startswith("&#"), number(ref)).otherwise(F.coalesce(known(ref), ref))

    parts = F.arrays_zip(F.split(text, ENTITY_RE).alias("text"), F.regexp_extract_all(text, F.lit(ENTITY_RE), 0).alias("ref"))
    whole = F.array_join(F.transform(parts, lambda p: F.when(p["ref"].isNull(), p["text"]).otherwise(F.concat(p["text"], F.coalesce(one(p["ref"]), F.lit(""))))), "")
    return F.when(text.contains("&"), whole).otherwise(text)


def host(url) -> Column:
    return F.regexp_extract(_c(url), HOST_RE, 1)


def fold_path(path) -> Column:
    """``.`` and ``..`` segments of an absolute path resolved."""
    def fold(segments: Column) -> Column:
        last = F.element_at(segments, -1)
        folded = F.aggregate(segments, F.array().cast("array<string>"), lambda done, s: (
            F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.array_append(done, s))))
        return F.array_join(F.when(last.isin(".", ".."), F.array_append(folded, F.lit(""))).otherwise(folded), "/")

    whole = _let(_c(path), lambda p: F.when(p.contains("/.") | p.startswith("."), _let(F.split(p, "/"), fold)).otherwise(p))
    return _let(whole, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))


def resolve_url(base, href) -> Column:
    """urljoin(base, href): absolute, scheme-relative, root- and document-relative references,
    queries and fragments; dot segments are folded."""
    def relative(b: Column, h: Column) -> Column:
        own = F.regexp_extract(h, r"^([^?#]*)", 1)
        path = F.regexp_extract(b, PATH_RE, 1)
        folder = F.regexp_extract(path, r"^(.*/)[^/]*$", 1)
        joined = _let(folder, lambda f: F.concat(F.when(f == "", F.lit("/")).otherwise(f), own))
        joined = F.regexp_replace(joined, r"/{2,}", "/")  # empty segments go
        rest = F.regexp_extract(h, r"(?s)^[^?#]*(.*)$", 1)
        return F.concat(F.regexp_extract(b, SCHEME_HOST_RE, 1), fold_path(F.when(h.startswith("/"), own).otherwise(joined)), rest)

    def whole(x: Column) -> Column:
        b, h = x["b"], x["h"]
        return (F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
                .when(h.startswith("//"), F.concat(F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1), F.lit(":"), h))
                .when(h == "", b)
                .when(h.startswith("#"), F.concat(F.regexp_replace(b, r"#.*$", ""), h))
                .when(h.startswith("?"), F.concat(F.regexp_replace(b, r"[?#].*$", ""), h))
                .otherwise(relative(b, h)))

    return _let(F.struct(_c(base).alias("b"), _strip(href).alias("h")), whole)


def html_tokens(pages: DataFrame, key: str = "page_id", html: str = "html", keep=()) -> DataFrame:
    """The token stream: key, ``_page`` (a number a row), ``keep``, ``pos``, ``name`` (lower-case
    tag, null for text), ``close`` (an end tag) and ``raw``.  Comments, declarations and
    raw-text elements (scripts, styles) are left out."""
    found = F.regexp_extract_all(F.col(html), F.lit(TOKEN_RE), 0)
    t = pages.select(key, *keep, F.monotonically_increasing_id().alias("_page"), found.alias("_found"))
    t = t.select(key, *keep, "_page", F.posexplode("_found").alias("pos", "raw"))
    t = t.where(~F.col("raw").rlike(r"(?i)^<(?:[!?]|(?:" + "|".join(RAW_TEXT) + r")(?=[\s/>]))"))
    tag = F.col("raw").rlike(r"^</?[a-zA-Z]")
    return t.select(key, *keep, "_page", "pos", F.when(tag, F.lower(F.regexp_extract("raw", NAME_RE, 1))).alias("name"),
                    (tag & F.col("raw").startswith("</")).alias("close"), "raw")


def attribute(raw, name: str) -> Column:
    """The value of a start tag's attribute: quoted either way, bare, "" without one, null if
    the tag lacks it.  The first of repeated attributes counts."""
    pattern = ATTR_RE.replace("{name}", name)
    value = F.get(F.regexp_extract_all(_c(raw), F.lit(pattern), 2), 0)
    quoted = lambda v: (F.length(v) > 1) & F.left(v, F.lit(1)).isin("'", '"') & (F.left(v, F.lit(1)) == F.right(v, F.lit(1)))
    return _let(value, lambda v: unescape(F.when(quoted(v), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)))


def _joined(text: Column) -> Column:
    """Texts of a group in token order."""
    found = F.sort_array(F.collect_list(F.when(text.isNotNull(), F.struct("pos", text.alias("t")))))
    return F.array_join(F.transform(found, lambda x: x["t"]), "")


def html_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """SRC-11: one row per anchor with an href: (key, posicion, url, texto), url made absolute.

    An anchor ends at its end tag or where the next begins; its text is what is between,
    whatever tags that holds."""
    found = F.filter(F.regexp_extract_all(F.col(html), F.lit(TOKEN_RE), 0), lambda x: x.rlike(ANCHOR_OR_TEXT_RE))
    t = pages.select(key, F.col(url).alias("_base"), found.alias("_t"))
    # places (from 1) of the anchors' tags, and what is from each to the next
    tags = F.transform("_t", lambda x, i: F.when(x.startswith("<") & (F.length(x) > 1), i + 1))
    t = t.select("*", F.array_compact(tags).alias("_at"))
    between = lambda p, i: F.slice("_t", p + 1, F.coalesce(F.get("_at", i + 1), F.size("_t") + 1) - p - 1)
    anchors = F.transform("_at", lambda p, i: F.struct(F.get("_t", p - 1).alias("tag"), F.array_join(between(p, i), "").alias("text")))
    starts = F.filter(anchors, lambda x: ~x["tag"].startswith("</"))
    links = F.transform(starts, lambda x: F.struct(attribute(x["tag"], "href").alias("href"), x["text"].alias("text")))
    links = F.transform(F.filter(links, lambda x: x["href"].isNotNull()), lambda x: F.struct(
        resolve_url("_base", x["href"]).alias("url"), _strip(unescape(x["text"])).alias("texto")))
    return t.select(key, F.posexplode(links).alias("posicion", "_link")).select(key, "posicion", "_link.url", "_link.texto")


def salary_text_match(x) -> Column:
    """True when any salary pattern occurs in the lower-cased text."""
    return F.lower(_c(x)).rlike("|".join(f"(?:{p})" for p in SALARY_PATTERNS))


def _has_extension(url: Column, extensions) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(url).endswith(e) for e in extensions])


def link_relevance(links: DataFrame, text: str = "texto", url: str = "url",
                   path_keywords=("transparencia", "remuneraciones"), text_words=None) -> DataFrame:
    """SRC-12: keep links whose text matches a salary pattern, whose url holds a data-file
    extension, or whose url contains a path keyword; tags the reason.

    With ``text_words`` the strict rule: the url ends in a data-file extension and the text
    holds one of the words."""
    u = F.lower(F.col(url))
    if text_words is not None:
        said = reduce(lambda a, b: a | b, [F.lower(F.col(text)).contains(w) for w in text_words])
        return links.where(_has_extension(F.col(url), DATA_EXTENSIONS) & F.coalesce(said, F.lit(False))).withColumn("motivo", F.lit("extension y texto"))
    by_text = F.coalesce(salary_text_match(text), F.lit(False))
    by_ext = reduce(lambda a, b: a | b, [u.contains(e) for e in DATA_EXTENSIONS])
    by_path = reduce(lambda a, b: a | b, [u.contains(k) for k in path_keywords])
    reason = (F.when(by_text, F.lit("texto")).when(by_ext, F.lit("extension"))
              .when(by_path, F.lit("ruta")))
    return links.withColumn("motivo", reason).where(F.col("motivo").isNotNull())


def link_domain_filter(links: DataFrame, domain: str, key: str = "page_id", url: str = "url",
                       cap: int | None = None, extensions=None) -> DataFrame:
    """SRC-13: links on one domain, de-duplicated in first-seen order; with ``extensions`` only
    those that end in one of them, with ``cap`` the first per key."""
    on = links.where(host(url).contains(domain))
    if extensions is not None:
        on = on.where(_has_extension(F.col(url), extensions))
    first = on.groupBy(key, url).agg(F.min("posicion").alias("posicion"))
    if cap is None:
        return first
    w = Window.partitionBy(key).orderBy("posicion")
    return first.withColumn("orden", F.row_number().over(w)).where(F.col("orden") <= cap)


def text_relevance(pages: DataFrame, html: str = "html") -> DataFrame:
    """SCL-22: page mentions salary data (pattern in text, or a keyword inside a table)."""
    tables = F.regexp_extract_all(F.col(html), F.lit(TABLE_RE), 0)
    table_kw = F.exists(tables, lambda t: reduce(
        lambda a, b: a | b, [F.lower(strip_tags(t)).contains(k) for k in TABLE_KEYWORDS]))
    return pages.withColumn("relevante", salary_text_match(html) | table_kw)


def _cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, _page, tabla, _tr, _n (cell of the table, in order), texto, colspan, rowspan.

    A token belongs to every table that is open around it; only tags directly in a table
    (not in one inside it) shape it.  A cell ends where the next cell or row begins."""
    shape = ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "br")
    t = html_tokens(pages, key, html).where(F.col("name").isNull() | F.col("name").isin(*shape))
    up = (F.col("name") == "table") & ~F.col("close")
    down = (F.col("name") == "table") & F.col("close")
    page = Window.partitionBy("_page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_sum", F.sum(F.when(up, 1).when(down, -1).otherwise(0)).over(page))
    # end tags without a table count for nothing: the sum may not fall below 0
    t = t.withColumn("_depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(page))).withColumn("_tables", F.count(F.when(up, 1)).over(page))
    t = t.where("_depth > 0").withColumn("_level", F.explode(F.sequence(F.lit(1), F.col("_depth"))))
    level = Window.partitionBy("_page", "_level").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("_level") == F.col("_depth")
    t = t.withColumn("tabla", F.last(F.when(up & own, F.col("_tables") - 1), ignorenulls=True).over(level).cast("int"))
    table = Window.partitionBy("_page", "tabla").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    cell = own & F.col("name").isin("td", "th") & ~F.col("close")
    edge = own & F.col("name").isin(*[n for n in shape if n != "br"])
    t = t.withColumns({"_tr": F.count(F.when(own & (F.col("name") == "tr") & ~F.col("close"), 1)).over(table),
                       "_n": F.count(F.when(cell, 1)).over(table), "_in": F.last(F.when(edge, cell), ignorenulls=True).over(table)})
    text = F.when(F.col("name").isNull(), F.col("raw")).when((F.col("name") == "br") & ~F.col("close"), F.lit("\n"))
    cells = t.where("_in").groupBy(key, "_page", "tabla", "_tr", "_n").agg(F.first(F.when(cell, F.col("raw")), ignorenulls=True).alias("_tag"), _joined(text).alias("texto"))

    def span(name: str) -> Column:
        value = F.try_to_number(F.regexp_extract(F.coalesce(attribute("_tag", name), F.lit("")), r"^\s*([0-9]{1,5})\s*$", 1), F.lit("99999"))
        return F.greatest(F.coalesce(value.cast("int"), F.lit(1)), F.lit(1))

    clean = F.regexp_replace(_strip(unescape("texto")), r"[\r\n]+|\s{2,}", " ")
    return cells.select(key, "_page", "tabla", "_tr", "_n", clean.alias("texto"), F.least(span("colspan"), F.lit(MAX_COLSPAN)).alias("colspan"), span("rowspan").alias("rowspan"))


def _placed(cells: DataFrame, key: str) -> DataFrame:
    """key, _page, tabla, fila, columna, texto: the grid of every table, spans filled in.

    Rows that no cell from above reaches begin a block; within a block one fold over its cells
    gives each the first column that is free.  A row span ends with the table."""
    table = Window.partitionBy("_page", "tabla")
    rows = cells.withColumn("fila", F.dense_rank().over(table.orderBy("_tr")) - 1)
    rows = rows.withColumn("_last", F.max("fila").over(table))
    rows = rows.withColumn("_until", F.least(F.col("fila") + F.col("rowspan") - 1, F.col("_last")))
    reach = F.max("_until").over(table.orderBy("fila").rangeBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce(reach < F.col("fila"), F.lit(True)))
    rows = rows.withColumn("_block", F.max(F.when(F.col("_new"), F.col("fila"))).over(table.orderBy("fila").rangeBetween(Window.unboundedPreceding, 0)))
    item = F.struct("fila", "_n", "_until", "colspan", "texto")
    blocks = rows.groupBy(key, "_page", "tabla", "_block").agg(F.sort_array(F.collect_list(item)).alias("_cells"))
    kind = "struct<fila:int,next:int,taken:array<struct<fila:int,col:int>>,out:array<struct<fila:int,col:int,_until:int,colspan:int,texto:string>>>"

    def put(state: Column, x: Column) -> Column:
        start = F.when(x["fila"] == state["fila"], state["next"]).otherwise(F.lit(0))
        full = F.transform(F.filter(state["taken"], lambda c: c["fila"] == x["fila"]), lambda c: c["col"])
        col = F.array_min(F.array_except(F.sequence(start, start + F.size(full)), full)).cast("int")
        below = F.flatten(F.transform(F.filter(F.sequence(x["fila"], x["_until"]), lambda r: r > x["fila"]), lambda r: F.transform(
            F.sequence(col, col + x["colspan"] - 1), lambda c: F.struct(r.cast("int").alias("fila"), c.cast("int").alias("col")))))
        placed = F.struct(x["fila"].alias("fila"), col.alias("col"), x["_until"].alias("_until"), x["colspan"].alias("colspan"), x["texto"].alias("texto"))
        return F.struct(x["fila"].alias("fila"), (col + x["colspan"]).cast("int").alias("next"), F.concat(state["taken"], below).alias("taken"),
                        F.array_append(state["out"], placed).alias("out")).cast(kind)

    begin = F.from_json(F.lit('{"fila": -1, "next": 0, "taken": [], "out": []}'), kind)
    grid = blocks.select(key, "_page", "tabla", F.explode(F.aggregate("_cells", begin, put)["out"]).alias("c"))
    grid = grid.select(key, "_page", "tabla", F.explode(F.sequence("c.fila", "c._until")).alias("fila"), "c.col", "c.colspan", "c.texto")
    return grid.select(key, "_page", "tabla", "fila", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1)).alias("columna"), "texto")


def html_tables(pages: DataFrame, key: str = "page_id", html: str = "html",
                first_only: bool = False) -> DataFrame:
    """SRC-10: every (or the first) ``<table>`` of every page as rows, tables in tables too.

    Output: (key, tabla, fila, celdas array<string>, registro map<header, cell>);
    the first row of a table is its header and is not repeated as data.  Row and column spans
    repeat their text; of equal headers the later ones are numbered (``x``, ``x.1``); cells
    beyond the header are named by their place (``_c3``), missing ones are null.
    """
    cells = _cells(pages, key, html)
    if first_only:
        cells = cells.where(F.col("tabla") == 0)
    grid = _placed(cells, key)
    found = F.map_from_entries(F.array_agg(F.struct("columna", "texto")))
    # two spans may claim one place: the first cell has it
    grid = grid.groupBy(key, "_page", "tabla", "fila", "columna").agg(F.first("texto").alias("texto"))
    rows = grid.groupBy(key, "_page", "tabla", "fila").agg(found.alias("_m"), F.max("columna").alias("_w"))
    rows = rows.withColumn("celdas", F.transform(F.sequence(F.lit(0), F.col("_w")), lambda i: F.element_at("_m", i))).drop("_m", "_w")
    head = F.first(F.when(F.col("fila") == 0, F.col("celdas")), ignorenulls=True).over(Window.partitionBy("_page", "tabla"))
    rows = rows.withColumn("_h", F.coalesce(head, F.array().cast("array<string>"))).where("fila > 0")
    base = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_h"), F.size("celdas")) - 1),
                       lambda i: F.coalesce(F.get("_h", i), F.concat(F.lit("_c"), i.cast("string"))))
    rows = rows.withColumn("_names", base)
    before = lambda x, i: F.size(F.filter(F.slice("_names", 1, i), lambda y: y == x))
    names = F.transform("_names", lambda x, i: F.when(before(x, i) > 0, F.concat(x, F.lit("."), before(x, i).cast("string"))).otherwise(x))
    rows = rows.withColumn("_names", names)
    record = F.map_from_arrays("_names", F.transform("_names", lambda x, i: F.get("celdas", i)))
    unique = F.size(F.array_distinct("_names")) == F.size("_names")
    return rows.select(key, "tabla", "fila", "celdas", F.when(unique, record).alias("registro"))
