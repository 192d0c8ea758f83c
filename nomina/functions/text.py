"""Text cleaning Column functions (SCL-01, 08..11, 24..26, 30; MAP-11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentinel used for missing categorical values.
MISSING = "Sin especificar"
# Tokens that clean_text treats as missing (compared lower-cased).
NULL_TOKENS = ["", "nan", "none", "null"]
# Class spelling canonicalisation (others pass through upper-cased).
CLASS_CANON = {
    "DIRECTIVO": "DIRECTIVO", "PROFESIONAL": "PROFESIONAL", "TECNICO": "TÉCNICO",
    "TÉCNICO": "TÉCNICO", "ADMINISTRATIVO": "ADMINISTRATIVO", "AUXILIAR": "AUXILIAR",
    "FISCALIZADOR": "FISCALIZADOR", "EJECUTIVO": "EJECUTIVO", "SUPERVISOR": "SUPERVISOR",
    "COORDINADOR": "COORDINADOR", "ANALISTA": "ANALISTA",
}


# ASCII whitespace as Python's str.strip()/split() see it (Java's \\s).
WS = r"[ \t\n\x0B\f\r]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Remove leading/trailing whitespace (not only spaces, unlike ``trim``)."""
    return F.regexp_replace(_c(x).cast("string"), f"^{WS}+|{WS}+$", "")


def clean_text(x) -> Column:
    """SCL-01: trim, null-ish tokens -> null, collapse inner whitespace."""
    t = strip(x)
    return F.when(F.lower(t).isin(*NULL_TOKENS) | t.isNull(), F.lit(None).cast("string")) \
        .otherwise(F.regexp_replace(t, f"{WS}+", " "))


def fill_trim(x, sentinel: str = MISSING) -> Column:
    """SCL-08: null -> sentinel, then trim."""
    return strip(F.coalesce(_c(x).cast("string"), F.lit(sentinel)))


def upper_class(x, sentinel: str = MISSING) -> Column:
    """SCL-09: fill + trim + upper."""
    return F.upper(fill_trim(x, sentinel))


def capitalize_words(x) -> Column:
    """SCL-10: collapse whitespace and capitalise each word; null -> ''."""
    t = F.regexp_replace(strip(x), f"{WS}+", " ")
    return F.coalesce(F.initcap(F.lower(t)), F.lit(""))


def canon_class(x) -> Column:
    """SCL-11: upper-case and map known spellings; null -> ''."""
    u = F.upper(F.trim(_c(x).cast("string")))
    m = F.create_map(*[F.lit(v) for kv in CLASS_CANON.items() for v in kv])
    return F.coalesce(F.coalesce(F.try_element_at(m, u), u), F.lit(""))


def slug(x) -> Column:
    """SCL-24: lower, drop blanks, fold accented vowels."""
    return F.translate(F.replace(F.lower(_c(x)), F.lit(" "), F.lit("")), "áéíóú", "aeiou")


def safe_filename(url) -> Column:
    """SCL-25: basename of the url path, else the url with runs of non-word chars -> '_'
    (letters and digits of any script are word chars)."""
    path = F.coalesce(F.parse_url(_c(url), F.lit("PATH")), F.lit(""))
    base = F.regexp_extract(path, r"([^/]+)$", 1)
    return F.when(base != "", base).otherwise(F.regexp_replace(_c(url), r"[^\p{L}\p{N}_]+", "_"))


def contains_ci(x, needle: str) -> Column:
    """SCL-26: case-insensitive contains, null -> false."""
    return F.coalesce(F.lower(_c(x)).contains(needle.lower()), F.lit(False))


def full_name(given, paternal, maternal) -> Column:
    """MAP-11: 'given paternal maternal', nulls as '', ends trimmed (inner blanks kept)."""
    parts = [F.coalesce(_c(p).cast("string"), F.lit("")) for p in (given, paternal, maternal)]
    return F.trim(F.concat_ws(" ", *parts))
