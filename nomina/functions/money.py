"""Locale-aware money parsing as Column expressions (SCL-02..07).

Five dialects exist because different extractors disagree on how to read
separators; each is kept by name so results stay reproducible:

  money_auto       (P1) general decision on ``.``/``,`` (default)
  money_cl         (P2) Chilean: drop every ``.``, ``,`` -> ``.``; keeps sign
  money_validator  (P3) validator flavour
  money_extractor  (P4) extractor flavour (fails on ``1.234.567``)
  money_multidot   (P5) only a repeated dot is a thousands separator

All but P2 first keep only ``[0-9.,]`` (so a minus sign is dropped).  Every
branch ends in ``try_cast`` so unparsable text is null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text markers that P2 treats as missing.
CL_NULL_MARKERS = ["nan", "Sin especificar", "No percibe remuneraciones adicionales"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _digits(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), "[^0-9.,]", "")


def _count(s: Column, ch: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))


def _after_last(s: Column, ch: str) -> Column:
    return F.substring_index(s, ch, -1)


def _drop(s: Column, ch: str) -> Column:
    return F.replace(s, F.lit(ch), F.lit(""))


def _european(s: Column) -> Column:
    return F.replace(_drop(s, "."), F.lit(","), F.lit("."))


# A plain decimal number; type suffixes ("12D", "1f") and names ("NaN", "Infinity") are not numbers.
NUMBER_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _try_double(s: Column) -> Column:
    return F.when(s.rlike(NUMBER_RE), s.try_cast("double"))


def money_auto(x) -> Column:
    """P1: decide thousands vs decimal separators from their count and tail."""
    s = _digits(_c(x))
    n_comma, n_dot = _count(s, ","), _count(s, ".")
    comma_tail = F.length(_after_last(s, ","))
    dot_tail = F.length(_after_last(s, "."))
    both = F.when((n_comma == 1) & (comma_tail <= 2), _european(s)).otherwise(_drop(s, ","))
    comma_only = (F.when((n_comma == 1) & (comma_tail <= 2), F.replace(s, F.lit(","), F.lit(".")))
                  .otherwise(_drop(s, ",")))
    dot_only = (F.when(n_dot > 1, _drop(s, "."))
                .when(dot_tail <= 2, s)
                .otherwise(_drop(s, ".")))
    out = (F.when((s == "") | (s == "."), F.lit(None).cast("string"))
           .when((n_comma > 0) & (n_dot > 0), both)
           .when(n_comma > 0, comma_only)
           .when(n_dot > 0, dot_only)
           .otherwise(s))
    return _try_double(out)


def money_cl(x) -> Column:
    """P2: Chilean text; every dot is a thousands mark, the comma is decimal."""
    t = _c(x).cast("string")
    s = F.replace(_drop(t, "."), F.lit(","), F.lit("."))
    return F.when(t.isin(*CL_NULL_MARKERS), F.lit(None).cast("double")).otherwise(_try_double(F.trim(s)))


def money_validator(x) -> Column:
    """P3: both separators -> European; dots dropped when >1 or tail <= 2."""
    s = _digits(_c(x))
    n_comma, n_dot = _count(s, ","), _count(s, ".")
    dot = F.when((n_dot > 1) | (F.length(_after_last(s, ".")) <= 2), _drop(s, ".")).otherwise(s)
    out = (F.when((n_comma > 0) & (n_dot > 0), _european(s))
           .when(n_dot > 0, dot)
           .otherwise(s))
    return _try_double(out)


def money_extractor(x) -> Column:
    """P4: both -> European; dots dropped only when the last group has <= 2 digits."""
    s = _digits(_c(x))
    n_comma, n_dot = _count(s, ","), _count(s, ".")
    out = (F.when((n_comma > 0) & (n_dot > 0), _european(s))
           .when((n_dot > 0) & (F.length(_after_last(s, ".")) <= 2), _drop(s, "."))
           .otherwise(s))
    return _try_double(out)


def money_multidot(x) -> Column:
    """P5: both -> European; more than one dot -> thousands; one dot is decimal."""
    s = _digits(_c(x))
    n_comma, n_dot = _count(s, ","), _count(s, ".")
    out = (F.when((n_comma > 0) & (n_dot > 0), _european(s))
           .when(n_dot > 1, _drop(s, "."))
           .otherwise(s))
    return _try_double(out)


def to_number(x) -> Column:
    """SCL-07: coerce to double, failures -> null."""
    return _try_double(_c(x).cast("string"))


PARSERS = {
    "auto": money_auto,
    "cl": money_cl,
    "validator": money_validator,
    "extractor": money_extractor,
    "multidot": money_multidot,
}


def parse_money(x, dialect: str = "auto") -> Column:
    return PARSERS[dialect](x)
