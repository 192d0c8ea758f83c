"""URL and date helpers (SCL-18..20, 28..30)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish month names in calendar order.
MONTHS_ES = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto",
             "septiembre", "octubre", "noviembre", "diciembre"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def year_from_url(url, default: str = "2024") -> Column:
    """SCL-18: first '/dddd/' path segment, else a default year."""
    y = F.regexp_extract(_c(url), r"/([0-9]{4})/", 1)
    return F.when(y != "", y).otherwise(F.lit(default))


def month_from_url(url, default: str = "01") -> Column:
    """SCL-19: first month name (calendar order) contained in the url -> '01'..'12'."""
    u = F.lower(_c(url))
    expr = None
    for i, m in enumerate(MONTHS_ES, start=1):
        cond, val = u.contains(m), F.lit(f"{i:02d}")
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(F.lit(default))


def staff_type_from_url(url) -> Column:
    """SCL-20: planta / contrata / honorarios."""
    u = _c(url)
    return (F.when(u.contains("planta"), F.lit("planta"))
            .when(u.contains("contrata"), F.lit("contrata"))
            .otherwise(F.lit("honorarios")))


def money_format(x) -> Column:
    """SCL-28: '$1,234,567' (no decimals)."""
    return F.concat(F.lit("$"), F.format_number(F.bround(_c(x), 0), 0))


def pct_format(x, decimals: int = 1) -> Column:
    return F.concat(F.format_number(_c(x), decimals), F.lit("%"))


def signed_format(x) -> Column:
    """'+1,234' / '-1,234'."""
    v = F.bround(_c(x), 0)
    return F.concat(F.when(v >= 0, F.lit("+")).otherwise(F.lit("-")), F.format_number(F.abs(v), 0))


def ts_format(ts) -> Column:
    """SCL-29: timestamp -> 'yyyy-MM-dd HH:mm:ss' text."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")


def hours_since(ts, as_of) -> Column:
    """SCL-29: hours elapsed between ``ts`` and ``as_of`` (both timestamps)."""
    return (F.unix_timestamp(_c(as_of)) - F.unix_timestamp(_c(ts))) / F.lit(3600.0)
