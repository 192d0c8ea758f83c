"""City / municipality detection in free text (SCL-23)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# City pattern (lower-case substring) -> municipality, in match order.
CITY_PATTERNS = [
    ("san felipe", "Municipalidad de San Felipe"),
    ("angol", "Municipalidad de Angol"),
    ("concepcion", "Municipalidad de Concepción"),
    ("santiago", "Municipalidad de Santiago"),
    ("valparaiso", "Municipalidad de Valparaíso"),
    ("vina del mar", "Municipalidad de Viña del Mar"),
    ("temuco", "Municipalidad de Temuco"),
    ("antofagasta", "Municipalidad de Antofagasta"),
    ("la serena", "Municipalidad de La Serena"),
    ("rancagua", "Municipalidad de Rancagua"),
    ("talca", "Municipalidad de Talca"),
    ("chillan", "Municipalidad de Chillán"),
    ("osorno", "Municipalidad de Osorno"),
    ("puerto montt", "Municipalidad de Puerto Montt"),
    ("arica", "Municipalidad de Arica"),
    ("iquique", "Municipalidad de Iquique"),
    ("calama", "Municipalidad de Calama"),
    ("copiapo", "Municipalidad de Copiapó"),
    ("coquimbo", "Municipalidad de Coquimbo"),
    ("valdivia", "Municipalidad de Valdivia"),
]
# School name -> municipality, consulted after the city patterns.
INSTITUTION_PATTERNS = [
    ("LICEO SAN FELIPE", "Municipalidad de San Felipe"),
    ("ESCUELA SAN FELIPE", "Municipalidad de San Felipe"),
    ("COLEGIO SAN FELIPE", "Municipalidad de San Felipe"),
    ("LICEO ANGOL", "Municipalidad de Angol"),
    ("ESCUELA ANGOL", "Municipalidad de Angol"),
    ("COLEGIO ANGOL", "Municipalidad de Angol"),
    ("LICEO CONCEPCION", "Municipalidad de Concepción"),
    ("ESCUELA CONCEPCION", "Municipalidad de Concepción"),
    ("COLEGIO CONCEPCION", "Municipalidad de Concepción"),
    ("LICEO SANTIAGO", "Municipalidad de Santiago"),
    ("ESCUELA SANTIAGO", "Municipalidad de Santiago"),
    ("COLEGIO SANTIAGO", "Municipalidad de Santiago"),
]
ALL_PATTERNS = [(p, m) for p, m in CITY_PATTERNS] + [(p.lower(), m) for p, m in INSTITUTION_PATTERNS]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def city_from_text(x) -> Column:
    """SCL-23: municipality suggested by the first pattern contained in the text (or null).

    An ordered ``CASE`` over a fixed list; substring semantics are kept
    (``santiago`` inside another word counts, A-23).
    """
    s = F.lower(_c(x))
    expr = F.when(_c(x).isNull() | (_c(x) == ""), F.lit(None).cast("string"))
    for pattern, municipality in ALL_PATTERNS:
        expr = expr.when(s.contains(pattern), F.lit(municipality))
    return expr
