"""Ordered first-match categorisation rules (SCL-12..17, 21, 27).

Each rule list is a fixed, ordered vocabulary; evaluation is a chained
``CASE WHEN`` so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from nomina.functions.text import MISSING

# Body category, first keyword (lower-case) contained wins.
BODY_CATEGORY_11 = [
    ("Ministerio", ["ministerio"]),
    ("Municipalidad", ["municipalidad"]),
    ("Servicio", ["servicio"]),
    ("Universidad", ["universidad"]),
    ("Corporación", ["corporacion", "corporación"]),
    ("Fundación", ["fundacion", "fundación"]),
    ("Instituto", ["instituto"]),
    ("Agencia", ["agencia"]),
    ("Comisión", ["comision", "comisión"]),
    ("Consejo", ["consejo"]),
]

# The twenty ministries of the five-way body category.
MINISTRIES = [
    "Ministerio de Educación",
    "Ministerio de Salud",
    "Ministerio del Trabajo y Previsión Social",
    "Ministerio de Hacienda",
    "Ministerio del Interior y Seguridad Pública",
    "Ministerio de Justicia y Derechos Humanos",
    "Ministerio de Defensa Nacional",
    "Ministerio de Relaciones Exteriores",
    "Ministerio de Obras Públicas",
    "Ministerio de Transportes y Telecomunicaciones",
    "Ministerio de Vivienda y Urbanismo",
    "Ministerio del Medio Ambiente",
    "Ministerio de Energía",
    "Ministerio de Minería",
    "Ministerio de Agricultura",
    "Ministerio de Desarrollo Social y Familia",
    "Ministerio de las Culturas, las Artes y el Patrimonio",
    "Ministerio del Deporte",
    "Ministerio de la Mujer y la Equidad de Género",
    "Ministerio de Ciencia, Tecnología, Conocimiento e Innovación",
]
# The exact public-service name and the state keywords.
TAX_SERVICE = "Servicio de Impuestos Internos"
STATE_KEYWORDS = ["ministerio", "servicio", "dirección", "comisión", "fiscalía"]

# The open-data API source whose rows lack body and class.
API_SOURCE = "datos_gob_cl_api"

# Class inferred from a post title, ordered keyword lists.
CLASS_FROM_POST = [
    ("Directivo", ["alcalde", "concejal", "director", "ministro", "subsecretario"]),
    ("Profesional", ["profesional", "ingeniero", "abogado", "médico", "enfermero"]),
    ("Técnico", ["técnico", "analista"]),
    ("Administrativo", ["administrativo", "secretario", "asistente"]),
]

# Salary bands.  Dashboard: 0/500k/1M/1.5M/2M/inf, lowest included.
BANDS_DASHBOARD = [(500_000, "< $500K"), (1_000_000, "$500K-$1M"), (1_500_000, "$1M-$1.5M"),
                   (2_000_000, "$1.5M-$2M"), (float("inf"), "> $2M")]
# Enrichment: 0/500k/1M/2M/5M/inf, right-closed, exactly 0 (and below) -> null.
BANDS_ENRICH = [(500_000, "Bajo"), (1_000_000, "Medio-Bajo"), (2_000_000, "Medio"),
                (5_000_000, "Medio-Alto"), (float("inf"), "Alto")]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _any_contains(s: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [s.contains(w) for w in words])


def categorize_11(x) -> Column:
    """SCL-12: eleven-way body category ('Otros' when nothing matches)."""
    s = F.lower(_c(x).cast("string"))
    expr = None
    for label, words in BODY_CATEGORY_11:
        cond = F.coalesce(_any_contains(s, words), F.lit(False))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit("Otros"))


def categorize_5(x) -> Column:
    """SCL-13: Ministerios / Servicios Públicos / Municipalidades / Otros Organismos del Estado / Otros."""
    t = F.trim(_c(x).cast("string"))
    s = F.lower(t)
    return (F.when(_c(x).isNull(), F.lit(MISSING))
            .when(t == TAX_SERVICE, F.lit("Servicios Públicos"))
            .when(_any_contains(s, [m.lower() for m in MINISTRIES]), F.lit("Ministerios"))
            .when(s.contains("municipalidad"), F.lit("Municipalidades"))
            .when(_any_contains(s, STATE_KEYWORDS), F.lit("Otros Organismos del Estado"))
            .otherwise(F.lit("Otros")))


def infer_class(post) -> Column:
    """SCL-14: class from the post title, default 'Auxiliar'."""
    p = _c(post)
    s = F.lower(p.cast("string"))
    expr = F.when(p.isNull() | (p == MISSING), F.lit(MISSING))
    for label, words in CLASS_FROM_POST:
        expr = expr.when(_any_contains(s, words), F.lit(label))
    return expr.otherwise(F.lit("Auxiliar"))


def infer_body(body, source, source_value: str = API_SOURCE) -> Column:
    """SCL-15: missing body of one source -> 'Municipalidad'."""
    b = _c(body)
    return F.when((_c(source) == source_value) & (b.isNull() | (b == MISSING)),
                  F.lit("Municipalidad")).otherwise(b)


def band_dashboard(x) -> Column:
    """SCL-16: right-closed bands, lowest edge (0) included."""
    v = _c(x)
    expr = F.when(v.isNull() | (v < 0), F.lit(None).cast("string"))
    for hi, label in BANDS_DASHBOARD:
        expr = expr.when(v <= hi, F.lit(label))
    return expr


def band_dashboard_ordinal(x) -> Column:
    v = _c(x)
    expr = F.when(v.isNull() | (v < 0), F.lit(None).cast("int"))
    for i, (hi, _label) in enumerate(BANDS_DASHBOARD):
        expr = expr.when(v <= hi, F.lit(i))
    return expr


def band_enrich(x) -> Column:
    """SCL-17: right-closed bands, 0 excluded (-> null)."""
    v = _c(x)
    expr = F.when(v.isNull() | (v <= 0), F.lit(None).cast("string"))
    for hi, label in BANDS_ENRICH:
        expr = expr.when(v <= hi, F.lit(label))
    return expr


def inequality_label(gini) -> Column:
    """SCL-27: Gini < 0.3 low, < 0.5 moderate, else high."""
    g = _c(gini)
    return (F.when(g < 0.3, F.lit("Baja desigualdad"))
            .when(g < 0.5, F.lit("Desigualdad moderada"))
            .otherwise(F.lit("Alta desigualdad")))


def file_kind(url) -> Column:
    """SCL-21: file extension -> csv / excel / pdf, else html."""
    u = _c(url)
    return (F.when(u.endswith(".csv"), F.lit("csv"))
            .when(u.endswith(".xlsx") | u.endswith(".xls"), F.lit("excel"))
            .when(u.endswith(".pdf"), F.lit("pdf"))
            .otherwise(F.lit("html")))
