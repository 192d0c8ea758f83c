"""Text, categorisation, URL and HTML column functions."""

import pytest

from nomina.functions import categorize as C
from nomina.functions import text as T
from nomina.functions import urls as U
from nomina.functions.geo import city_from_text
from nomina.sources import html as H


def _one(spark, col_expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col_expr.alias("r")).first()["r"]


@pytest.mark.parametrize("raw,expected", [
    ("  hola   mundo ", "hola mundo"), ("\tNaN\n", None), ("null", None), ("", None), (None, None),
    ("a\t\tb", "a b"),
])
def test_clean_text(spark, raw, expected):
    assert _one(spark, T.clean_text("x"), raw) == expected


def test_capitalize_canon_fill(spark):
    assert _one(spark, T.capitalize_words("x"), "  jUAN   pérez ") == "Juan Pérez"
    assert _one(spark, T.capitalize_words("x"), None) == ""
    assert _one(spark, T.canon_class("x"), " tecnico ") == "TÉCNICO"
    assert _one(spark, T.canon_class("x"), "otro") == "OTRO"
    assert _one(spark, T.fill_trim("x"), None) == "Sin especificar"
    assert _one(spark, T.slug("x"), "Consejo Nacional de Educación") == "consejonacionaldeeducacion"


def test_full_name_keeps_inner_blank(spark):
    df = spark.createDataFrame([("Ana", None, "Soto")], "a string, b string, c string")
    assert df.select(T.full_name("a", "b", "c").alias("n")).first()["n"] == "Ana  Soto"


@pytest.mark.parametrize("body,cat11,cat5", [
    ("Ministerio de Salud", "Ministerio", "Ministerios"),
    ("Servicio de Impuestos Internos", "Servicio", "Servicios Públicos"),
    ("Municipalidad de Talca", "Municipalidad", "Municipalidades"),
    ("Servicio Nacional Universidad", "Servicio", "Otros Organismos del Estado"),
    ("Fundación Integra", "Fundación", "Otros"),
    ("Dirección del Trabajo", "Otros", "Otros Organismos del Estado"),
])
def test_categories(spark, body, cat11, cat5):
    assert _one(spark, C.categorize_11("x"), body) == cat11
    assert _one(spark, C.categorize_5("x"), body) == cat5


@pytest.mark.parametrize("v,dash,enrich", [
    (0.0, "< $500K", None), (500_000.0, "< $500K", "Bajo"), (500_000.01, "$500K-$1M", "Medio-Bajo"),
    (2_000_000.0, "$1.5M-$2M", "Medio"), (7_000_000.0, "> $2M", "Alto"), (None, None, None),
])
def test_bands_right_closed(spark, v, dash, enrich):
    assert _one(spark, C.band_dashboard("x"), v, "x double") == dash
    assert _one(spark, C.band_enrich("x"), v, "x double") == enrich


def test_infer_class_and_label(spark):
    assert _one(spark, C.infer_class("x"), "Jefe Director Regional") == "Directivo"
    assert _one(spark, C.infer_class("x"), "Técnico en Redes") == "Técnico"
    assert _one(spark, C.infer_class("x"), "Chofer") == "Auxiliar"
    assert _one(spark, C.inequality_label("x"), 0.35, "x double") == "Desigualdad moderada"


def test_url_fields(spark):
    url = "https://www.example.cl/transparencia/2023/planta/remuneraciones-marzo.pdf"
    assert _one(spark, U.year_from_url("x"), url) == "2023"
    assert _one(spark, U.month_from_url("x"), url) == "03"
    assert _one(spark, U.staff_type_from_url("x"), url) == "planta"
    assert _one(spark, C.file_kind("x"), url) == "pdf"
    assert _one(spark, T.safe_filename("x"), url) == "remuneraciones-marzo.pdf"
    assert _one(spark, T.safe_filename("x"), "https://a.cl/") == "https_a_cl_"


def test_city_from_text_order(spark):
    assert _one(spark, city_from_text("x"), "Liceo de Santiago Centro") == "Municipalidad de Santiago"
    assert _one(spark, city_from_text("x"), "Escuela Puerto Montt") == "Municipalidad de Puerto Montt"
    assert _one(spark, city_from_text("x"), "Oficina central") is None


@pytest.mark.parametrize("base,href,expected", [
    ("http://a.cl/x/y.html?q=1", "z.csv", "http://a.cl/x/z.csv"),
    ("http://a.cl/x/y.html", "/r/s.pdf", "http://a.cl/r/s.pdf"),
    ("https://a.cl", "t.xls", "https://a.cl/t.xls"),
    ("https://a.cl/p/", "//cdn.cl/f.csv", "https://cdn.cl/f.csv"),
    ("https://a.cl/p/q", "http://b.cl/", "http://b.cl/"),
])
def test_resolve_url(spark, base, href, expected):
    df = spark.createDataFrame([(base, href)], "b string, h string")
    assert df.select(H.resolve_url("b", "h").alias("u")).first()["u"] == expected


def test_html_links_and_tables(spark):
    html = ('<html><body><a href="/docs/remuneraciones.csv">Remuneración <b>2024</b></a>'
            '<a class="x" href="otra.html">Inicio</a>'
            '<table><tr><th>Nombre</th><th>Sueldo</th></tr><tr><td>Ana</td><td>1.200.000</td></tr>'
            '<tr><td>Luis</td><td>950.000</td></tr></table></body></html>')
    pages = spark.createDataFrame([(1, "https://muni.cl/transparencia/index.html", html)],
                                  "page_id long, url string, html string")
    links = H.html_links(pages).orderBy("posicion").collect()
    assert [r["url"] for r in links] == ["https://muni.cl/docs/remuneraciones.csv",
                                         "https://muni.cl/transparencia/otra.html"]
    assert links[0]["texto"] == "Remuneración 2024"
    rel = H.link_relevance(H.html_links(pages)).orderBy("posicion").collect()
    assert [r["motivo"] for r in rel] == ["texto", "ruta"]
    rows = H.html_tables(pages).orderBy("fila").collect()
    assert [r["registro"]["Sueldo"] for r in rows] == ["1.200.000", "950.000"]
    assert H.text_relevance(pages).first()["relevante"] is True
