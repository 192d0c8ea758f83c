"""File, JSON and manifest sources on small fixtures written to the checkpoint dir."""

import json
import os
import uuid

from pyspark.sql.types import StringType, StructField, StructType

from nomina.session import scratch_path
from nomina.sources import documents as D
from nomina.sources import files as FS
from nomina.sources import html as H


def _local(path: str) -> str:
    return path.replace("file:", "")


def test_csv_dialect_sniffing_latin1_semicolon(spark):
    base = _local(scratch_path(spark, f"dialect-{uuid.uuid4().hex[:8]}"))
    os.makedirs(base)
    with open(f"{base}/tabla.csv", "w", encoding="latin-1") as fh:
        fh.write("Estamento;Grado;Remuneración\nDirectivo;1;7.738.744\nTécnico;2;659.267\n")
    (f,) = FS.file_dialects(spark, base).collect()
    assert (f["sep"], f["encoding"], f["header"][:9]) == (";", FS.LATIN1, "Estamento")
    rows = FS.csv_dialect_scan(spark, base).collect()
    assert [r["Estamento"] for r in rows] == ["Directivo", "Técnico"]
    assert rows[0]["Remuneración"] == "7.738.744"


def test_month_dir_scan_provenance_and_union(spark):
    root = _local(scratch_path(spark, f"raw-{uuid.uuid4().hex[:8]}"))
    for src, month, header, row in [("sii", "2025-09", "Nombre,Sueldo", "Ana,1.000.000"),
                                    ("sii", "2025-10", "Nombre,Sueldo", "Luis,900.000"),
                                    ("dipres", "2025-09", "Funcionario,Monto,Tipo", "Eva,800.000,planta")]:
        os.makedirs(f"{root}/{src}/{month}")
        with open(f"{root}/{src}/{month}/tabla.csv", "w") as fh:
            fh.write(header + "\n" + row + "\n")
    df = FS.month_dir_scan(spark, root, ["sii", "dipres", "falta"], as_of="2025-10-31 00:00:00")
    got = sorted((r["fuente"], r["periodo"], r["archivo_origen"]) for r in df.collect())
    assert got == [("dipres", "2025-09", "tabla.csv"), ("sii", "2025-09", "tabla.csv"), ("sii", "2025-10", "tabla.csv")]
    assert set(df.columns) >= {"Nombre", "Sueldo", "Funcionario", "Monto", "Tipo"}
    assert FS.load_many(spark, [f"{root}/no/existe.csv"]) is None


def test_each_file_has_its_own_header_and_encoding(spark):
    root = _local(scratch_path(spark, f"raw-{uuid.uuid4().hex[:8]}"))
    os.makedirs(f"{root}/sii/2025-09")
    plain = "".join(f"Luis,{n},Z\n" for n in range(400))
    files = {"a.csv": ("Nombres,Sueldo,Cargo\n" + plain, "utf-8"), "b.csv": ("Sueldo,Cargo,Nombres,Extra\n300,Z,Eva,x\n", "utf-8"),
             "c.csv": ("Nombres,Sueldo,Cargo\n" + plain + "Muñoz,1,Técnico\n", "latin-1"), "d.csv": ("Nombres;Sueldo\nJosé;5\n", "utf-8"), "e.csv": ("", "utf-8")}
    for name, (text, encoding) in files.items():
        with open(f"{root}/sii/2025-09/{name}", "w", encoding=encoding) as fh:
            fh.write(text)
    rows = {(r["archivo_origen"], r["Nombres"], r["Sueldo"], r["Cargo"], r["Extra"]) for r in FS.month_dir_scan(spark, root).collect() if r["Nombres"] != "Luis"}
    assert rows == {("b.csv", "Eva", "300", "Z", "x"), ("c.csv", "Muñoz", "1", "Técnico", None), ("d.csv", "José", "5", None, None)}
    assert FS.month_dir_scan(spark, root).count() == 803


def test_json_records_nested_path(spark):
    doc = {"result": {"records": [{"nombre": "Ana", "sueldo": "1.200.000"}, {"nombre": "Luis", "sueldo": "950.000"}]}}
    df = spark.createDataFrame([(1, json.dumps(doc))], "id long, j string")
    schema = StructType([StructField("nombre", StringType()), StructField("sueldo", StringType())])
    rows = D.json_records(df, "j", schema, keep=("id",)).collect()
    assert [(r["id"], r["nombre"], r["sueldo"]) for r in rows] == [(1, "Ana", "1.200.000"), (1, "Luis", "950.000")]


def test_manifest_classification_and_upsert(spark):
    prev = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, t string")
    cur = spark.createDataFrame([("a", "x"), ("b", "z"), ("c", "w")], "k string, t string")
    p, c = D.content_manifest(prev, "k", "t"), D.content_manifest(cur, "k", "t")
    cls = {r["clave"]: r["estado"] for r in D.classify_against_manifest(c, p).collect()}
    assert cls == {"a": "SAME", "b": "CHANGED", "c": "NEW"}
    new = {r["clave"]: r["sha256"] for r in D.upsert_manifest(p, D.classify_against_manifest(c, p)).collect()}
    assert new == {r["clave"]: r["sha256"] for r in c.collect()}


def test_load_gate_failures(spark):
    import pytest

    from nomina.sources.sinks import LoadGateError, load_gate

    ok = spark.createDataFrame([("A", 1.0), (None, 2.0)], "organismo string, sueldo_bruto double")
    assert load_gate(ok)["n"] == 2
    with pytest.raises(LoadGateError, match="faltan columnas"):
        load_gate(ok.drop("organismo"))
    with pytest.raises(LoadGateError, match="no hay registros"):
        load_gate(ok.limit(0))
    with pytest.raises(LoadGateError, match="ningún registro"):
        load_gate(spark.createDataFrame([("A", None)], "organismo string, sueldo_bruto double"))
    with pytest.raises(LoadGateError, match="tasa de nulos"):
        load_gate(ok, max_null_rate=0.25)


def test_domain_links_have_no_cap_by_default(spark):
    links = spark.createDataFrame([(1, f"https://a.example.com/{i}", i) for i in range(8)], "page_id long, url string, posicion int")
    assert H.link_domain_filter(links, "example.com").count() == 8
    assert H.link_domain_filter(links, "example.com", cap=5).count() == 5
