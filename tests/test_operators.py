"""Quality, sampling, mapping and streaming operators on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from nomina.operators import mapping as MP
from nomina.operators import quality as Q
from nomina.operators import sampling as G
from nomina.streaming import progress as PR


def test_row_errors_messages(spark):
    rows = [(1, "Ana Soto", "Analista", "PROFESIONAL", "Ministerio de Salud", 1_500_000.0),
            (2, "X1", "Jefe", "GERENTE", "Empresa", 50_000.5),
            (3, None, "", "técnico", "Municipalidad de Talca", None)]
    df = spark.createDataFrame(rows, "id long, nombre string, cargo string, estamento string, "
                                     "organismo string, sueldo_bruto double")
    got = {r["id"]: r["errores"] for r in Q.row_errors(df).collect()}
    assert got[1] == []
    assert got[2] == ["Sueldo: Sueldo muy bajo: $50,000", "Nombre: Nombre muy corto",
                      "Estamento: Estamento no válido: GERENTE", "Organismo: Organismo no válido: EMPRESA"]
    assert got[3] == ["Sueldo: Sueldo nulo", "Nombre: Nombre vacío", "Cargo: Cargo vacío"]


def test_geo_mismatch_and_fix(spark):
    rows = [(1, "Municipalidad de Angol", "Profesor Liceo Santiago"),
            (2, "Municipalidad de Santiago", "Escuela Santiago Centro"),
            (3, "Ministerio de Salud", "Liceo Talca")]
    df = spark.createDataFrame(rows, "id long, organismo string, cargo string")
    v = Q.geo_validate(df)
    got = {r["id"]: r for r in v.collect()}
    assert got[1]["validation_is_valid"] is False
    assert got[1]["suggested_municipality"] == "Municipalidad de Santiago"
    assert got[1]["validation_issues"][0]["type"] == "geographic_mismatch"
    assert got[2]["validation_is_valid"] is True and got[3]["suggested_municipality"] is None
    rep = Q.geo_report(v).first()
    assert (rep["registros_municipales"], rep["registros_invalidos"]) == (2, 1)
    assert rep["tasa_validez"] == pytest.approx(50.0)
    assert [tuple(r) for r in Q.geo_issues_by_type(v).collect()] == [("geographic_mismatch", 1)]
    fixed = {r["id"]: r["organismo"] for r in Q.geo_fix(v).collect()}
    assert fixed[1] == "Municipalidad de Santiago"
    assert Q.geo_fix(v, apply=False).count() == 1


def test_top_k_per_group_matches_brute_force_under_skew(spark):
    rnd = random.Random(11)
    rows = [(i, "hot" if rnd.random() < 0.6 else f"g{rnd.randint(0, 4)}", rnd.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, k string, v double")
    got = G.top_k_per_group(df, "k", [F.col("v"), F.col("id")], 7)
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()  # cut before the exchange
    w = Window.partitionBy("k").orderBy("v", "id")
    brute = df.withColumn("r", F.row_number().over(w)).where("r <= 7")
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in brute.collect())


def test_stratified_sample_caps(spark):
    rows = [(i, "Ministerio A" if i < 300 else ("Muni B" if i < 900 else f"Muni {i % 10}")) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, organismo string")
    s = G.stratified_sample(df, target=100)
    counts = {r["organismo"]: r["count"] for r in s.groupBy("organismo").count().collect()}
    base = max(3, 100 // 12)
    assert counts["Ministerio A"] == base * 3 and counts["Muni B"] == base
    assert G.stratified_sample(df, target=5000).count() == 1200      # no-op below target


def test_rename_map_later_wins_and_roles(spark):
    df = spark.createDataFrame([("a", "1", "2")], "`Nombre Funcionario` string, `Sueldo Base` string, "
                                                  "`Remuneración Bruta` string")
    out = MP.rename_map(df, {"Sueldo Base": "sueldo", "Remuneración Bruta": "sueldo"})
    assert out.columns == ["Nombre Funcionario", "sueldo"] and out.first()["sueldo"] == "2"
    roles = MP.role_columns(df.columns, exclusive=True)
    assert roles["sueldo"] == ["Sueldo Base", "Remuneración Bruta"] and roles["nombre"] == ["Nombre Funcionario"]
    assert MP.find_column(["Institución", "Servicio"], ["servicio", "instit"]) == "Servicio"


def test_progress_merge_is_order_independent(spark, sf_small):
    from nomina.plans.common import table

    att = PR.attempts_from_events(table(spark, sf_small, "events"))
    full = PR.progress(att).select(*PR.PUBLIC_COLS)
    a, b, c = att.randomSplit([0.3, 0.3, 0.4], seed=5)
    merged = PR.merge_progress(PR.merge_progress(PR.progress(c), PR.progress(a)), PR.progress(b))
    assert sorted(map(tuple, merged.select(*PR.PUBLIC_COLS).collect())) == sorted(map(tuple, full.collect()))


def test_dense_index(spark):
    from nomina.operators import windows as W

    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(57)], "k string").repartition(5)
    assert {r["k"]: r["i"] for r in W.dense_index(df, "k").collect()} == {f"k{i:03d}": i for i in range(57)}
    assert W.dense_index(df.limit(0), "k").collect() == []
    b = W.batch_numbers(df, "k", 20)
    assert sorted(r["lote"] for r in b.collect()) == [0] * 20 + [1] * 20 + [2] * 17
