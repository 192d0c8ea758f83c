"""End-to-end pipelines on landed files."""

import math
import os
import uuid

import pytest

from nomina.plans import pipelines as P
from nomina.session import scratch_path
from tests.test_golden import SCALE


def _local(path: str) -> str:
    return path.replace("file:", "")


def test_monthly_etl_reproduces_published_statistics(spark):
    """PIP-01 over raw/<source>/<YYYY-MM>/scale.csv: 47 scale rows -> 45 after the
    validity filter and the 1-99 % trim, with the published mean/median/min/max/std."""
    root = _local(scratch_path(spark, f"raw-{uuid.uuid4().hex[:8]}"))
    os.makedirs(f"{root}/sii/2025-09")
    with open(f"{root}/sii/2025-09/scale.csv", "w", encoding="utf-8") as fh:
        fh.write("Estamento,Grado,Unidad Monetaria,Remuneracion Bruta Mensualizada\n")
        for i, v in enumerate(SCALE):
            fh.write(f'Directivo,{i + 1},Pesos,"{v}"\n')
    out = _local(scratch_path(spark, f"etl-{uuid.uuid4().hex[:8]}"))
    res = P.monthly_etl(spark, root, ["sii"], "2025-09-30 00:00:00", out_dir=out)
    r = res.stats.first()
    assert r["total_registros"] == 45
    assert math.isclose(r["promedio_sueldo"], 2925347.7555555557, rel_tol=1e-12)
    assert r["mediana_sueldo"] == 2705497
    assert (r["min_sueldo"], r["max_sueldo"]) == (659267, 6358918)
    assert math.isclose(r["desv_std"], 1563099.5110350482, rel_tol=1e-9)
    assert r["fuente_unicos"] == 1 and r["grado_unicos"] == 45
    # both sinks were written: period-partitioned CSV + latest copy, and the JSON document
    assert spark.read.option("header", True).csv(f"{out}/sueldos/latest").count() == 45
    assert spark.read.json(f"{out}/estadisticas").first()["total_registros"] == 45


@pytest.mark.parametrize("apply", [True, False])
def test_geo_repair_pipeline(spark, apply):
    rows = [(1, "Municipalidad de Angol", "Profesor Liceo Santiago"), (2, "Municipalidad de Talca", "Chofer")]
    df = spark.createDataFrame(rows, "id long, organismo string, cargo string")
    report, fixed = P.geo_repair(df, apply=apply)
    assert report.first()["registros_invalidos"] == 1
    if apply:
        assert {r["id"]: r["organismo"] for r in fixed.collect()}[1] == "Municipalidad de Santiago"
    else:
        assert fixed.count() == 1
