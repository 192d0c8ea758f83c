"""Golden facts reproduced from the published salary-scale statistics."""

import math

from pyspark.sql import functions as F

from nomina.functions import money as M
from nomina.operators import aggregates as A
from nomina.operators import filters as FL
from nomina.operators import mapping as MP

# The 47 "Remuneracion Bruta Mensualizada" cells of the 2025-09 salary scale.
SCALE = ["7.738.744", "6.358.918", "5.603.864", "5.328.191", "4.983.345", "4.742.765", "4.434.419",
         "4.173.512", "3.928.829", "3.517.872", "3.102.429", "2.166.267", "5.328.191", "4.983.345",
         "4.742.765", "4.350.819", "4.095.593", "3.855.644", "3.386.071", "2.985.993", "2.602.630",
         "2.307.359", "2.004.018", "1.763.382", "4.173.512", "3.928.829", "3.517.872", "3.044.211",
         "2.705.497", "2.383.499", "2.085.142", "2.353.043", "2.085.142", "1.834.639", "1.402.452",
         "1.203.568", "991.959", "1.763.382", "1.383.691", "1.179.166", "968.307", "801.838",
         "659.267", "552.028", "968.307", "801.838", "659.267"]


def _scale(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate(SCALE)], "id long, sueldo_texto string")


def test_monthly_etl_golden_stats(spark):
    df = _scale(spark).withColumn("sueldo_bruto", M.money_auto("sueldo_texto"))
    clean = FL.quantile_trim(FL.valid_salary(df))
    s = A.summary_stats(clean.withColumns({c: F.lit("x") for c in ["organismo", "estamento", "grado", "fuente"]}))
    r = s.first()
    assert r["total_registros"] == 45
    assert math.isclose(r["promedio_sueldo"], 2925347.7555555557, rel_tol=1e-12)
    assert r["mediana_sueldo"] == 2705497
    assert r["min_sueldo"] == 659267 and r["max_sueldo"] == 6358918
    assert math.isclose(r["desv_std"], 1563099.5110350482, rel_tol=1e-9)


def test_multidot_threshold_drops_low_scale_rows(spark):
    raw = _scale(spark).withColumnRenamed("sueldo_texto", "Remuneracion Bruta Mensualizada")
    kept = raw.select(MP.first_valid_salary(["Remuneracion Bruta Mensualizada"], 50_000, "multidot").alias("s")) \
        .where(F.col("s").isNotNull())
    assert kept.count() == 39
