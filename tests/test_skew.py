"""A third of all rows on one key: grouped operators stay exact (pandas brute force)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nomina.operators import joins as J
from nomina.operators import ranks as R
from nomina.operators import stats as ST
from nomina.plans.common import payroll


@pytest.fixture(scope="module")
def skewed(spark, sf_small):
    p = payroll(spark, sf_small)
    hot = F.when(F.col("id") % 3 == 0, F.lit("Municipalidad de HOT")).otherwise(F.col("organismo"))
    df = p.withColumn("organismo", hot).select("id", "organismo", "sueldo_bruto")
    return df, df.toPandas()


def _gini(x):
    x = np.sort(x.dropna().to_numpy())
    n = len(x)
    return 0.0 if n <= 1 or x.sum() <= 0 else (n + 1 - 2 * np.cumsum(x).sum() / x.sum()) / n


def test_hot_body_holds_a_third(skewed):
    _, pdf = skewed
    share = (pdf["organismo"] == "Municipalidad de HOT").mean()
    assert share == pytest.approx(1 / 3, abs=0.01)


def test_enrich_body_exact_under_skew(skewed):
    df, pdf = skewed
    got = J.enrich_body(df).toPandas().set_index("id").sort_index()
    exp = pdf.set_index("id").sort_index()
    grp = exp.groupby("organismo")["sueldo_bruto"]
    assert (got["total_funcionarios"].to_numpy() == exp["organismo"].map(grp.count()).to_numpy()).all()
    np.testing.assert_allclose(got["promedio_sueldo"], exp["organismo"].map(grp.mean().round(0)), rtol=0)
    np.testing.assert_allclose(got["mediana_sueldo"], exp["organismo"].map(grp.median().round(0)), rtol=0)


def test_gini_and_box_by_group_exact_under_skew(skewed):
    df, pdf = skewed
    g = {r["organismo"]: r["gini"] for r in R.gini(df, "sueldo_bruto", ("organismo",), n_buckets=16).collect()}
    for body, sub in pdf.groupby("organismo"):
        assert g[body] == pytest.approx(_gini(sub["sueldo_bruto"]), abs=1e-9)
    box = {r["organismo"]: r for r in ST.box_stats(df, "organismo").collect()}
    for body, sub in pdf.groupby("organismo"):
        x = sub["sueldo_bruto"].dropna()
        q1, q3 = np.percentile(x, 25), np.percentile(x, 75)
        inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
        assert box[body]["q1"] == pytest.approx(q1) and box[body]["q3"] == pytest.approx(q3)
        assert box[body]["bigote_superior"] == pytest.approx(inside.max())
        assert box[body]["outliers"] == len(x) - len(inside)


def test_percentile_rank_exact_under_skew(skewed):
    df, pdf = skewed
    got = R.avg_rank_percentile(df, "sueldo_bruto", n_buckets=16).toPandas().set_index("id").sort_index()
    exp = (pdf.set_index("id").sort_index()["sueldo_bruto"].rank(pct=True) * 100)
    np.testing.assert_allclose(got["percentil"].astype(float), exp.astype(float), rtol=1e-12, equal_nan=True)
