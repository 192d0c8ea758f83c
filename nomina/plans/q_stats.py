"""Registered inequality / statistics queries (STA-*, AGG-15/16)."""

from __future__ import annotations

from nomina.operators import filters as FL
from nomina.operators import inequality as I
from nomina.operators import stats as ST
from nomina.plans import sqltext as S
from nomina.plans.common import SAL, categorised, payroll, rounded, table
from nomina.plans.registry import query

CAT11 = S.categorize_11("organismo")
LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]

GINI_SQL = """
WITH v AS (SELECT {key}sueldo_bruto AS x,
  row_number() OVER ({part}ORDER BY sueldo_bruto) AS i FROM {src} WHERE sueldo_bruto IS NOT NULL),
g AS (SELECT {key}count(*) AS n, sum(x) AS t, sum(i * x) AS s FROM v {grp})
SELECT {key}round(CASE WHEN n <= 1 OR t <= 0 THEN 0 ELSE 2 * s / (n * t) - (n + 1) / n END, 6) AS gini, n FROM g"""


@query("sta01_gini", GINI_SQL.format(key="", part="", src="payroll", grp=""))
def sta01_gini(spark, sf_dir):
    return rounded(I.gini(payroll(spark, sf_dir), SAL), {"gini": 6})


@query("sta02_gini_by_group", GINI_SQL.format(key="estamento, ", part="PARTITION BY estamento ",
                                              src="payroll", grp="GROUP BY estamento"))
def sta02_gini_by_group(spark, sf_dir):
    return rounded(I.gini_by_group(payroll(spark, sf_dir), "estamento"), {"gini": 6})


@query("sta03_equity_ratio", """
WITH m AS (SELECT estamento, avg(sueldo_bruto) AS m FROM payroll GROUP BY 1 HAVING avg(sueldo_bruto) IS NOT NULL)
SELECT round(CASE WHEN count(*) > 1 THEN max(m) / min(m) ELSE 1.0 END, 6) AS ratio_max_min,
  round(CASE WHEN count(*) > 1 THEN max(m) - min(m) ELSE 0.0 END, 2) AS diferencia_max_min,
  count(*) AS grupos FROM m""")
def sta03_equity_ratio(spark, sf_dir):
    return rounded(I.equity_ratio(payroll(spark, sf_dir), "estamento"),
                   {"ratio_max_min": 6, "diferencia_max_min": 2})


@query("sta04_equity_within", """
WITH m AS (SELECT grado, organismo, avg(sueldo_bruto) AS m FROM payroll GROUP BY 1, 2
           HAVING avg(sueldo_bruto) IS NOT NULL)
SELECT grado, round(CASE WHEN count(*) > 1 THEN max(m) / min(m) ELSE 1.0 END, 6) AS ratio_max_min,
  round(CASE WHEN count(*) > 1 THEN max(m) - min(m) ELSE 0.0 END, 2) AS diferencia_max_min,
  count(*) AS grupos FROM m GROUP BY grado""")
def sta04_equity_within(spark, sf_dir):
    return rounded(I.equity_within(payroll(spark, sf_dir), "grado", "organismo"),
                   {"ratio_max_min": 6, "diferencia_max_min": 2})


@query("sta05_max_min_ratio", """
SELECT max(sueldo_bruto) AS maximo, min(sueldo_bruto) AS minimo,
  round(CASE WHEN min(sueldo_bruto) > 0 THEN max(sueldo_bruto) / min(sueldo_bruto) ELSE 0 END, 6) AS ratio,
  round(max(sueldo_bruto) - min(sueldo_bruto), 2) AS diferencia FROM payroll""")
def sta05_max_min_ratio(spark, sf_dir):
    return rounded(I.max_min_ratio(payroll(spark, sf_dir)), {"ratio": 6, "diferencia": 2})


@query("sta06_percentile_ratio", """
SELECT round(quantile_cont(sueldo_bruto, 0.1), 2) AS p10, round(quantile_cont(sueldo_bruto, 0.25), 2) AS p25,
  round(quantile_cont(sueldo_bruto, 0.75), 2) AS p75, round(quantile_cont(sueldo_bruto, 0.9), 2) AS p90,
  round(quantile_cont(sueldo_bruto, 0.9) / quantile_cont(sueldo_bruto, 0.1), 6) AS p90_p10,
  round(quantile_cont(sueldo_bruto, 0.75) / quantile_cont(sueldo_bruto, 0.25), 6) AS p75_p25
FROM payroll WHERE sueldo_bruto BETWEEN 100000 AND 10000000""")
def sta06_percentile_ratio(spark, sf_dir):
    out = I.percentile_ratio(FL.closed_range(payroll(spark, sf_dir)))
    return rounded(out, {"p10": 2, "p25": 2, "p75": 2, "p90": 2, "p90_p10": 6, "p75_p25": 6})


@query("sta07_cv", """
SELECT estamento, round(stddev_samp(sueldo_bruto) / avg(sueldo_bruto), 6) AS cv FROM payroll GROUP BY 1""")
def sta07_cv(spark, sf_dir):
    return rounded(I.cv(payroll(spark, sf_dir), SAL, ("estamento",)), {"cv": 6})


@query("sta08_lorenz", """
WITH d AS (SELECT sueldo_bruto, count(*) AS cnt FROM payroll WHERE sueldo_bruto IS NOT NULL GROUP BY 1)
SELECT sueldo_bruto, cnt,
  round(sum(cnt) OVER (ORDER BY sueldo_bruto) / sum(cnt) OVER (), 8) AS pop_share,
  round(sum(sueldo_bruto * cnt) OVER (ORDER BY sueldo_bruto) / sum(sueldo_bruto * cnt) OVER (), 8) AS value_share
FROM d""")
def sta08_lorenz(spark, sf_dir):
    return rounded(I.lorenz(payroll(spark, sf_dir)), {"pop_share": 8, "value_share": 8})


@query("sta09_outliers_iqr_summary", """
WITH q AS (SELECT quantile_cont(sueldo_bruto, 0.25) AS q1, quantile_cont(sueldo_bruto, 0.75) AS q3 FROM payroll),
b AS (SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT round(q1, 2) AS q1, round(q3, 2) AS q3, round(iqr, 2) AS iqr, round(lo, 2) AS limite_inferior,
  round(hi, 2) AS limite_superior, count_if(sueldo_bruto < lo OR sueldo_bruto > hi) AS outliers,
  count(*) AS n, round(count_if(sueldo_bruto < lo OR sueldo_bruto > hi) * 100.0 / count(*), 4) AS pct
FROM payroll, b WHERE sueldo_bruto IS NOT NULL GROUP BY q1, q3, iqr, lo, hi""")
def sta09_outliers_iqr_summary(spark, sf_dir):
    out = ST.outlier_summary_iqr(payroll(spark, sf_dir))
    return rounded(out, {"q1": 2, "q3": 2, "iqr": 2, "limite_inferior": 2, "limite_superior": 2, "pct": 4})


@query("sta09_outliers_iqr_top10", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, event_type, value FROM events, q
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)
ORDER BY value DESC, event_id LIMIT 10""", payroll=False)
def sta09_outliers_iqr_top10(spark, sf_dir):
    o = ST.outliers_iqr(table(spark, sf_dir, "events"), "value")
    return ST.top_rows(o, "value", 10, "event_id").select("event_id", "event_type", "value")


@query("sta10_outliers_z_summary", """
WITH s AS (SELECT avg(sueldo_bruto) AS mu, stddev_pop(sueldo_bruto) AS sd FROM payroll)
SELECT round(mu, 2) AS media, round(sd, 2) AS sigma, count_if(abs(sueldo_bruto - mu) / sd > 3) AS outliers,
  count(*) AS n, round(count_if(abs(sueldo_bruto - mu) / sd > 3) * 100.0 / count(*), 4) AS pct
FROM payroll, s WHERE sueldo_bruto IS NOT NULL GROUP BY mu, sd""")
def sta10_outliers_z_summary(spark, sf_dir):
    return rounded(ST.outlier_summary_z(payroll(spark, sf_dir)), {"media": 2, "sigma": 2, "pct": 4})


@query("sta10_outliers_z_top10", """
WITH s AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM events)
SELECT event_id, user_id, value FROM events, s
WHERE abs(value - mu) / sd > 3 ORDER BY value DESC, event_id LIMIT 10""", payroll=False)
def sta10_outliers_z_top10(spark, sf_dir):
    o = ST.outliers_z(table(spark, sf_dir, "events"), "value")
    return ST.top_rows(o, "value", 10, "event_id").select("event_id", "user_id", "value")


def _corr_sql(cols, top=None):
    from itertools import combinations
    parts = []
    for a, b in combinations(cols, 2):
        parts.append(f"SELECT '{a}' AS var_a, '{b}' AS var_b, corr({a}, {b}) AS r FROM lineitem")
        if top is None:
            parts.append(f"SELECT '{b}', '{a}', corr({a}, {b}) FROM lineitem")
    if top is None:
        parts += [f"SELECT '{c}', '{c}', 1.0::DOUBLE FROM lineitem LIMIT 1" for c in cols]
        body = " UNION ALL ".join(f"({p})" for p in parts)
        return f"SELECT var_a, var_b, round(r, 6) AS r FROM ({body})"
    body = " UNION ALL ".join(parts)
    return f"SELECT var_a, var_b, round(r, 6) AS r FROM ({body}) ORDER BY abs(r) DESC, var_a, var_b LIMIT {top}"


@query("sta11_corr_matrix", _corr_sql(LINEITEM_NUM), payroll=False)
def sta11_corr_matrix(spark, sf_dir):
    return rounded(ST.corr_matrix(table(spark, sf_dir, "lineitem"), LINEITEM_NUM), {"r": 6})


@query("sta12_corr_top", _corr_sql(LINEITEM_NUM, 10), payroll=False)
def sta12_corr_top(spark, sf_dir):
    return rounded(ST.corr_top(table(spark, sf_dir, "lineitem"), LINEITEM_NUM, 10), {"r": 6})


def _ks_sql(standardize: bool) -> str:
    """The definition: distances at the steps of the empirical distribution, the normal one as
    its power series x + x^3/3 + x^5/15 + ..., and the Kolmogorov series."""
    z = "(x - (SELECT avg(x) FROM v)) / (SELECT stddev_samp(x) FROM v)" if standardize else "x"
    return f"""
WITH v AS (SELECT CAST(sueldo_bruto AS DOUBLE) AS x FROM payroll WHERE sueldo_bruto IS NOT NULL),
c AS (SELECT {z} AS z, count(*) AS c FROM v GROUP BY 1),
k AS (SELECT z, c, sum(c) OVER (ORDER BY z) AS upto, sum(c) OVER () AS n FROM c),
f AS (SELECT *, CASE WHEN z > 8 THEN 1.0 WHEN z < -8 THEN 0.0 WHEN z = 0 THEN 0.5 ELSE 0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) *
        list_sum([exp((2 * j + 1) * ln(abs(z)) - (lgamma(2 * j + 2) - j * ln(2) - lgamma(j + 1))) FOR j IN range(160)]) END AS phi FROM k),
d AS (SELECT max(greatest(upto / n - phi, phi - (upto - c) / n)) AS d, max(n) AS n FROM f),
p AS (SELECT d, least(1.0, greatest(0.0, list_sum([CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * j * j * d * d * n) FOR j IN range(1, 101)]))) AS p FROM d)
SELECT round(d, 9) AS estadistico, round(p, 9) AS p_valor, CASE WHEN p < 0.05 THEN 'no normal' ELSE 'normal' END AS veredicto FROM p"""


@query("sta13_ks_normal", _ks_sql(False))
def sta13_ks_normal(spark, sf_dir):
    """KS test vs N(0,1) on raw salaries (statistic 1, 'no normal')."""
    return rounded(ST.ks_normal(payroll(spark, sf_dir)), {"estadistico": 9, "p_valor": 9})


@query("sta13_ks_standardized", _ks_sql(True))
def sta13_ks_standardized(spark, sf_dir):
    return rounded(ST.ks_normal(payroll(spark, sf_dir), standardize=True), {"estadistico": 9, "p_valor": 9})


@query("sta13_jarque_bera", """
WITH s AS (SELECT avg(sueldo_bruto) AS m, count(sueldo_bruto) AS n FROM payroll),
mo AS (SELECT max(n) AS n, avg(power(sueldo_bruto - m, 2)) AS m2, avg(power(sueldo_bruto - m, 3)) AS m3,
  avg(power(sueldo_bruto - m, 4)) AS m4 FROM payroll, s WHERE sueldo_bruto IS NOT NULL)
SELECT n, round(m3 / power(m2, 1.5), 6) AS asimetria, round(m4 / (m2 * m2) - 3, 6) AS curtosis,
  round(n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4), 4) AS jarque_bera FROM mo""")
def sta13_jarque_bera(spark, sf_dir):
    return rounded(ST.moments(payroll(spark, sf_dir)), {"asimetria": 6, "curtosis": 6, "jarque_bera": 4})


HIST_SQL = """
WITH x AS (SELECT {key}sueldo_bruto AS v FROM payroll WHERE sueldo_bruto IS NOT NULL),
mm AS (SELECT min(v) AS mn, max(v) AS mx FROM x),
c AS (SELECT {key}CAST(CASE WHEN (mx - mn) / {bins}.0 = 0 THEN 0
        ELSE least(floor((v - mn) / ((mx - mn) / {bins}.0)), {bins} - 1) END AS INTEGER) AS bin, count(*) AS n
      FROM x, mm GROUP BY ALL),
g AS (SELECT {keysel}CAST(i AS INTEGER) AS bin FROM range({bins}) t(i){keyjoin})
SELECT {gkey}g.bin, round(mn + g.bin * ((mx - mn) / {bins}.0), 2) AS desde,
  round(mn + (g.bin + 1) * ((mx - mn) / {bins}.0), 2) AS hasta, coalesce(c.n, 0) AS n
FROM g CROSS JOIN mm LEFT JOIN c ON g.bin = c.bin{keyon}"""


@query("sta14_histogram", HIST_SQL.format(key="", bins=30, keysel="", keyjoin="", gkey="", keyon=""))
def sta14_histogram(spark, sf_dir):
    return rounded(ST.histogram(payroll(spark, sf_dir), SAL, 30), {"desde": 2, "hasta": 2})


@query("sta15_histogram_by_key", HIST_SQL.format(
    key="estamento, ", bins=50, keysel="k.estamento, ",
    keyjoin=", (SELECT DISTINCT estamento FROM x) k", gkey="g.estamento, ",
    keyon=" AND g.estamento = c.estamento"))
def sta15_histogram_by_key(spark, sf_dir):
    return rounded(ST.histogram(payroll(spark, sf_dir), SAL, 50, ("estamento",)), {"desde": 2, "hasta": 2})


@query("sta16_box_stats", """
WITH q AS (SELECT estamento, quantile_cont(sueldo_bruto, 0.25) AS q1, quantile_cont(sueldo_bruto, 0.5) AS med,
  quantile_cont(sueldo_bruto, 0.75) AS q3 FROM payroll GROUP BY 1)
SELECT p.estamento, round(q1, 2) AS q1, round(med, 2) AS mediana, round(q3, 2) AS q3,
  min(CASE WHEN sueldo_bruto BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN sueldo_bruto END) AS bigote_inferior,
  max(CASE WHEN sueldo_bruto BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN sueldo_bruto END) AS bigote_superior,
  count_if(NOT (sueldo_bruto BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS outliers
FROM payroll p JOIN q ON p.estamento = q.estamento WHERE sueldo_bruto IS NOT NULL
GROUP BY p.estamento, q1, med, q3""")
def sta16_box_stats(spark, sf_dir):
    return rounded(ST.box_stats(payroll(spark, sf_dir), "estamento"), {"q1": 2, "mediana": 2, "q3": 2})


@query("sta17_normal_overlay", """
WITH s AS (SELECT avg(sueldo_bruto) AS mu, stddev_samp(sueldo_bruto) AS sd, min(sueldo_bruto) AS mn,
  max(sueldo_bruto) AS mx, count(sueldo_bruto) AS n FROM payroll),
g AS (SELECT CAST(i AS INTEGER) AS i FROM range(100) t(i)),
p AS (SELECT i, mn + (mx - mn) * i / 99.0 AS x, mu, sd, mn, mx, n FROM g, s)
SELECT i, round(x, 2) AS x,
  round(exp(-0.5 * power((x - mu) / sd, 2)) / (sd * sqrt(2 * pi())) * n * (mx - mn) / 50.0, 6) AS y FROM p""")
def sta17_normal_overlay(spark, sf_dir):
    return rounded(ST.normal_overlay(payroll(spark, sf_dir)), {"x": 2, "y": 6})


@query("sta18_kmeans")
def sta18_kmeans(spark, sf_dir):
    """Rows-only: k-means (k=5, seed 42) cluster per payroll row."""
    return ST.kmeans_clusters(payroll(spark, sf_dir)).select("id", "cluster")


@query("agg16_cluster_stats")
def agg16_cluster_stats(spark, sf_dir):
    return ST.cluster_stats(ST.kmeans_clusters(payroll(spark, sf_dir)))


@query("sta19_band_distribution", f"""
SELECT {S.band_dashboard_ordinal('sueldo_bruto')} AS orden, {S.band_dashboard('sueldo_bruto')} AS banda,
  count(*) AS n FROM payroll WHERE sueldo_bruto IS NOT NULL GROUP BY 1, 2""")
def sta19_band_distribution(spark, sf_dir):
    return ST.band_distribution(payroll(spark, sf_dir))


@query("agg15_inequality_table", f"""
WITH b AS (SELECT *, {CAT11} AS categoria_organismo FROM payroll WHERE sueldo_bruto BETWEEN 100000 AND 10000000),
v AS (SELECT categoria_organismo, sueldo_bruto AS x,
  row_number() OVER (PARTITION BY categoria_organismo ORDER BY sueldo_bruto) AS i FROM b),
g AS (SELECT categoria_organismo, count(*) AS n, avg(x) AS m, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx,
  sum(x) AS t, sum(i * x) AS s FROM v GROUP BY 1)
SELECT categoria_organismo, n, round(m, 2) AS promedio, round(sd, 2) AS desv_std, mn AS minimo, mx AS maximo,
  round(CASE WHEN n <= 1 OR t <= 0 THEN 0 ELSE 2 * s / (n * t) - (n + 1) / n END, 3) AS gini,
  round(sd / m, 2) AS cv FROM g""")
def agg15_inequality_table(spark, sf_dir):
    return I.inequality_table(FL.closed_range(categorised(spark, sf_dir)))


@query("sta08_lorenz_points", """
WITH v AS (SELECT sueldo_bruto AS x, row_number() OVER (ORDER BY sueldo_bruto) AS i,
  sum(sueldo_bruto) OVER (ORDER BY sueldo_bruto ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cs,
  count(*) OVER () AS n, sum(sueldo_bruto) OVER () AS t FROM payroll WHERE sueldo_bruto IS NOT NULL),
g AS (SELECT CAST(j AS INTEGER) AS j FROM range(1, 101) r(j))
SELECT g.j AS punto, round(v.i / v.n, 8) AS pop_share, round(v.cs / v.t, 8) AS value_share
FROM g JOIN v ON v.i = CAST(ceil(g.j * v.n / 100.0) AS BIGINT)""")
def sta08_lorenz_points(spark, sf_dir):
    return rounded(I.lorenz_points(payroll(spark, sf_dir), SAL, 100), {"pop_share": 8, "value_share": 8})
