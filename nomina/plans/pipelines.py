"""Composite user jobs (PIP-01..10) built from the operators.

Each pipeline is one lazy plan from its inputs to its outputs; the file
hand-offs between processes of the reference disappear.  A caller that
feeds several reports from one cleaned frame should ``checkpoint()`` it
into the shared checkpoint dir once, which also cuts lineage so a lost
executor only recomputes from there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomina.functions import categorize as C
from nomina.functions import money as M
from nomina.functions import text as T
from nomina.operators import aggregates as A
from nomina.operators import filters as FL
from nomina.operators import inequality as I
from nomina.operators import mapping as MP
from nomina.operators import quality as Q
from nomina.operators import sampling as G
from nomina.operators import topk as TK
from nomina.operators.ranks import gini_from_ranks, percentiles_from_ranks, quantiles_from_ranks, value_ranks
from nomina.operators.scalars import attach_row
from nomina.session import ensure_checkpoint_dir
from nomina.sources import files as FS
from nomina.sources import sinks as SK

SAL = "sueldo_bruto"
TEXT_FIELDS = ["organismo", "nombre", "cargo", "grado", "estamento"]


def fill_text(df: DataFrame, cols=TEXT_FIELDS) -> DataFrame:
    """SCL-08 over the canonical text fields."""
    return df.withColumns({c: T.fill_trim(c) for c in cols if c in df.columns})


@dataclass
class EtlResult:
    clean: DataFrame
    stats: DataFrame


def monthly_etl(spark: SparkSession, raw_root: str, sources: list[str] | None, as_of: str,
                out_dir: str | None = None) -> EtlResult:
    """PIP-01: raw/<source>/<YYYY-MM>/*.csv -> canonical, valid, trimmed -> stats (+ sinks)."""
    frames = []
    for src in sources or FS.landed_sources(spark, raw_root):
        raw = FS.month_dir_scan(spark, raw_root, [src], as_of=as_of)
        if raw is None:
            continue
        frames.append(MP.normalize(raw, src.split("=")[-1], file_name=F.col("archivo_origen"), as_of=as_of))
    canon = MP.union_by_name(*frames)
    # the trim's rounds, two sinks and the statistics read the rows: materialise them once in
    # the shared checkpoint dir instead of parsing the raw files each time
    ensure_checkpoint_dir(spark)
    clean = fill_text(FL.quantile_trim(FL.valid_salary(canon).checkpoint()))
    stats = A.summary_stats(clean)
    if out_dir:
        SK.write_dated_and_latest(clean.withColumn("periodo", F.lit(as_of[:7])), f"{out_dir}/sueldos")
        SK.write_json_doc(stats, f"{out_dir}/estadisticas")
    return EtlResult(clean, stats)


def clean_consolidated(df: DataFrame, api_source: str = C.API_SOURCE) -> DataFrame:
    """PIP-02: to_number -> infer body / class for the API source -> fill -> open range."""
    d = df.withColumn(SAL, M.to_number(F.col(SAL)))
    api = F.col("fuente") == api_source
    d = d.withColumn("organismo", C.infer_body("organismo", "fuente", api_source))
    d = d.withColumn("estamento", F.when(api & (F.col("estamento").isNull() | (F.col("estamento") == T.MISSING)),
                                         C.infer_class("cargo")).otherwise(F.col("estamento")))
    return FL.open_range(fill_text(d))


def final_consolidation(staff: DataFrame, other: DataFrame, source: str) -> DataFrame:
    """PIP-03: full names + salary by priority on the staff table, union with the rest,
    open range filter."""
    pri = ["Remuneración bruta mensualizada", "Honorario bruto mensual", "Pago Mensual"]
    s = staff.select(
        F.col("Institución").alias("organismo"),
        MP.full_name("Nombres", "Apellido Paterno", "Apellido Materno").alias("nombre"),
        F.col("Cargo o función").alias("cargo"), F.col("Grado EUS").alias("grado"),
        F.col("Estamento").alias("estamento"),
        MP.salary_by_priority(staff, pri, "auto", row_level=True).alias(SAL), F.lit(source).alias("fuente"))
    common = ["fuente", SAL, "organismo", "estamento", "grado", "cargo", "nombre"]
    return FL.open_range(MP.union_by_name(MP.project_common(s, common), MP.project_common(other, common)))


def enrich(df: DataFrame, materialize: bool = False) -> DataFrame:
    """PIP-04: clean (> 100k, fill, upper class) -> category -> band + avg-rank percentile ->
    body and class statistics joined back.

    The three orderings it needs (all rows, per body, per class) share ONE rank
    table and ONE aggregate: the (group, salary) projections are unioned under a
    (kind, key) tag, so the distinct-value checkpoint, split points, window and
    group statistics run once instead of three times.  ``materialize`` writes
    the cleaned rows once to the shared checkpoint dir.
    """
    d = FL.floor_filter(df.where(F.col(SAL).isNotNull()))
    d = fill_text(d).withColumn("estamento", F.upper("estamento"))
    d = d.withColumn("categoria_organismo", C.categorize_11("organismo"))
    d = d.withColumn("sueldo_categoria", C.band_enrich(SAL))
    if materialize:
        ensure_checkpoint_dir(df.sparkSession)
        d = d.checkpoint(eager=True)
    kinds = [("_todos", F.lit("")), ("organismo", F.col("organismo")), ("estamento", F.col("estamento"))]
    tagged = reduce(lambda a, b: a.unionByName(b), [
        d.select(F.lit(k).alias("_kind"), key.alias("_key"), F.col(SAL)) for k, key in kinds])
    by = ["_kind", "_key"]
    ranks = value_ranks(tagged, SAL, by)
    med = quantiles_from_ranks(ranks, SAL, {"_med": 0.5}, by)
    stats = (tagged.groupBy(*by).agg(F.count(SAL).alias("_n"), F.bround(F.avg(SAL), 0).alias("_avg"))
             .join(med, by, "left").withColumn("_med", F.bround("_med", 0)))
    pct = percentiles_from_ranks(ranks.where(F.col("_kind") == "_todos"), SAL, "sueldo_percentil")
    out = d.join(pct.select("_v", "sueldo_percentil"), d[SAL].cast("double") == F.col("_v"), "left").drop("_v")
    for kind, names in (("organismo", ("total_funcionarios", "promedio_sueldo", "mediana_sueldo")),
                        ("estamento", ("total_estamento", "promedio_estamento", "mediana_estamento"))):
        s = stats.where(F.col("_kind") == kind).select(
            F.col("_key").alias(kind), F.col("_n").alias(names[0]), F.col("_avg").alias(names[1]),
            F.col("_med").alias(names[2]))
        out = out.join(s, kind, "left")
    return out


def categorise_filter_sample(df: DataFrame, floor: float = 200_000, target: int = 5000, big_body: str | None = None):
    """PIP-05: five-way category -> split at ``floor`` -> stratified sample of the kept rows, of
    which ``big_body`` may fill half."""
    d = df.withColumn("categoria_organismo", C.categorize_5("organismo"))
    kept, problems = FL.split_floor(d, SAL, floor)
    return kept, problems, G.stratified_sample(kept, target, big_body=big_body)


def geo_repair(df: DataFrame, apply: bool = True):
    """PIP-06: validate -> report -> fix (or dry-run suggestions)."""
    v = Q.geo_validate(df)
    fixed = Q.geo_fix(v, apply=apply)
    return Q.geo_report(v), fixed


def load_and_monitor(spark: SparkSession, df: DataFrame, table_path: str, log_path: str, as_of: str,
                     max_hours: float = 48.0) -> DataFrame:
    """PIP-07: gate -> replace table -> append load log -> health report."""
    SK.table_load_replace(df, table_path, as_of)
    stored = spark.read.parquet(table_path)
    SK.metadata_append(SK.load_stats(stored, as_of, table_path.rsplit("/", 1)[-1]), log_path)
    log = spark.read.parquet(log_path)
    fr = Q.freshness(log, "fecha_carga", as_of, max_hours).select(
        F.lit("frescura").alias("check"), "estado", F.format_string("%.1f horas", F.col("horas")).alias("mensaje"))
    qs = Q.quality_score(stored).select(F.lit("calidad").alias("check"), "estado",
                                        F.format_string("%.2f%% con sueldo", F.col("pct_con_sueldo")).alias("mensaje"))
    dist = Q.distribution_check(stored).agg(F.min("n").alias("m")).select(
        F.lit("distribucion").alias("check"), F.when(F.col("m") > 0, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("estado"),
        F.format_string("minimo %d por grupo", F.col("m")).alias("mensaje"))
    return Q.health_report([fr, qs, dist])


def dashboard_query(df: DataFrame, filters: list[tuple[str, object]], lo=None, hi=None) -> dict[str, DataFrame]:
    """PIP-08: cascade filter -> metrics, equity, Gini, category stats, top salaries.

    The global median, the Gini and the per-category medians come from ONE
    tagged rank table (all rows + per category) instead of three.
    """
    f = FL.cascade(df, filters, lo=lo, hi=hi)
    if "categoria_organismo" not in f.columns:
        f = f.withColumn("categoria_organismo", C.categorize_11("organismo"))
    cat = "categoria_organismo"
    tagged = (f.select(F.lit("_todos").alias("_kind"), F.lit("").alias("_key"), F.col(SAL))
              .unionByName(f.select(F.lit(cat).alias("_kind"), F.col(cat).alias("_key"), F.col(SAL))))
    r = value_ranks(tagged, SAL, ["_kind", "_key"])
    r_all = r.where(F.col("_kind") == "_todos").drop("_kind", "_key")
    r_cat = r.where(F.col("_kind") == cat).drop("_kind").withColumnRenamed("_key", cat)
    return {"metricas": A.dashboard_metrics(f, ranks=r_all), "equidad": I.equity_ratio(f, "estamento"),
            "gini": gini_from_ranks(r_all, SAL), "categorias": A.category_stats(f, ranks=r_cat),
            "top": TK.top_salaries(f, 20)}


def inequality_report(df: DataFrame) -> DataFrame:
    """PIP-09: closed range -> Gini, max/min, P90/P10, CV, label (one row)."""
    d = FL.closed_range(df)
    r = value_ranks(d, SAL)                       # one rank table feeds Gini and the ratios
    g = gini_from_ranks(r, SAL).select("gini")
    q = quantiles_from_ranks(r, SAL, {"p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9})
    pr = q.select(F.try_divide(F.col("p90"), F.col("p10")).alias("p90_p10"),
                  F.try_divide(F.col("p75"), F.col("p25")).alias("p75_p25"))
    mm = I.max_min_ratio(d).select(F.col("ratio").alias("ratio_max_min"))
    cv = I.cv(d).select("cv")
    # four single-row aggregates side by side (scalar subqueries, no joins)
    one = g
    for part in (mm, pr, cv):
        one = attach_row(one, part)
    return one.withColumn("desigualdad", C.inequality_label("gini"))


def consolidate_month(spark: SparkSession, raw_root: str, sources: list[str] | None, as_of: str) -> DataFrame:
    """PIP-10: scan month dirs with provenance -> union -> rows and salary stats per source."""
    raw = FS.month_dir_scan(spark, raw_root, sources, as_of=as_of)
    sal = M.money_auto(F.col("Remuneración bruta mensualizada"))
    # the median's rounds read the rows again: the files are parsed once
    ensure_checkpoint_dir(spark)
    d = raw.select("fuente", "Institución", sal.alias(SAL)).checkpoint()
    agg = d.groupBy("fuente").agg(F.count(F.lit(1)).alias("n"), F.avg(SAL).alias("promedio"),
                                  F.countDistinct("Institución").alias("organismos"))
    return A.with_quantiles(agg, d, SAL, {"mediana": 0.5}, ("fuente",))
