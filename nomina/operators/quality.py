"""Data quality, validation and monitoring (VAL-01..17).

Row rules produce an ``errores`` array column (``array_compact`` of
conditional messages) so one projection validates every row; reports are
single aggregates (``count_if``) over it.  Monitoring checks are rows of
(check, status, message) unioned into one health report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nomina.functions import money as M
from nomina.functions import text as T
from nomina.functions.geo import city_from_text
from nomina.operators.scalars import attach_row

SAL = "sueldo_bruto"

# Row validation rules.
SALARY_MIN, SALARY_MAX = 100_000, 50_000_000
NAME_LEN = (3, 100)
POST_LEN = (3, 200)
NAME_RE = r"^[a-zA-ZáéíóúÁÉÍÓÚñÑ \t\n\r\f\x0B.\-]+$"
VALID_CLASSES = ["DIRECTIVO", "PROFESIONAL", "TÉCNICO", "ADMINISTRATIVO", "AUXILIAR",
                 "FISCALIZADOR", "EJECUTIVO", "SUPERVISOR", "COORDINADOR", "ANALISTA"]
BODY_KEYWORDS = ["MINISTERIO", "SERVICIO", "MUNICIPALIDAD", "UNIVERSIDAD", "CORPORACIÓN",
                 "FUNDACIÓN", "INSTITUTO", "AGENCIA", "COMISIÓN", "CONSEJO"]
GEO_CONFIDENCE = 0.8


def clean_for_validation(df: DataFrame, salary_text: str = "sueldo_texto") -> DataFrame:
    """VAL-02 cleaning step: P3 salary, capitalised name/post/body, canonical class."""
    return df.withColumns({
        SAL: M.money_validator(salary_text),
        "nombre": T.capitalize_words("nombre"),
        "cargo": T.capitalize_words("cargo"),
        "estamento": T.canon_class("estamento"),
        "organismo": T.capitalize_words("organismo"),
    })


def _money0(x: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(x, 0))


def row_errors(df: DataFrame) -> DataFrame:
    """VAL-01: ``errores`` = messages of the five failed rules (empty when valid)."""
    s, n, c = F.col(SAL), F.trim(F.col("nombre")), F.trim(F.col("cargo"))
    e = F.upper(F.trim(F.col("estamento")))
    o = F.upper(F.trim(F.col("organismo")))
    sal = (F.when(s.isNull() | F.isnan(s), F.lit("Sueldo: Sueldo nulo"))
           .when(s < SALARY_MIN, F.concat(F.lit("Sueldo: Sueldo muy bajo: "), _money0(s)))
           .when(s > SALARY_MAX, F.concat(F.lit("Sueldo: Sueldo muy alto: "), _money0(s))))
    name = (F.when(F.col("nombre").isNull() | (F.col("nombre") == ""), F.lit("Nombre: Nombre vacío"))
            .when(F.length(n) < NAME_LEN[0], F.lit("Nombre: Nombre muy corto"))
            .when(F.length(n) > NAME_LEN[1], F.lit("Nombre: Nombre muy largo"))
            .when(~n.rlike(NAME_RE), F.lit("Nombre: Nombre contiene caracteres inválidos")))
    post = (F.when(F.col("cargo").isNull() | (F.col("cargo") == ""), F.lit("Cargo: Cargo vacío"))
            .when(F.length(c) < POST_LEN[0], F.lit("Cargo: Cargo muy corto"))
            .when(F.length(c) > POST_LEN[1], F.lit("Cargo: Cargo muy largo")))
    klass = (F.when(F.col("estamento").isNull() | (F.col("estamento") == ""), F.lit("Estamento: Estamento vacío"))
             .when(~e.isin(VALID_CLASSES), F.concat(F.lit("Estamento: Estamento no válido: "), e)))
    body_ok = reduce(lambda a, b: a | b, [o.contains(k) for k in BODY_KEYWORDS])
    body = (F.when(F.col("organismo").isNull() | (F.col("organismo") == ""), F.lit("Organismo: Organismo vacío"))
            .when(~body_ok, F.concat(F.lit("Organismo: Organismo no válido: "), o)))
    return df.withColumn("errores", F.array_compact(F.array(sal, name, post, klass, body)))


def split_valid(validated: DataFrame):
    """VAL-02: (valid, invalid) frames from ``row_errors`` output."""
    ok = F.size("errores") == 0
    return validated.where(ok), validated.where(~ok)


def validation_summary(validated: DataFrame) -> DataFrame:
    """VAL-02 counts and validity rate (%), one pass."""
    agg = validated.agg(F.count(F.lit(1)).alias("total"),
                        F.count_if(F.size("errores") == 0).alias("validos"))
    return agg.select("total", "validos", (F.col("total") - F.col("validos")).alias("invalidos"),
                      F.when(F.col("total") > 0, F.col("validos") * 100.0 / F.col("total"))
                      .otherwise(F.lit(0.0)).alias("tasa_validez"))


def errors_by_rule(validated: DataFrame, key: str = "id") -> DataFrame:
    """VAL-03: rows per failed rule (the field before ':')."""
    ex = validated.select(key, F.explode("errores").alias("error"))
    return ex.groupBy(F.substring_index("error", ":", 1).alias("regla")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("filas"))


def geo_validate(df: DataFrame, body: str = "organismo", post: str = "cargo") -> DataFrame:
    """VAL-04: suggested municipality from the post; mismatch issue when it differs."""
    municipal = F.coalesce(F.lower(F.col(body)).contains("municipalidad"), F.lit(False))
    sug = F.when(municipal, city_from_text(F.col(post)))
    mismatch = sug.isNotNull() & (F.lower(sug) != F.lower(F.col(body)))
    message = F.format_string("Institución '%s' sugiere '%s' pero está asignada a '%s'",
                              F.col(post), sug, F.col(body))
    issue = F.struct(F.lit("geographic_mismatch").alias("type"), message.alias("message"),
                     F.col(body).alias("current_municipality"), sug.alias("suggested_municipality"))
    return df.withColumns({
        "validation_is_valid": ~mismatch,
        "validation_issues": F.when(mismatch, F.array(issue)).otherwise(F.array().cast(
            "array<struct<type:string,message:string,current_municipality:string,suggested_municipality:string>>")),
        "suggested_municipality": sug,
        "validation_confidence": F.when(sug.isNotNull(), F.lit(GEO_CONFIDENCE)).otherwise(F.lit(0.0)),
    })


def geo_report(validated: DataFrame, body: str = "organismo") -> DataFrame:
    """VAL-05: totals, municipal rows, invalid rows, validation rate (%)."""
    municipal = F.coalesce(F.lower(F.col(body)).contains("municipalidad"), F.lit(False))
    agg = validated.agg(F.count(F.lit(1)).alias("total_registros"),
                        F.count_if(municipal).alias("registros_municipales"),
                        F.count_if(~F.col("validation_is_valid")).alias("registros_invalidos"))
    m, i = F.col("registros_municipales"), F.col("registros_invalidos")
    return agg.withColumn("tasa_validez", F.when(m > 0, (m - i) * 100.0 / m).otherwise(F.lit(0.0)))


def geo_issues_by_type(validated: DataFrame) -> DataFrame:
    return (validated.where(~F.col("validation_is_valid"))
            .select(F.explode("validation_issues").alias("i"))
            .groupBy(F.col("i.type").alias("tipo")).agg(F.count(F.lit(1)).alias("n")))


def geo_fix(validated: DataFrame, apply: bool = True, body: str = "organismo") -> DataFrame:
    """VAL-06: apply suggestions of confidence >= 0.8 to invalid rows, or (dry run)
    return the suggested fixes only."""
    fixable = (~F.col("validation_is_valid") & F.col("suggested_municipality").isNotNull()
               & (F.col("validation_confidence") >= GEO_CONFIDENCE))
    if not apply:
        return validated.where(fixable).select(
            F.col(body).alias("actual"), F.col("suggested_municipality").alias("sugerido"), "cargo")
    return validated.withColumns({
        body: F.when(fixable, F.col("suggested_municipality")).otherwise(F.col(body)),
        "validation_issues": F.when(fixable, F.array().cast(validated.schema["validation_issues"].dataType))
        .otherwise(F.col("validation_issues")),
        "validation_is_valid": F.when(fixable, F.lit(True)).otherwise(F.col("validation_is_valid")),
    })


# --- monitoring -------------------------------------------------------------------------------
def freshness(df: DataFrame, ts: str, as_of, max_hours: float = 48.0) -> DataFrame:
    """VAL-08: hours since the newest load vs a threshold (``as_of`` injected)."""
    a = F.lit(as_of).cast("timestamp_ntz").cast("timestamp")
    agg = df.agg(F.max(ts).alias("ultima_carga"))
    hours = (F.unix_micros(a) - F.unix_micros(F.col("ultima_carga").cast("timestamp"))) / 3.6e9
    return agg.select("ultima_carga", hours.alias("horas"),
                      F.when(hours <= max_hours, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("estado"))


def quality_score(df: DataFrame, value: str = SAL, body: str = "organismo", source: str = "fuente") -> DataFrame:
    """VAL-09: % rows with salary > 0, distinct bodies and sources; FAIL if any is 0."""
    agg = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(value) > 0).alias("con_sueldo"),
                 F.countDistinct(body).alias("organismos"), F.countDistinct(source).alias("fuentes"))
    pct = F.when(F.col("total") > 0, F.col("con_sueldo") * 100.0 / F.col("total")).otherwise(F.lit(0.0))
    ok = (F.col("con_sueldo") > 0) & (F.col("organismos") > 0) & (F.col("fuentes") > 0)
    return agg.select("*", pct.alias("pct_con_sueldo"),
                      F.when(ok, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("estado"))


def distribution_check(df: DataFrame, keys=("fuente", "estamento")) -> DataFrame:
    """VAL-10: row counts per source and per class as (dimension, key, n)."""
    parts = [df.groupBy(F.col(k).cast("string").alias("clave")).agg(F.count(F.lit(1)).alias("n"))
             .select(F.lit(k).alias("dimension"), "clave", "n") for k in keys]
    return reduce(lambda a, b: a.unionByName(b), parts)


def size_check(spark, path: str, max_mb: float = 0.1) -> DataFrame:
    """VAL-11: total size of the files under ``path`` from a file listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    agg = files.agg(F.count(F.lit(1)).alias("archivos"),
                    F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    mb = F.col("bytes") / (1024.0 * 1024.0)
    return agg.select("archivos", "bytes", mb.alias("mb"),
                      F.when(mb >= max_mb, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("estado"))


def health_report(checks: list[DataFrame]) -> DataFrame:
    """VAL-12: union of (check, estado, mensaje) rows plus the overall verdict."""
    rows = reduce(lambda a, b: a.unionByName(b), checks)
    overall = rows.agg(F.bool_and(F.col("estado") == "PASS").alias("_ok")).select(
        F.lit("general").alias("check"),
        F.when(F.col("_ok"), F.lit("HEALTHY")).otherwise(F.lit("UNHEALTHY")).alias("estado"),
        F.lit("resumen").alias("mensaje"))
    return rows.unionByName(overall)


def completeness(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """VAL-13: % non-null per column (ascending), one aggregate pass."""
    cols = cols or df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(f"_nn_{i}") for i, c in enumerate(cols)])
    entries = ", ".join(f"'{c}', _nn_{i}" for i, c in enumerate(cols))
    long = agg.selectExpr("_n", f"stack({len(cols)}, {entries}) as (columna, no_nulos)")
    return long.select("columna", "no_nulos", F.when(F.col("_n") > 0, F.col("no_nulos") * 100.0 / F.col("_n"))
                       .otherwise(F.lit(0.0)).alias("completitud")).orderBy("completitud", "columna")


def source_audit(df: DataFrame, source: str = "fuente", name: str = "nombre", origin: str = "archivo_origen",
                 official: str = "datos.gob.cl") -> DataFrame:
    """VAL-14: rows per source, % with a real name, distinct official origins."""
    real = F.col(name).isNotNull() & (F.col(name) != T.MISSING)
    off = F.when(F.coalesce(F.col(origin).contains(official), F.lit(False)), F.col(origin))
    agg = df.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.count_if(real).alias("con_nombre"),
                                 F.countDistinct(off).alias("urls_oficiales"))
    return agg.withColumn("pct_con_nombre", F.col("con_nombre") * 100.0 / F.col("n"))


def column_profile(df: DataFrame, keyword: str, samples: int = 5) -> DataFrame:
    """VAL-15: for columns whose name contains ``keyword``: type, non-null count,
    distinct count and the first ``samples`` sorted distinct values (bounded top-k)."""
    fields = [f for f in df.schema.fields if keyword.lower() in f.name.lower()]
    if not fields:
        return df.sparkSession.createDataFrame([], "columna string, tipo string, no_nulos long, distintos long, muestra string")
    kinds = df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)], "_i int, columna string, tipo string")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"`{f.name}`").cast("string").alias("v")) for i, f in enumerate(fields)])).alias("e")
    # one scan: every column's values side by side, distinct ones counted map-side first; the
    # two readers of the counts share their exchange
    counts = df.select(each).groupBy("e._i", "e.v").agg(F.count(F.lit(1)).alias("c"))
    stats = counts.groupBy("_i").agg(F.sum(F.when(F.col("v").isNotNull(), F.col("c")).otherwise(0)).alias("no_nulos"), F.count("v").alias("distintos"))
    place = F.row_number().over(Window.partitionBy("_i").orderBy("v"))
    first = counts.where("v is not null").withColumn("_r", place).where(F.col("_r") <= samples)
    sample = first.groupBy("_i").agg(F.array_join(F.sort_array(F.collect_list("v")), " | ").alias("muestra"))
    out = F.broadcast(kinds).join(stats, "_i", "left").join(sample, "_i", "left")  # a row a column
    return out.select("columna", "tipo", F.coalesce("no_nulos", F.lit(0)).alias("no_nulos"), F.coalesce("distintos", F.lit(0)).alias("distintos"), F.coalesce("muestra", F.lit("")).alias("muestra"))


def slice_diff(before: DataFrame, after: DataFrame, cond: Column, key: str = "id",
               value: str = SAL) -> DataFrame:
    """VAL-17: one slice before and after cleaning: count, min/max/mean, rows lost."""
    def stats(df, tag):
        return df.where(cond).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("minimo"),
                                  F.max(value).alias("maximo"), F.avg(value).alias("promedio")) \
            .select(F.lit(tag).alias("momento"), "*")
    lost = before.where(cond).join(after.select(key), key, "left_anti").agg(
        F.count(F.lit(1)).alias("perdidos"))
    both = stats(before, "antes").unionByName(stats(after, "despues"))
    return attach_row(both, lost)
