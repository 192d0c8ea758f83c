"""Heterogeneous -> canonical schema mapping (MAP-01..17).

Column *roles* are decided on the driver from ``df.columns`` (schema
metadata only, never data); the per-row work is one ``select`` of Column
expressions, so mapping a raw table costs a single projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nomina.functions import money as M
from nomina.functions import text as T

SAL = "sueldo_bruto"

# Keyword lists per canonical field (keyword order matters).
FIELD_KEYWORDS = {
    "organismo": ["instit", "organismo", "servicio", "ministerio"],
    "nombre": ["nombre", "funcionario", "empleado", "apellido"],
    "cargo": ["cargo", "puesto", "denominacion", "funcion"],
    "grado": ["grado", "categoria", "nivel", "escala"],
    "estamento": ["estamento", "tipo", "clasificacion"],
    "sueldo_bruto": ["sueldo", "remuner", "bruto", "liquido", "total", "monto"],
}
# Role keyword lists of the exclusive extractors (salary roles are regexes).
ROLE_KEYWORDS_EXCLUSIVE = {
    "sueldo": [r"remuneraci[oó]n", r"sueldo", r"salario", r"bruto", r"l[ií]quido", r"monto",
               r"honorario", r"dotaci[oó]n"],
    "nombre": ["nombre", "funcionario", "empleado", "persona"],
    "cargo": ["cargo", "puesto", "función", "denominación"],
    "estamento": ["estamento", "grado", "categoría", "nivel"],
    "organismo": ["organismo", "institucion", "institución"],
}
# Role keyword lists of the overlapping extractors.
ROLE_KEYWORDS_OVERLAPPING = {
    "sueldo": ["sueldo", "remuneracion", "salario", "bruto", "liquido", "monto"],
    "nombre": ["nombre", "funcionario", "empleado", "persona", "apellido"],
    "cargo": ["cargo", "puesto", "funcion", "denominacion"],
    "estamento": ["estamento", "grado", "categoria", "nivel"],
    "organismo": ["organismo", "institucion", "servicio"],
}
CANONICAL = ["organismo", "nombre", "cargo", "grado", "estamento", SAL]


def find_column(columns: list[str], keywords: list[str]) -> str | None:
    """MAP-01: first keyword (in keyword order) contained in a lower-cased column name
    (columns scanned in their order)."""
    for k in keywords:
        for c in columns:
            if k in c.lower():
                return c
    return None


def _col_or_null(name: str | None, cast: str = "string") -> Column:
    return F.col(f"`{name}`") if name else F.lit(None).cast(cast)


def normalize(df: DataFrame, source: str, file_name: Column | str | None = None,
              salary_col: str | None = None, as_of=None) -> DataFrame:
    """MAP-02: map the six canonical fields by keyword, clean them, add lineage.

    Each field uses its own keyword list (A-3 fixed); rows whose six mapped
    fields are all null are dropped.
    """
    cols = df.columns
    picks = {f: find_column(cols, kw) for f, kw in FIELD_KEYWORDS.items()}
    if salary_col:
        picks[SAL] = salary_col
    out = df.select(
        *[T.clean_text(_col_or_null(picks[f])).alias(f) for f in CANONICAL if f != SAL],
        M.money_auto(_col_or_null(picks[SAL])).alias(SAL),
        F.lit(source).alias("fuente"),
        (F.col("_metadata.file_name") if file_name is None else
         (F.lit(file_name) if isinstance(file_name, str) else file_name)).alias("archivo_origen"),
        (F.lit(as_of).cast("timestamp") if as_of is not None else F.current_timestamp()).alias("fecha_procesamiento"))
    return out.dropna(how="all", subset=CANONICAL)


def role_columns(columns: list[str], exclusive: bool = True,
                 roles=("sueldo", "nombre", "cargo", "estamento", "organismo")) -> dict[str, list[str]]:
    """MAP-03 (exclusive: a column takes the first matching role in ``roles`` order) and
    MAP-04 (overlapping: a column joins every role it matches)."""
    import re

    kw = ROLE_KEYWORDS_EXCLUSIVE if exclusive else ROLE_KEYWORDS_OVERLAPPING
    out = {r: [] for r in roles}
    for c in columns:
        low = c.lower()
        for r in roles:
            hit = (any(re.search(p, low) for p in kw[r]) if exclusive and r == "sueldo"
                   else any(k in low for k in kw[r]))
            if hit:
                out[r].append(c)
                if exclusive:
                    break
    return out


def first_valid_salary(cols: list[str], threshold: float = 100_000, dialect: str = "extractor") -> Column:
    """MAP-05: first salary column whose parsed value exceeds ``threshold`` (else null)."""
    parsed = [M.parse_money(F.col(f"`{c}`"), dialect) for c in cols]
    return F.coalesce(*[F.when(p > threshold, p) for p in parsed]) if parsed else F.lit(None).cast("double")


def first_role_value(cols: list[str]) -> Column:
    """MAP-06: first column of the role, trimmed text, or null."""
    return F.trim(F.col(f"`{cols[0]}`").cast("string")) if cols else F.lit(None).cast("string")


def last_role_value(cols: list[str], default: str | None = None) -> Column:
    """MAP-07: scan all role columns, the last non-null wins."""
    vals = [F.col(f"`{c}`").cast("string") for c in reversed(cols)]
    return F.coalesce(*vals, F.lit(default).cast("string"))


def extract_rows(df: DataFrame, threshold: float = 100_000, dialect: str = "extractor",
                 exclusive: bool = True, body: str | None = None) -> DataFrame:
    """Extractor mapping: roles -> (organismo, nombre, cargo, estamento, sueldo); rows
    without a salary above the threshold are dropped."""
    roles = role_columns(df.columns, exclusive)
    org = first_role_value(roles["organismo"]) if roles["organismo"] else F.lit(body)
    out = df.select(org.alias("organismo"), first_role_value(roles["nombre"]).alias("nombre"),
                    first_role_value(roles["cargo"]).alias("cargo"),
                    first_role_value(roles["estamento"]).alias("estamento"),
                    first_valid_salary(roles["sueldo"], threshold, dialect).alias(SAL))
    return out.where(F.col(SAL).isNotNull())


def rename_map(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """MAP-08: fixed header -> field renames; when two headers map to one field the later wins."""
    winner = {mapping[c]: c for c in df.columns if c in mapping}
    out = []
    for c in df.columns:
        if c in mapping:
            if winner[mapping[c]] == c:
                out.append(F.col(f"`{c}`").alias(mapping[c]))
        elif c not in winner:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def union_by_name(*frames: DataFrame) -> DataFrame:
    """MAP-09."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def project_common(df: DataFrame, wanted: list[str]) -> DataFrame:
    """MAP-10: keep only the wanted columns that exist."""
    return df.select(*[c for c in wanted if c in df.columns])


full_name = T.full_name  # MAP-11


def tag_literals(df: DataFrame, **values) -> DataFrame:
    """MAP-12: add constant columns (year, month, type, source)."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def salary_by_priority(df: DataFrame, priority: list[str], dialect: str = "cl",
                       row_level: bool = False) -> Column:
    """MAP-13: salary from the first *present* column of ``priority`` (presence-based);
    ``row_level=True`` instead takes the first non-null parsed value per row."""
    present = [c for c in priority if c in df.columns]
    if not present:
        return F.lit(None).cast("double")
    if row_level:
        return F.coalesce(*[M.parse_money(F.col(f"`{c}`"), dialect) for c in present])
    return M.parse_money(F.col(f"`{present[0]}`"), dialect)


def salary_by_name_or_last(df: DataFrame, name: str = "remuneracion bruta mensualizada") -> Column:
    """MAP-14: the named monthly-gross column, else the last column."""
    c = next((c for c in df.columns if name in c.lower()), df.columns[-1])
    return M.money_auto(F.col(f"`{c}`"))


def scale_to_payroll(scale: DataFrame, body: str, source: str, klass: str = "estamento",
                     grade: str = "grado", salary: str = "sueldo", floor: float = 100_000) -> DataFrame:
    """MAP-15: salary-scale rows -> canonical rows; post = '<class> Grado <grade>'."""
    s = M.money_cl(F.col(salary)) if dict(scale.dtypes)[salary] == "string" else F.col(salary).cast("double")
    out = scale.select(F.lit(body).alias("organismo"), F.lit(None).cast("string").alias("nombre"),
                       F.concat(F.col(klass).cast("string"), F.lit(" Grado "), F.col(grade).cast("string")).alias("cargo"),
                       F.col(grade).cast("string").alias("grado"), F.col(klass).cast("string").alias("estamento"),
                       s.alias(SAL), F.lit(source).alias("fuente"))
    return out.where(F.col(SAL) > floor)


def source_union(parts: list[tuple[DataFrame, dict]]) -> DataFrame:
    """MAP-16: each source frame with its own constants, unioned by name."""
    return union_by_name(*[tag_literals(df, **consts) for df, consts in parts])


def fallback_literals(df: DataFrame, source_default: str = "consolidado", url: str = "url_origen") -> DataFrame:
    """MAP-17: fill the source with a default and the origin file from the url."""
    origin = F.regexp_extract(F.col(url), r"([^/]+)$", 1) if url in df.columns else F.lit(None)
    return df.withColumns({
        "fuente": F.coalesce(F.col("fuente"), F.lit(source_default)),
        "archivo_origen": F.coalesce(F.col("archivo_origen") if "archivo_origen" in df.columns else F.lit(None),
                                     origin).cast("string"),
    })
