"""DuckDB SQL text for the scalar functions, built from the same fixed lists.

Used only to write the oracle queries; the library itself never parses SQL.
"""

from __future__ import annotations

from nomina.functions import categorize as C
from nomina.functions import text as T
from nomina.functions import urls as U


def _num(x: float) -> str:
    return "CAST('inf' AS DOUBLE)" if x == float("inf") else repr(x)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any_like(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


def digits(e: str) -> str:
    return f"regexp_replace(CAST({e} AS VARCHAR), '[^0-9.,]', '', 'g')"


def _count(s: str, ch: str) -> str:
    return f"(length({s}) - length(replace({s}, {q(ch)}, '')))"


def _tail(s: str, ch: str) -> str:
    return f"length(regexp_extract({s}, '[^{ch}]*$'))" if ch != "." else \
        f"length(regexp_extract({s}, '[^.]*$'))"


def _euro(s: str) -> str:
    return f"replace(replace({s}, '.', ''), ',', '.')"


def money_auto(e: str) -> str:
    s = digits(e)
    nc, nd = _count(s, ","), _count(s, ".")
    return f"""TRY_CAST(CASE WHEN {s} = '' OR {s} = '.' THEN NULL
  WHEN {nc} > 0 AND {nd} > 0 THEN CASE WHEN {nc} = 1 AND {_tail(s, ',')} <= 2 THEN {_euro(s)} ELSE replace({s}, ',', '') END
  WHEN {nc} > 0 THEN CASE WHEN {nc} = 1 AND {_tail(s, ',')} <= 2 THEN replace({s}, ',', '.') ELSE replace({s}, ',', '') END
  WHEN {nd} > 0 THEN CASE WHEN {nd} > 1 THEN replace({s}, '.', '') WHEN {_tail(s, '.')} <= 2 THEN {s} ELSE replace({s}, '.', '') END
  ELSE {s} END AS DOUBLE)"""


def money_cl(e: str) -> str:
    t = f"CAST({e} AS VARCHAR)"
    markers = ", ".join(q(m) for m in __import__("nomina.functions.money", fromlist=["x"]).CL_NULL_MARKERS)
    return (f"CASE WHEN {t} IN ({markers}) THEN NULL ELSE "
            f"TRY_CAST(trim(replace(replace({t}, '.', ''), ',', '.')) AS DOUBLE) END")


def money_validator(e: str) -> str:
    s = digits(e)
    nc, nd = _count(s, ","), _count(s, ".")
    return f"""TRY_CAST(CASE WHEN {nc} > 0 AND {nd} > 0 THEN {_euro(s)}
  WHEN {nd} > 0 THEN CASE WHEN {nd} > 1 OR {_tail(s, '.')} <= 2 THEN replace({s}, '.', '') ELSE {s} END
  ELSE {s} END AS DOUBLE)"""


def money_extractor(e: str) -> str:
    s = digits(e)
    nc, nd = _count(s, ","), _count(s, ".")
    return f"""TRY_CAST(CASE WHEN {nc} > 0 AND {nd} > 0 THEN {_euro(s)}
  WHEN {nd} > 0 AND {_tail(s, '.')} <= 2 THEN replace({s}, '.', '')
  ELSE {s} END AS DOUBLE)"""


def money_multidot(e: str) -> str:
    s = digits(e)
    nc, nd = _count(s, ","), _count(s, ".")
    return f"""TRY_CAST(CASE WHEN {nc} > 0 AND {nd} > 0 THEN {_euro(s)}
  WHEN {nd} > 1 THEN replace({s}, '.', '')
  ELSE {s} END AS DOUBLE)"""


def categorize_11(e: str) -> str:
    s = f"lower({e})"
    whens = " ".join(f"WHEN {_any_like(s, words)} THEN {q(label)}" for label, words in C.BODY_CATEGORY_11)
    return f"(CASE {whens} ELSE 'Otros' END)"


def categorize_5(e: str) -> str:
    t, s = f"trim({e})", f"lower(trim({e}))"
    return (f"(CASE WHEN {e} IS NULL THEN {q(T.MISSING)} WHEN {t} = {q(C.TAX_SERVICE)} THEN 'Servicios Públicos' "
            f"WHEN {_any_like(s, [m.lower() for m in C.MINISTRIES])} THEN 'Ministerios' "
            f"WHEN contains({s}, 'municipalidad') THEN 'Municipalidades' "
            f"WHEN {_any_like(s, C.STATE_KEYWORDS)} THEN 'Otros Organismos del Estado' ELSE 'Otros' END)")


def infer_class(e: str) -> str:
    s = f"lower({e})"
    whens = " ".join(f"WHEN {_any_like(s, words)} THEN {q(label)}" for label, words in C.CLASS_FROM_POST)
    return f"(CASE WHEN {e} IS NULL OR {e} = {q(T.MISSING)} THEN {q(T.MISSING)} {whens} ELSE 'Auxiliar' END)"


def band_dashboard(e: str) -> str:
    whens = " ".join(f"WHEN {e} <= {_num(hi)} THEN {q(lbl)}"
                     for hi, lbl in C.BANDS_DASHBOARD)
    return f"(CASE WHEN {e} IS NULL OR {e} < 0 THEN NULL {whens} END)"


def band_dashboard_ordinal(e: str) -> str:
    whens = " ".join(f"WHEN {e} <= {_num(hi)} THEN {i}"
                     for i, (hi, _l) in enumerate(C.BANDS_DASHBOARD))
    return f"(CASE WHEN {e} IS NULL OR {e} < 0 THEN NULL {whens} END)"


def band_enrich(e: str) -> str:
    whens = " ".join(f"WHEN {e} <= {_num(hi)} THEN {q(lbl)}"
                     for hi, lbl in C.BANDS_ENRICH)
    return f"(CASE WHEN {e} IS NULL OR {e} <= 0 THEN NULL {whens} END)"


def inequality_label(e: str) -> str:
    return (f"(CASE WHEN {e} < 0.3 THEN 'Baja desigualdad' WHEN {e} < 0.5 THEN 'Desigualdad moderada' "
            f"ELSE 'Alta desigualdad' END)")


def fill_trim(e: str, sentinel: str = T.MISSING) -> str:
    return strip(f"coalesce(CAST({e} AS VARCHAR), {q(sentinel)})")


def strip(e: str) -> str:
    return f"regexp_replace(CAST({e} AS VARCHAR), '^{T.WS}+|{T.WS}+$', '', 'g')"


def clean_text(e: str) -> str:
    t = strip(e)
    toks = ", ".join(q(x) for x in T.NULL_TOKENS)
    return f"(CASE WHEN {t} IS NULL OR lower({t}) IN ({toks}) THEN NULL ELSE regexp_replace({t}, '{T.WS}+', ' ', 'g') END)"


def capitalize_words(e: str) -> str:
    t = f"regexp_replace({strip(e)}, '{T.WS}+', ' ', 'g')"
    return (f"coalesce(array_to_string(list_transform(string_split({t}, ' '), "
            f"lambda w: upper(w[1:1]) || lower(w[2:])), ' '), '')")


def canon_class(e: str) -> str:
    u = f"upper(trim(CAST({e} AS VARCHAR)))"
    whens = " ".join(f"WHEN {u} = {q(k)} THEN {q(v)}" for k, v in T.CLASS_CANON.items())
    return f"coalesce(CASE {whens} ELSE {u} END, '')"


def month_from_url(e: str) -> str:
    s = f"lower({e})"
    whens = " ".join(f"WHEN contains({s}, {q(m)}) THEN '{i:02d}'" for i, m in enumerate(U.MONTHS_ES, start=1))
    return f"(CASE {whens} ELSE '01' END)"


def city_from_text(e: str) -> str:
    from nomina.functions.geo import ALL_PATTERNS
    s = f"lower({e})"
    whens = " ".join(f"WHEN contains({s}, {q(p)}) THEN {q(m)}" for p, m in ALL_PATTERNS)
    return f"(CASE WHEN {e} IS NULL OR {e} = '' THEN NULL {whens} END)"
